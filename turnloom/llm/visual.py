"""One consistent form for text that looks the same but is stored in different characters."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import cut, hot_join, spread

# Letters of other scripts and signs whose usual glyph is that of an ordinary letter or sign (look-alike = ordinary).
LOOK_ALIKES = """
А=A В=B Е=E З=3 І=I Ј=J К=K М=M Н=H О=O Р=P С=C Ѕ=S Т=T У=Y Х=X Ү=Y Ԁ=D Ԍ=G Ԛ=Q Ԝ=W Һ=H
а=a с=c е=e һ=h і=i ј=j о=o р=p ѕ=s у=y х=x ԁ=d ԛ=q ԝ=w ү=y ɡ=g ӏ=l Ӏ=I
Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ι=i ρ=p υ=u κ=k ϲ=c ϳ=j Ϲ=C
ı=i ȷ=j ɑ=a ⅼ=l ո=n օ=o ս=u ց=g հ=h զ=q ա=w Օ=O Տ=S Լ=L
""".split()  # fmt: skip
LOOK_ALIKE_SIGNS = """
‘=' ’=' ‚=' ‛=' ʼ=' ʹ=' ′=' ＇=' “=" ”=" „=" ‟=" ″=" ‐=- ‑=- ‒=- –=- —=- ―=- −=- ⁃=- ﹘=- ﹣=- ․=. ⁄=/ ∕=/ ∶=: ꞉=: ﹕=: ∗=* ⁎=* ﹍=_ ǃ=! ⁓=~ ∼=~ ‹=< ›=>
""".split()  # fmt: skip


def _blank(ch: str) -> bool:
    return unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85"


def _invisible(ch: str) -> bool:
    """Format and control characters, variation selectors and fillers that draw nothing."""
    o = ord(ch)
    if unicodedata.category(ch) == "Cc":
        return ch not in "\n\r" and not _blank(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """The precomputed table: stored cluster -> consistent form; every target is itself stable.

    Single characters get their form by rule: blanks become a space, invisible characters nothing, width, font, ligature and presentation
    variants their compatibility form, look-alikes the ordinary letter. Letters with combining marks are composed. A cluster with two different forms, or a form that would be mapped again, is a conflict and raises.
    """
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if source != target and table.setdefault(source, target) != target:
            raise ValueError(f"conflict for {source!r}: {table[source]!r} and {target!r}")

    alike = dict(p.split("=", 1) for p in LOOK_ALIKES + LOOK_ALIKE_SIGNS)

    def form(ch: str) -> str:
        if _blank(ch):
            return " "
        if _invisible(ch):
            return ""
        if ch in alike:
            return alike[ch]
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if kind in ("<wide>", "<narrow>", "<font>", "<compat>", "<circle>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>", "<noBreak>", "<square>"):
            wide = unicodedata.normalize("NFKC", ch)
            if wide != ch and not wide.startswith(" "):  # a spacing accent stays itself
                return "".join(form(c) for c in wide)
        composed = unicodedata.normalize("NFC", ch)
        if composed != ch:
            return "".join(form(c) for c in composed)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in alike and all(unicodedata.combining(c) for c in parts[1:]):
            return unicodedata.normalize("NFC", alike[parts[0]] + parts[1:])
        return ch

    for o in range(128, sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0xE000 <= o <= 0xF8FF:
            continue
        ch = chr(o)
        if unicodedata.category(ch) != "Cn":
            put(ch, form(ch))
    for o in list(range(32)) + [127]:
        put(chr(o), form(chr(o)))
    put("\r\n", "\n")
    put("\r", "\n")
    for source, target in table.items():
        again = "".join(table.get(c, c) for c in target)
        if unicodedata.normalize("NFC", again) != unicodedata.normalize("NFC", target):
            raise ValueError(f"{source!r} maps to {target!r}, which maps again to {again!r}")
    return table


class Transducer:
    """Longest match over grapheme clusters, compiled once, applied in one pass.

    The compiled pattern takes, at each place, the longest stretch that needs work: a base character with its combining marks (invisible
    characters between them included), or a character of the table. Everything else is copied.
    """

    def __init__(self) -> None:
        self.table = mapping()
        single = [c for c in self.table if len(c) == 1]
        hidden = self._class([c for c in single if self.table[c] == ""])
        marks = self._class([chr(o) for o in range(0x300, sys.maxunicode) if unicodedata.combining(chr(o))])
        self.pattern = re.compile(f"\r\n|[^\n](?:[{hidden}]*[{marks}])+|(?:[{self._class(single)}](?![{hidden}]*[{marks}]))+")
        self.control = re.compile(f"[{self._class([c for c in single if c.isascii()])}]")
        self.cache: dict[str, str] = {}

    @staticmethod
    def _class(chars: list[str]) -> str:
        out, codes = [], sorted(map(ord, chars))
        start = prev = codes[0]
        for o in codes[1:] + [-1]:
            if o != prev + 1:
                out.append(f"\\U{start:08x}-\\U{prev:08x}")
                start = o
            prev = o
        return "".join(out)

    def _cluster(self, match: re.Match) -> str:
        stored = match.group()
        form = self.cache.get(stored)
        if form is None:
            form = unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in stored.replace("\r\n", "\n")))
            if len(self.cache) < 1_000_000:
                self.cache[stored] = form
        return form

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.control.search(text):
            return text
        return self.pattern.sub(self._cluster, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent(text: str) -> str:
    return transducer()(text)


def consistent_column(texts: pd.Series) -> pd.Series:
    one = transducer()
    return pd.Series([None if t is None else one(t) for t in texts], index=texts.index, dtype=object)


def with_consistent_text(df: DataFrame, text: str = "text", out: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form of ``text``; null stays null, the empty text stays empty; an existing column of that name is replaced."""
    return df.withColumn(out, F.pandas_udf(consistent_column, "string")(F.col(text)))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    one, digest = transducer(), lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    for pdf in batches:
        yield pd.DataFrame(
            {"id": pdf["id"], "same": [digest(one(t)) for t in pdf["t"]], "stored": [digest(t) for t in pdf["t"]]}
        )


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(id, same, stored)``: 128-bit digests of the consistent form and of the stored text; texts are read once and not kept."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    id_type = rows.schema["id"].dataType.simpleString()
    return cut(spread(rows).mapInPandas(_digests, f"id {id_type}, same binary, stored binary").distinct())


def form_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_documents, n_stored)``: one row per document, class_id is the smallest id of those that read the same, n_stored how many different texts they are stored in.

    Edge cases as in ``equal_looking_pairs``; a document given with several texts has a row for each of their classes.
    """
    keys = _keys(docs, doc_id, text)
    classes = keys.groupBy("same").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n_documents"), F.count_distinct("stored").alias("n_stored"))
    return hot_join(keys.select("id", "same").distinct(), classes, "same").select(F.col("id").alias(doc_id), "class_id", "n_documents", "n_stored")


def equal_looking_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: tuple[str, str] = ("doc_a", "doc_b")) -> DataFrame:
    """``(doc_a, doc_b)`` with doc_a < doc_b for documents whose texts differ as stored but have one consistent form.

    Only 128-bit digests leave the text stage. Pairs are first made of the different stored texts of a form, which are few, and then spelled out by the documents that hold either, so exact
    copies are never paired with each other and the work is that of the rows asked for; ``form_classes`` gives one row per document instead. Rows with a null id or text are ignored; repeated rows
    count once; the empty text and one of invisible characters only look the same; an empty table gives no rows; other columns are not looked at.
    """
    keys = _keys(docs, doc_id, text)
    texts = keys.select("same", "stored").distinct()
    kinds = texts.join(texts.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same"), "same", "left_semi")
    pairs = kinds.select("same", F.col("stored").alias("x")).join(kinds.select("same", F.col("stored").alias("y")), "same").where("x < y").select("x", "y")
    of = lambda name, stored: keys.select(F.col("id").alias(name), F.col("stored").alias(stored))
    both = pairs.join(of("p", "x"), "x").join(of("q", "y"), "y").where("p <> q")
    return both.select(F.least("p", "q").alias(out[0]), F.greatest("p", "q").alias(out[1])).distinct()
