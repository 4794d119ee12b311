"""Text helpers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def script_language(text: Column) -> Column:
    """'ta' or 'hi' where Tamil or Devanagari (the more frequent one, ties: Tamil) makes up a fifth or more of its own and the Latin letters together, else 'en'."""
    ta, hi, en = (F.regexp_count(text, F.lit(p)) for p in (r"[\u0b80-\u0bff]", r"[\u0900-\u097f]", "[A-Za-z]"))
    return F.when((ta == 0) & (hi == 0), "en").when((ta >= hi) & (ta >= 0.2 * (en + ta)), "ta").when((hi > ta) & (hi >= 0.2 * (en + hi)), "hi").otherwise("en")


def sentence_list(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?।|])\s+"), lambda s: F.trim(s) != "")


def numbers_in(text: Column) -> Column:
    """Distinct numeric tokens in one spelling, as strings: 6.0 and 6 are "6", other fractions keep four significant digits (123.456 and 123.46 are "123.5").

    A fraction of five or more whole digits is kept apart from the whole number it rounds to.
    """
    def spell(token: Column) -> Column:
        x = token.cast("double")
        k = F.pow(F.lit(10.0), 3 - F.floor(F.log10(F.abs(F.when(x == 0, 1.0).otherwise(x)))))
        v = F.rint(x * k) / k
        whole = (x == F.floor(x)) | ((v == F.floor(v)) & (F.abs(v) < 1e4))
        return F.when(whole, F.format_string("%.0f", v_or(x, v))).otherwise(v.cast("string"))

    def v_or(x: Column, v: Column) -> Column:
        return F.when(x == F.floor(x), x + F.lit(0.0)).otherwise(v)

    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+\.?\d*"), F.lit(0)), spell)))


def unsupported_numbers(draft: Column, allowed: Column) -> Column:
    """Numbers of a draft that are not among the allowed ones."""
    return F.array_except(numbers_in(draft), allowed)


def banned_terms(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t))


def clean_excerpt(text: Column, most: int = 80) -> Column:
    """The first sentence in one line, cut at a word boundary with an ellipsis where it is longer than ``most``.

    A sentence ends at a full stop with a blank behind it; only where none stands, at a question mark with a blank, and only then at an exclamation mark with one.
    """
    t = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    first = t
    for end in ("! ", "? ", ". "):
        first = F.when(F.contains(t, F.lit(end)), F.concat(F.split_part(t, F.lit(end), F.lit(1)), F.lit(end[0]))).otherwise(first)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.regexp_replace(F.substring(first, 1, most), r" [^ ]*$", ""), F.lit("…")))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat(F.lpad((F.floor(s / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def duration_words(seconds: Column) -> Column:
    """"n seconds" below a minute and a half, else "x.y minutes"."""
    tenths = F.rint(seconds / 60.0 * 10).cast("long")
    minutes = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" minutes"))
    return F.when(seconds < 90, F.concat(F.rint(seconds).cast("long").cast("string"), F.lit(" seconds"))).otherwise(minutes)


def percent_change(now: Column, before: Column) -> Column:
    """Change in whole percent of ``before``, half to even; 0 where that is 0."""
    return F.when(before == 0, 0).otherwise(F.rint(F.try_divide(100.0 * (now - before), before)).cast("int"))


def valid_code(code: Column) -> Column:
    """The code without blanks around it; null where it is empty or holds a blank inside."""
    plain = F.trim(code)
    return F.when((plain != "") & ~F.contains(plain, F.lit(" ")), plain)


def cut_text(text: Column, most: int) -> Column:
    """The first ``most`` characters; null stays null."""
    return F.substring(text, 1, most)
