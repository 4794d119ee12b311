"""Language of documents and of their stretches: prediction by partial matching over byte contexts with frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.transcript import parse, without_hesitation, without_notes, words_said
from turnloom.session import spread

LANGUAGES = ("en", "es", "fr", "de", "pt", "hi", "ta")
# Spellings of the declared labels, without region, in lower case.
LABEL_NAMES = {
    "en": "en eng english", "es": "es spa esp spanish español espanol castellano", "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch", "pt": "pt por portuguese português portugues", "hi": "hi hin hindi हिन्दी हिंदी", "ta": "ta tam tamil தமிழ்",
}
# A small labelled table to start from: a few plain sentences of each language.
SEED = {
    "en": "I do not know what to do about it. We talked about the work and how it makes me feel every day. She told me that she would come back when the children are asleep. What would you like to change before the next time we meet? It has been better since I started to sleep, but there are days when nothing helps. Could you tell me more about that evening and what happened then? They were not sure whether it was the right thing for them.",
    "es": "No sé qué hacer con todo esto. Hablamos del trabajo y de cómo me hace sentir cada día. Ella me dijo que volvería cuando los niños estén dormidos. ¿Qué le gustaría cambiar antes de la próxima vez? Ha estado mejor desde que empecé a dormir, pero hay días en que nada ayuda. ¿Me puede contar más sobre aquella noche y lo que pasó después? Mi hermano y mi madre no estaban seguros de si era lo mejor para ellos.",
    "fr": "Je ne sais pas quoi faire avec tout cela. Nous avons parlé du travail et de ce que je ressens chaque jour. Elle m'a dit qu'elle reviendrait quand les enfants dorment. Qu'est-ce que vous aimeriez changer avant la prochaine fois ? Ça va mieux depuis que j'ai commencé à dormir, mais il y a des jours où rien n'aide. Pouvez-vous m'en dire plus sur cette soirée et ce qui s'est passé ensuite ? Ils n'étaient pas sûrs que ce soit bon pour eux.",
    "de": "Ich weiß nicht, was ich damit machen soll. Wir haben über die Arbeit gesprochen und wie ich mich jeden Tag fühle. Sie hat mir gesagt, dass sie zurückkommt, wenn die Kinder schlafen. Was möchten Sie bis zum nächsten Mal ändern? Es ist besser, seit ich wieder schlafe, aber es gibt Tage, an denen nichts hilft. Können Sie mir mehr über den Abend erzählen und was danach geschehen ist? Sie waren nicht sicher, ob es das Richtige für sie war.",
    "pt": "Não sei o que fazer com tudo isso. Nós falamos sobre o trabalho e como eu me sinto a cada dia. Ela me disse que voltaria quando as crianças estivessem dormindo. O que você gostaria de mudar antes da próxima vez? Está melhor desde que comecei a dormir, mas há dias em que nada ajuda. Pode me contar mais sobre aquela noite e o que aconteceu depois? Meu irmão e minha mãe não tinham certeza se era o melhor para eles.",
    "hi": "मुझे नहीं पता कि इसके बारे में क्या करूँ। हमने काम के बारे में बात की और मुझे हर दिन कैसा लगता है। उसने मुझसे कहा कि जब बच्चे सो जाएँगे तब वह वापस आएगी। अगली बार से पहले आप क्या बदलना चाहेंगे? जब से मैं सोने लगा हूँ तब से बेहतर है, लेकिन कुछ दिन ऐसे हैं जब कुछ भी मदद नहीं करता। क्या आप उस शाम के बारे में और बता सकते हैं?",
    "ta": "இதைப் பற்றி என்ன செய்வது என்று எனக்குத் தெரியவில்லை. நாங்கள் வேலையைப் பற்றியும் ஒவ்வொரு நாளும் எப்படி உணர்கிறேன் என்றும் பேசினோம். குழந்தைகள் தூங்கும்போது திரும்பி வருவேன் என்று அவள் சொன்னாள். அடுத்த முறைக்கு முன் எதை மாற்ற விரும்புகிறீர்கள்? தூங்கத் தொடங்கியதிலிருந்து நன்றாக இருக்கிறது, ஆனால் சில நாட்களில் எதுவும் உதவுவதில்லை. அந்த மாலை பற்றி மேலும் சொல்ல முடியுமா?",
}

_SENTENCE_END = re.compile(r"(?<=[.!?।？！])(?<!\b[A-Z]\.)(?<!\bDr\.)(?<!\bMr\.)(?<!\bMs\.)(?<!\bMrs\.)(?<!\bSt\.)(?<!\bext\.)[\"'»”]*\s+")


def declared(label: Column) -> Column:
    """The language a declared label means, whatever its spelling or region; null for a missing or meaningless one."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    out = F.lit(None).cast("string")
    for code, names in LABEL_NAMES.items():
        out = F.when(plain.isin(*names.split()), code).otherwise(out)
    return out


_NO_WORD = re.compile(r"[\d@_<>]")


def lettered(sentence: str) -> str:
    """The sentence without numbers, addresses and codes, which belong to no language."""
    words = sentence.lower().split()
    return " ".join([w for w in words if not _NO_WORD.search(w)] if _NO_WORD.search(sentence) else words)


def sentences(text: str) -> list[str]:
    """Sentences of a text without notes in which something is said."""
    return [s for s in _SENTENCE_END.split(text) if words_said(s)]


def spoken(transcript: str) -> list[str]:
    """The sentences spoken in a transcript, in order; labels, headers, stamps, notes and hesitation are left out.

    A transcript without any label is taken as spoken throughout.
    """
    entries, header = parse(transcript)
    texts = [e.text for e in entries] if entries else [" ".join(header)]
    return [s for t in texts for s in sentences(without_hesitation(without_notes(t)))]


class ByteContexts:
    """Context trees of all languages, compiled into two sorted tables.

    For order k a context is the k bytes before a byte. A language codes a byte in its longest known context: with probability n / (N + D) if the byte
    followed it n of N times among D distinct bytes, else it pays the escape D / (N + D) and drops the first byte of the context; below order 0 all bytes
    are alike. Statistics are frozen after training. The table of (context, byte) pairs known to any language holds each language's
    full cost from that order down; the table of contexts holds the escapes, which are paid on the way down to the first order whose pair is in the table.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = 5) -> None:
        if not 1 <= order <= 6:
            raise ValueError("order must be between 1 and 6, so that a context and its byte fit in a 64-bit key")
        self.languages, self.order = tuple(texts), order
        streams = {lang: np.frombuffer("\n".join(["", *dict.fromkeys(t), ""]).encode(), np.uint8) for lang, t in texts.items()}
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for k in range(order + 1):
            counts.append([np.unique(self._keys(s, k)[k:], return_counts=True) for s in streams.values()])
        n_lang = len(self.languages)
        base = np.full(n_lang, 8.0, np.float32)
        lower_pairs, lower_cost = np.empty(0, np.uint64), np.empty((0, n_lang), np.float32)
        pairs, costs, contexts, escapes = [], [], [], []
        for k in range(order + 1):
            union = np.unique(np.concatenate([c[0] for c in counts[k]]))
            ctx_of = union >> np.uint64(8)
            ctx = np.unique(ctx_of)
            escape = np.zeros((len(ctx), n_lang), np.float32)
            cost = np.empty((len(union), n_lang), np.float32)
            if k:
                # the cost one order down: drop the oldest byte of the context
                down = union & np.uint64((1 << (8 * k)) - 1)
                at = np.searchsorted(lower_pairs, down)
                cost[:] = lower_cost[at]
            else:
                cost[:] = base
            for j, (key, n) in enumerate(counts[k]):
                own, inv = np.unique(key >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(inv, n).astype(np.float64), np.bincount(inv).astype(np.float64)
                at = np.searchsorted(ctx, own)
                escape[at, j] = -np.log2(kinds / (total + kinds))
                cost[:, j] += escape[np.searchsorted(ctx, ctx_of), j]
                cost[np.searchsorted(union, key), j] = -np.log2(n / (total + kinds)[inv])
            lower_pairs, lower_cost = union, cost
            pairs.append(union)
            costs.append(cost)
            contexts.append(ctx)
            escapes.append(escape)
        self.pairs, self.costs, self.contexts, self.escapes = pairs, costs, contexts, escapes

    @staticmethod
    def _keys(stream: np.ndarray, k: int) -> np.ndarray:
        """k bytes of context and the byte itself as one number, at every position (zero-padded in front)."""
        s = stream.astype(np.uint64)
        key = s.copy()
        for back in range(1, k + 1):
            key[back:] |= s[:-back] << np.uint64(8 * back)
        return key

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits each language needs for each text: (texts, languages)."""
        raw = [("\n" + lettered(t) + "\n").encode() for t in texts]
        stream = np.frombuffer(b"".join(raw), np.uint8)
        if not len(stream):
            return np.zeros((len(texts), len(self.languages)))
        size = np.array([len(r) for r in raw])
        start = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(stream)) - start
        bits = np.zeros((len(stream), len(self.languages)), np.float32)
        open_ = np.flatnonzero(place > 0)  # the first line end only gives context
        keys = self._keys(stream, self.order)
        for k in range(self.order, -1, -1):
            can = place[open_] >= k
            rest, now = open_[~can], open_[can]
            key = keys[now] & np.uint64((1 << (8 * (k + 1))) - 1)  # the older bytes of the context are dropped
            at = np.searchsorted(self.pairs[k], key)
            at[at == len(self.pairs[k])] = 0
            hit = self.pairs[k][at] == key
            bits[now[hit]] += self.costs[k][at[hit]]
            miss = now[~hit]
            ctx = key[~hit] >> np.uint64(8)
            at = np.searchsorted(self.contexts[k], ctx)
            at[at == len(self.contexts[k])] = 0
            known = self.contexts[k][at] == ctx
            bits[miss[known]] += self.escapes[k][at[known]]
            open_ = np.concatenate([rest, miss])
        bits[open_] += 8.0
        return np.add.reduceat(bits.astype(np.float64), np.cumsum(size) - size, axis=0)


def _confidence(bits: np.ndarray) -> np.ndarray:
    """Probability of each language from code lengths, all languages being equally likely before."""
    p = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
    return p / p.sum(axis=1, keepdims=True)


class Identifier:
    """Language of every sentence of a document, smoothed where a sentence alone says too little."""

    def __init__(self, model: ByteContexts, margin_bits: float = 25.0, margin_rate: float = 0.5) -> None:
        self.model, self.margin_bits, self.margin_rate = model, margin_bits, margin_rate
        self.cache: dict[str, np.ndarray] = {}

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths with a cache of sentences met before; the cache only saves time and is emptied when large."""
        self.prepare(texts)
        return np.array([self.cache[t] for t in texts])

    def prepare(self, texts: list[str]) -> None:
        """Works out the code lengths of many sentences in a few passes."""
        fresh = [t for t in dict.fromkeys(texts) if t not in self.cache]
        if fresh and len(self.cache) > 400_000:
            self.cache.clear()
            fresh = list(dict.fromkeys(texts))
        for at in range(0, len(fresh), 4096):
            self.cache.update(zip(fresh[at : at + 4096], self.model.code_lengths(fresh[at : at + 4096])))

    def segments(self, texts: list[str]) -> list[tuple[int, int, str, float]]:
        """``(first, last, language, confidence)`` of the stretches of consecutive sentences in one language.

        A sentence whose best language leads the document's by fewer than margin_bits, or by less than margin_rate bits a byte, is no evidence of
        another language and goes with the document's, which is the one that codes most bytes of the sentences that do decide.
        """
        if not texts:
            return []
        bits = self.bits(texts)
        size = np.array([max(1, len(t.encode())) for t in texts], float)
        best = bits.argmin(axis=1)
        two = np.sort(bits, axis=1)
        lead = two[:, 1] - two[:, 0] if bits.shape[1] > 1 else np.full(len(texts), np.inf)
        sure = (lead >= self.margin_bits) & (lead >= self.margin_rate * size)
        weight = np.bincount(best, size * np.where(sure, 1.0, 1e-6), bits.shape[1])
        main = int(weight.argmax())
        ahead = bits[:, main] - bits[np.arange(len(texts)), best]
        own = np.where((ahead >= self.margin_bits) & (ahead >= self.margin_rate * size), best, main)
        edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            both = bits[a:b].sum(axis=0, keepdims=True)
            out.append((int(a), int(b) - 1, self.model.languages[own[a]], float(_confidence(both)[0, own[a]])))
        return out


@lru_cache(maxsize=4)
def seed_model(order: int = 5) -> ByteContexts:
    return ByteContexts({lang: [lettered(s) for s in sentences(text)] for lang, text in SEED.items()}, order)


def train(labelled: list[tuple[str, list[str]]], order: int = 5) -> ByteContexts:
    """Context trees from the seed and from labelled documents, given as lists of sentences.

    First pass: a document counts if the seed's trees code it best in its declared language, so that wrong labels stay out, and each of its
    sentences belongs to the language most such documents declare. Second pass: the trees of the first judge every document, and those that are in
    their declared language throughout train the trees that are returned, so that foreign stretches stay out.
    """
    seed = seed_model(order)
    texts = {lang: [lettered(s) for s in sentences(SEED[lang])] for lang in seed.languages}
    votes: dict[str, np.ndarray] = {}
    for lang, said in labelled:
        if lang in texts and said:
            j = seed.languages.index(lang)
            if seed.code_lengths(said).sum(axis=0).argmin() == j:
                for s in dict.fromkeys(map(lettered, said)):
                    votes.setdefault(s, np.zeros(len(seed.languages), np.int64))[j] += 1
    first = {lang: list(t) for lang, t in texts.items()}
    for s, v in votes.items():
        if (v == v.max()).sum() == 1:
            first[seed.languages[int(v.argmax())]].append(s)
    judge = Identifier(ByteContexts(first, order))
    for lang, said in labelled:
        if lang in texts and [seg[2] for seg in judge.segments(said)] == [lang]:
            texts[lang] += map(lettered, said)
    return ByteContexts(texts, order)


def labelled_sample(df: DataFrame, text: str, label: str, per_language: int) -> list[tuple[str, list[str]]]:
    """Sentences of at most ``per_language`` documents with each declared language, chosen by a hash of their text."""
    rows = df.select(declared(F.col(label)).alias("lang"), F.col(text).alias("t")).where("lang is not null and trim(t) <> ''")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("t"))
    some = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_language)
    return [(r["lang"], spoken(r["t"])) for r in some.select("lang", "t").collect()]


def _segments(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    ident: Identifier = make()
    for pdf in batches:
        rows, ids, declared_as, texts = [], pdf["id"].tolist(), pdf["declared"].tolist(), list(pdf["t"])
        for at in range(0, len(ids), 256):
            said = [spoken(t) for t in texts[at : at + 256]]
            ident.prepare([s for x in said for s in x])
            for i, d, own in zip(ids[at:], declared_as[at:], said):
                for n, (a, b, lang, conf) in enumerate(ident.segments(own), 1):
                    rows.append((i, d, n, lang, conf, b - a + 1, " ".join(own[a : b + 1])))
        yield pd.DataFrame(rows, columns=["id", "declared", "segment_no", "lang", "confidence", "n_sentences", "text"])


def language_segments(
    df: DataFrame, doc_id: str = "session_id", text: str = "transcript", label: str = "lang", per_language: int = 300, order: int = 5
) -> DataFrame:
    """``(doc_id, declared, segment_no, lang, confidence, n_sentences, text)``: the stretches of each document in one language.

    The context trees are fitted on at most ``per_language`` documents a language (a bounded, documented sample) and sent to the tasks; all documents are
    scored whole. Null and blank texts, and those with nothing spoken, give no rows; a null label stays null in ``declared``; repeated rows count
    once; a document with several different texts is read from the longest one (ties: the last in order), and of several labels the first in order holds; an empty table gives no rows;
    other columns are not looked at. A text in none of the languages gets the one that codes it best.
    """
    sample = labelled_sample(df, text, label, per_language)
    shared = df.sparkSession.sparkContext.broadcast(train(sample, order))
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), declared(F.col(label)).alias("declared")).where("id is not null and trim(t) <> ''")
    id_type = rows.schema["id"].dataType.simpleString()
    one = spread(rows, "id").groupBy("id").agg(F.max(F.struct(F.length("t").alias("n"), "t")).alias("m"), F.min("declared").alias("declared"))
    out = one.select("id", "declared", "m.t").mapInPandas(
        lambda it: _segments(it, lambda: Identifier(shared.value)),
        f"id {id_type}, declared string, segment_no int, lang string, confidence double, n_sentences int, text string",
    )
    return out.withColumnRenamed("id", doc_id)


def document_languages(segments: DataFrame, doc_id: str = "session_id") -> DataFrame:
    """``(doc_id, lang, confidence, n_langs)``: the language most sentences are in (ties: alphabetical), its share-weighted confidence, and how many there are."""
    per = segments.groupBy(doc_id, "lang").agg(F.sum("n_sentences").alias("n"), F.sum(F.col("confidence") * F.col("n_sentences")).alias("c"))
    return per.groupBy(doc_id).agg(
        F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"),
        (F.min_by("c", F.struct(-F.col("n"), "lang")) / F.sum("n")).alias("confidence"),
        F.count(F.lit(1)).cast("int").alias("n_langs"),
    )


def label_cases(segments: DataFrame, doc_id: str = "session_id") -> DataFrame:
    """``(doc_id, lang)``: the languages of the documents whose declared label is missing, wrong, or does not cover them."""
    per = segments.groupBy(doc_id).agg(F.collect_set("lang").alias("langs"), F.min("declared").alias("declared"))
    wrong = F.col("declared").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("declared", F.lit("")))
    return per.where(wrong).select(doc_id, F.explode("langs").alias("lang"))
