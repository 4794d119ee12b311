"""Held-out evaluation passages inside a training corpus, found with suffix arrays over shards of the corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.visual import transducer
from turnloom.session import spread

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the consistent form, without case."""
    return WORD.findall(transducer()(text).casefold())


def suffix_array(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``codes``, by prefix doubling until all differ or ``depth`` codes are compared.

    ``codes`` ends every stretch with 0, which sorts first and only equals another 0.
    """
    n, rank, h = len(codes), codes.astype(np.int64), 1
    while h < depth:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:]
        second[rank == 0] = 0
        pair = rank * (int(rank.max(initial=0)) + 1) + second
        values, fresh = np.unique(pair, return_inverse=True)
        fresh = fresh if len(values) and values[0] == 0 else fresh + 1
        if len(values) == len(np.unique(rank)):
            break
        rank, h = fresh.astype(np.int64), h * 2
    return starts[np.argsort(rank[starts], kind="stable")]


class LeakSearch:
    """The test suffixes, and their binary search in one shard after another."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        texts = [(i, words_of(t)) for i, t in items]
        self.owner, self.offset, stream, starts = [], [], [], []
        for i, words in texts:
            if len(words) < min_words:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(len(codes) - min_words + 1):
                self.owner.append(i)
                self.offset.append(k)
                starts.append(len(stream) + k)
            stream += codes + [0]
        self.stream, self.starts = np.array(stream + [0], np.int64), np.array(starts, np.int64)
        self.owner, self.offset = np.array(self.owner, np.int64), np.array(self.offset, np.int64)
        self.longest = max((len(w) for _, w in texts), default=0)
        self.keys = self._keys(self.stream, self.starts)

    def _keys(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first min_words codes of each suffix as bytes that compare like the codes."""
        if not len(starts):
            return np.empty(0, f"S{4 * self.min_words}")
        window = codes[starts[:, None] + np.arange(self.min_words)].astype(">u4")
        return np.ascontiguousarray(window).view(f"S{4 * self.min_words}").ravel()

    def shard(self, texts: list[tuple[int, list[str]]]) -> pd.DataFrame:
        """Longest verbatim match of every (row, item) of a shard: row, item, n_words, word_pos, item_pos."""
        get, m = self.vocabulary.get, self.min_words
        parts, rows, places = [], [], []
        for row, words in texts:
            codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            # A stretch of fewer than min_words words that occur in no item cannot hold a match; only the others are indexed.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes != 0).astype(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= m:
                    parts.append(np.append(codes[a:b], 0))
                    rows.append(np.full(b - a + 1, row, np.int64))
                    places.append(np.arange(a, b + 1, dtype=np.int64))
        columns = ["row", "item", "n_words", "word_pos", "item_pos"]
        if not parts or not len(self.starts):
            return pd.DataFrame(columns=columns, dtype="int64")
        codes, row_of, place = np.concatenate(parts), np.concatenate(rows), np.concatenate(places)
        left = np.concatenate([np.arange(len(p) - 1, -1, -1, dtype=np.int64) for p in parts])
        order = suffix_array(codes, np.flatnonzero(left >= m), self.longest)
        keys = self._keys(codes, order)
        lo, hi = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.keys, "right")
        out = []
        for at in range(0, len(lo), 256):  # test suffixes in slices, so that the pairs held at once stay few
            count = (hi - lo)[at : at + 256]
            test = np.repeat(np.arange(at, at + len(count)), count)
            if not len(test):
                continue
            begin = np.repeat(lo[at : at + 256] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            pos, ref = order[np.arange(len(test)) + begin], self.starts[test]
            # a match that goes on to the left is the rest of a longer one, which is found from its own start
            longer = (pos > 0) & (ref > 0) & (codes[np.maximum(pos - 1, 0)] == self.stream[np.maximum(ref - 1, 0)]) & (codes[np.maximum(pos - 1, 0)] != 0)
            pos, ref, test = pos[~longer], ref[~longer], test[~longer]
            length, live = np.full(len(test), m, np.int64), np.arange(len(test))
            while len(live):
                a, b = codes[pos[live] + length[live]], self.stream[ref[live] + length[live]]
                live = live[(a == b) & (a != 0)]
                length[live] += 1
            found = pd.DataFrame({"row": row_of[pos], "item": self.owner[test], "n_words": length, "word_pos": place[pos], "item_pos": self.offset[test]})
            out.append(_longest(found))
        if not out:
            return pd.DataFrame(columns=columns, dtype="int64")
        return _longest(pd.concat(out))


def _longest(found: pd.DataFrame) -> pd.DataFrame:
    return found.sort_values(["row", "item", "n_words", "word_pos", "item_pos"], ascending=[True, True, False, True, True]).drop_duplicates(["row", "item"])


def _search(shared: Broadcast, shard_words: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, shard, size, ids = shared.value, [], 0, []

        def flush() -> pd.DataFrame:
            hits = search.shard(shard).reset_index(drop=True)
            hits.insert(0, "id", [ids[r] for r in hits["row"]])
            return hits.drop(columns="row")

        for pdf in batches:
            for i, text in zip(pdf["id"].tolist(), pdf["t"]):
                words = words_of(text)
                shard.append((len(ids), words))
                ids.append(i)
                size += len(words)
                if size >= shard_words:
                    yield flush()
                    shard, size, ids = [], 0, []
        if shard:
            yield flush()

    return run


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = 13,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = 2_000_000,
    max_item_words: int = 20_000_000,
) -> DataFrame:
    """Longest verbatim match per document and item: ``(doc_id, item_id, n_words, word_pos, item_pos)``, positions from 0.

    The test suffixes are prepared once and sent to the tasks; the words of the items are counted first, and items of more than ``max_item_words`` words are searched for in several
    passes, each with a part of them that stays about below that. Each task reads its documents in shards of about ``shard_words`` words (one document is never cut), builds the suffix array of each shard and finds every
    test suffix by binary search; no corpus text is shuffled. A match has at least ``min_words`` words in the consistent form of both texts.

    Rows with a null id or text are ignored, as are items of fewer than ``min_words`` words; a document or item given twice gives its pair once; empty
    tables give no rows; other columns are not looked at.
    """
    held = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    n = held.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    passes = max(1, -(-n // max_item_words))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    id_type = rows.schema["id"].dataType.simpleString()
    hits = None
    for k in range(passes):
        some = held.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(LeakSearch([(r["i"], r["t"]) for r in some], min_words))
        found = spread(rows).mapInPandas(_search(shared, shard_words), f"id {id_type}, item long, n_words long, word_pos long, item_pos long")
        hits = found if hits is None else hits.union(found)
    best = F.max_by(F.struct("n_words", "word_pos", "item_pos"), F.struct("n_words", -F.col("word_pos"), -F.col("item_pos")))
    return (
        hits.groupBy("id", "item").agg(best.alias("m"))
        .select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "m.n_words", "m.word_pos", "m.item_pos")
    )


def remove_leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that give an item away; rows with a null id stay."""
    return docs.join(leaked_passages(docs, items, doc_id=doc_id, **options).select(doc_id).distinct(), doc_id, "left_anti")
