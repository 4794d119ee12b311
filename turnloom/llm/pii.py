"""Personal information in free text: a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches."""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.pii_samples import fingerprint, labelled, ordinary_vocabulary
from turnloom.session import spread

TYPES = ("email", "phone", "identity_number", "address", "person")
LABELS = ("O", *[f"{p}-{t}" for t in TYPES for p in "BI"])
_OWN = [-1] + [i // 2 for i in range(2 * len(TYPES))]  # type of a label
_BEGIN = [False] + [i % 2 == 0 for i in range(2 * len(TYPES))]
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
REACH = max(map(abs, OFFSETS))
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
TOKENIZERS = "/opt/tokenizers"
WORD_LISTS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
N_FILLS, SEED = 16, 7
# How far the tagger leans towards a label, on top of its weights: the table shows mentions in fewer surroundings than there are, so unseen ones need less.
# Chosen by agreement with the former tagger on sf0.1, then looked at on the held-out sentences.
LEAN = {"O": -0.3, "B-person": 0.4}


@lru_cache(maxsize=2)
def common_words(folder: str = TOKENIZERS) -> dict[str, int]:
    """How common a word is, as spelled: 0 to 2 by the rank of its piece in public tokenizers (the better of two), 1 or less for the words of the labelled table; other words are not in it."""
    out: dict[str, int] = {}
    for name in WORD_LISTS:
        for line in Path(folder, name).read_bytes().split(b"\n"):
            if b" " in line:
                piece, rank = line.split()
                raw = base64.b64decode(piece)
                if raw[:1] == b" " and len(raw) > 2:
                    word = raw[1:].decode("utf-8", "ignore")
                    if word.isalpha():
                        grade = (int(rank) >= 4000) + (int(rank) >= 16000)
                        out[word] = min(grade, out.get(word, 3))
    return out | {w: min(1, out.get(w, 3)) for w in ordinary_vocabulary()}


def shape(token: str, common: dict[str, int]) -> str:
    t = token.strip(" ")
    if t == "\n":
        return "NL"
    if t.isdecimal():
        return f"d{min(len(t), 9)}"
    if not t[0].isalpha():
        return t if ord(t[0]) < 0x3000 else "sym"
    if not t.isascii() and "ऀ" <= t[0] <= "෿":
        return "indic"
    if len(t) == 1:
        return "X1" if t.isupper() else "x1"
    if t.isupper():
        return "XX2" if len(t) == 2 else "XX"
    if t[0].isupper():
        return ("Xx" if t[1:].islower() else "XxX") + str(common.get(t.lower(), 3))
    return ("x" if t.islower() else "xX") + str(common.get(t, 3))


def features(token: str, common: dict[str, int], bare: bool = False) -> list[str]:
    """Features of a token by itself; every one is learnt at each offset around a position. ``bare`` leaves out which word it is."""
    if not token:
        return ["EDGE"]
    t, s = token.strip(" "), shape(token, common)
    out = ["s=" + s, "space" if token[0] == " " else "glued"]
    if t.isdecimal():
        out += ["digit"] + ["w=" + t] * (len(t) <= 2) + ["zeros"] * (not t.strip("0")) + ["lead0"] * (t[0] == "0")
    elif t[0].isalpha():
        low = t.lower()
        case = "U" if t.isupper() else "C" if t[0].isupper() else "l"
        out += [f"v={common.get(low, 3)}{common.get(low.capitalize(), 3)}{case}", f"n{min(len(low), 8)}{case}"]
        out += ["suf3=" + low[-3:], "suf2=" + low[-2:], "pre3=" + low[:3]] + ["w=" + low] * (not bare)
    return out


_SEPARATORS = "+-./()"


def attributes(token: str, common: dict[str, int]) -> tuple[int, int, int, int, int]:
    """What the runs a token stands in are made of: its shape as a number, its part in a number (1 digits, 2 capitals, 3.. separator), digits, kind of word, how rare a word."""
    t = token.strip(" ")
    if not t:
        return 0, 0, 0, 0, 0
    code = zlib.crc32((token[0] * (token[0] == " ") + re.sub(r"\d", "", shape(token, common)[:6])).encode()) * 16 + min(len(t), 15)
    part = 1 if t.isdecimal() else 2 if t.isascii() and t.isupper() and (len(t) <= 2 or len(t) == 5) else 3 + _SEPARATORS.index(t) if t in _SEPARATORS else 0
    word = 0 if not t[0].isalpha() else 1 if t[0].isupper() else 2 if t.islower() and common.get(t, 3) >= 2 else 3
    if not word:
        word = 4 if t == "\n" else 5 if t in ".?!" else 6 if t in ":\uff1a>]\u2013" else 7 if t == "," else 0
    return code, part, len(t) if part == 1 else 0, word, common.get(t.lower(), 3) if word in (1, 2, 3) else 0


def run_keys(own: np.ndarray, glued: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Three keys of every token (0: none): the shape of the whole number it stands in, how many digits that has, and the run of capital or rare words it stands in.

    ``own`` holds the attributes, ``glued`` tells that no blank stands in front, ``new`` that a text begins.
    """
    n = len(own)
    out = np.zeros((3, n), np.uint64)
    part = own[:, 1]
    core = (part == 1) | (part == 2)
    after = np.append(core[1:] & glued[1:] & ~new[1:], False)
    before = np.append(False, core[:-1] & ~new[1:]) & glued
    opens = (part == 3 + _SEPARATORS.index("+")) | (part == 3 + _SEPARATORS.index("("))
    chain = core | ((part >= 3) & np.where(opens, after, np.where(part == 3 + _SEPARATORS.index(")"), before, after & before)))
    first = chain.copy()
    first[1:] &= ~chain[:-1] | new[1:]
    place = np.flatnonzero(chain)
    if len(place):
        begin = np.flatnonzero(first[place])
        size = np.diff(np.append(begin, len(place)))
        where = np.arange(len(place)) - np.repeat(begin, size)
        up, _ = _powers(1 << 20)
        sign = np.add.reduceat((own[place, 0].astype(np.uint64) + np.uint64(1)) * up[np.minimum(where, 64)], begin)
        digits = np.add.reduceat(own[place, 2], begin)
        real = np.repeat(digits > 0, size)
        lead = (where == 0).astype(np.uint64)
        out[0, place] = np.where(real, np.repeat(sign, size) * np.uint64(2) + lead, np.uint64(0))
        out[1, place] = np.where(real, (1000 + np.repeat(np.minimum(digits, 20) * 10 + np.minimum(size, 9), size)).astype(np.uint64) * np.uint64(2) + lead, np.uint64(0))
    word = own[:, 3]
    for kind in (1, 2):
        has = word == kind
        first = has.copy()
        first[1:] &= ~has[:-1] | new[1:]
        place = np.flatnonzero(has)
        if len(place):
            begin = np.flatnonzero(first[place])
            size = np.diff(np.append(begin, len(place)))
            at = place[begin]
            ahead = np.where(new[at] | (at == 0), 4, word[np.maximum(at - 1, 0)])
            rare = own[place, 4]
            key = ((np.minimum(size, 4) * 10 + ahead) * 10 + np.maximum.reduceat(rare, begin)) * 10 + np.minimum.reduceat(rare, begin)
            lead = (np.arange(len(place)) == np.repeat(begin, size)).astype(np.uint64)
            out[2, place] = (np.repeat(key, size) * 10 + rare + 100_000 * kind).astype(np.uint64) * np.uint64(2) + lead
    return out


# Classes of characters: a token is a run of digits, a run of letters with their marks, a line end, or any other sign; a blank in front belongs to it.
_BLANK, _LINE, _DIGIT, _LETTER, _OTHER = range(5)


def _class_of(ch: str) -> int:
    if ch == "\n":
        return _LINE
    if ch.isspace():
        return _BLANK
    if ch.isdecimal():
        return _DIGIT
    return _LETTER if ch.isalnum() or unicodedata.category(ch)[0] == "M" else _OTHER


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class, and a random number, of every character of the basic plane."""
    kinds = np.array([_class_of(chr(o)) for o in range(65536)], np.uint8)
    return kinds, np.random.default_rng(11).integers(0, 2**63, 65536, dtype=np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    one = np.ones(1, np.uint64)
    return np.concatenate((one, np.cumprod(np.full(n, _BASE)))), np.concatenate((one, np.cumprod(np.full(n, inverse))))


@dataclass
class Tokens:
    """Tokens of several texts laid end to end."""

    text: str
    start: np.ndarray
    end: np.ndarray
    lead: np.ndarray
    owner: np.ndarray
    key: np.ndarray

    def token(self, i: int) -> str:
        return " " * int(self.lead[i]) + self.text[self.start[i] : self.end[i]]


def tokenize(texts: list[str]) -> Tokens:
    """All tokens at once: class changes are the borders, and a rolling hash gives each token a 64-bit key."""
    text = "".join(texts)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    n = len(code)
    kinds, salt = _classes()
    low = np.minimum(code, 65535)
    kind, value = kinds[low], salt[low]
    wide = np.flatnonzero(code > 65535)
    if len(wide):
        far, at = np.unique(code[wide], return_inverse=True)
        kind[wide] = np.array([_class_of(chr(o)) for o in far], np.uint8)[at]
        value[wide] = far.astype(np.uint64)[at] * np.uint64(0xD6E8FEB86659FD93)
    edge = np.zeros(n + 1, bool)
    edge[np.cumsum(size)] = True
    edge[0] = True
    fresh = np.ones(n, bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _OTHER) | (kind[1:] == _LINE) | edge[1:-1]
    border = np.flatnonzero(fresh)
    ends = np.append(border[1:], n)
    word = kind[border] != _BLANK
    start, end = border[word], ends[word]
    up, down = _powers(1 << max(20, n.bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[:n])))
    key = (total[end] - total[start]) * down[start]
    lead = (start > 0) & ~edge[start] & (kind[np.maximum(start - 1, 0)] == _BLANK)
    key = key * np.uint64(2) + lead.astype(np.uint64)
    owner = np.searchsorted(np.cumsum(size), start, "right")
    return Tokens(text, start, end, lead, owner, key)


@dataclass
class Tagger:
    """Weights of the random field; ``weights[f, o, label]`` belongs to feature f at offset OFFSETS[o]."""

    feature_ids: dict[str, int]
    shape_ids: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    run_ids: list[np.ndarray]
    runs: list[np.ndarray]
    common: dict[str, int] = field(default_factory=dict)

    def token_scores(self, token: str) -> np.ndarray:
        rows = [i for f in features(token, self.common) if (i := self.feature_ids.get(f)) is not None]
        return self.weights[rows].sum(axis=0)

    def shape_id(self, token: str) -> int:
        return self.shape_ids.get(shape(token, self.common) if token else "EDGE", 0)

    def save(self, path: Path, mark: str) -> None:
        move, begin = allowed()
        np.savez_compressed(
            path, mark=mark, features=np.array(list(self.feature_ids)), shapes=np.array(list(self.shape_ids)), weights=self.weights.astype(np.float16), pairs=self.pairs.astype(np.float16),
            transition=np.where(move, self.transition, 0).astype(np.float32), start=np.where(begin, self.start, 0).astype(np.float32),
            **{f"run_ids{j}": x for j, x in enumerate(self.run_ids)}, **{f"runs{j}": x.astype(np.float16) for j, x in enumerate(self.runs)},
        )


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and starts that make sense: an inside label only follows a label of its own type."""
    n = len(LABELS)
    move = np.array([[_OWN[b] < 0 or _BEGIN[b] or _OWN[a] == _OWN[b] for b in range(n)] for a in range(n)])
    return move, np.array([_OWN[b] < 0 or _BEGIN[b] for b in range(n)])


def _pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), size.max()), np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, size


def viterbi(scores: np.ndarray, size: np.ndarray, transition: np.ndarray, start: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
    """Best label paths of a batch: scores (B, T, L), sequence lengths (B,), longest first; start (L) or (B, L), stop (B, L); positions past the end are 0."""
    b, t, n = scores.shape
    best, back = scores[:, 0] + start, np.zeros((b, t, n), np.int8)
    for i in range(1, t):
        live = int(np.searchsorted(-size, -i, "left"))  # sequences come longest first
        step = best[:live, :, None] + transition
        back[:live, i] = step.argmax(axis=1)
        best[:live] = step.max(axis=1) + scores[:live, i]
    path = np.zeros((b, t), np.int64)
    now = (best if stop is None else best + stop).argmax(axis=1)
    for i in range(t - 1, -1, -1):
        live = int(np.searchsorted(-size, -i, "left"))
        first = size[:live] == i + 1
        state = now[:live] if i + 1 == t else np.where(first, now[:live], back[np.arange(live), i + 1, path[:live, i + 1]])
        path[:live, i] = state
    return path


def _tokens_and_labels(samples: list[list[tuple[str, str]]]) -> tuple[Tokens, np.ndarray]:
    texts = ["".join(p for p, _ in s) for s in samples]
    cut, total = tokenize(texts), sum(map(len, texts))
    kinds, begins, at = np.full(total + 1, -1), np.zeros(total + 1, np.int64), 0
    for piece, kind in (p for s in samples for p in s):
        if kind:
            kinds[at : at + len(piece)] = TYPES.index(kind)
            begins[at] = 1
        at += len(piece)
    kind, upto = kinds[cut.start], np.concatenate(([0], np.cumsum(begins)))
    before = np.append(-1, np.where(np.diff(cut.owner) == 0, kind[:-1], -1))
    fresh = (upto[cut.end] > upto[cut.start]) | (before != kind)
    return cut, np.where(kind < 0, 0, 1 + 2 * kind + ~fresh)


def look_up(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of every key among the sorted known ones, whose first is 0; 0 for others."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, 0)


def fit(
    samples: list[list[tuple[str, str]]], common: dict[str, int], epochs: int = 6, batch: int = 256, rate: float = 0.05, decay: float = 5e-7, bare: float = 0.1, least: int = 4, seed: int = 1
) -> Tagger:
    """Maximum likelihood by Adam on mini-batches; the gradient comes from the forward-backward recursions, vectorised over a batch.

    The rate falls to zero, and the weights returned are a running mean over the last steps.     A share ``bare`` of the words, and four times as many in every fourth sample, is shown as words never seen, so that shape and context must do; features of fewer than ``least`` different samples are left out.
    """
    rng = np.random.default_rng(seed)
    cut, label = _tokens_and_labels(samples)
    new = np.append(True, np.diff(cut.owner) > 0)
    hide = np.where(rng.random(len(samples)) < 0.25, 4 * bare, bare)[cut.owner]
    types: dict[tuple[str, bool], int] = {("", False): 0}
    ids = np.array([types.setdefault((cut.token(i), bool(u)), len(types)) for i, u in enumerate(rng.random(len(label)) < hide)])
    keys = run_keys(np.array([attributes(t, {} if b else common) for t, b in types])[ids], ~cut.lead, new)
    run_ids, run_of = [], []
    for k in keys:
        known, n = np.unique(k, return_counts=True)
        run_ids.append(np.union1d(known[n >= least], np.zeros(1, np.uint64)))
        run_of.append(look_up(run_ids[-1], k))
    parts = sorted(np.split(np.arange(len(ids)), np.flatnonzero(new)[1:]), key=len)
    seqs, golds, runs = [ids[p] for p in parts], [label[p] for p in parts], [[r[p] for p in parts] for r in run_of]
    named = [features(t, {} if b else common, b) for t, b in types]
    seen = np.bincount(np.concatenate([np.unique(s) for s in seqs]), minlength=len(types))
    count: dict[str, int] = {}
    for fs, n in zip(named, seen):
        for f in fs:
            count[f] = count.get(f, 0) + int(n)
    feature_ids: dict[str, int] = {"EDGE": 0}
    rows = [[feature_ids.setdefault(f, len(feature_ids)) for f in fs if f == "EDGE" or count[f] >= least] or [0] for fs in named]
    flat_type = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat_feat = np.concatenate(rows)
    shapes: dict[str, int] = {"?": 0}
    type_shape = np.array([shapes.setdefault(shape(t, {} if b else common) if t else "EDGE", len(shapes)) for t, b in types])
    n, n_feat, n_shape = len(LABELS), len(feature_ids), len(shapes)
    move, begin = allowed()
    params = {
        "w": np.zeros((len(OFFSETS), n_feat, n), np.float32), "p": np.zeros((n_shape * n_shape, n), np.float32),
        "t": np.zeros((n, n), np.float32), "s": np.zeros(n, np.float32), **{f"r{j}": np.zeros((len(x), n), np.float32) for j, x in enumerate(run_ids)},
    }
    mean = {k: np.zeros_like(v) for k, v in params.items()}
    var = {k: np.zeros_like(v) for k, v in params.items()}
    step, total = 0, epochs * -(-len(parts) // batch)
    kept = {k: v.copy() for k, v in params.items()}
    order_feat = np.argsort(flat_feat, kind="stable")
    feat_edges = np.flatnonzero(np.diff(flat_feat[order_feat], prepend=-1))
    lots = [np.arange(a, min(a + batch, len(seqs))) for a in range(0, len(seqs), batch)]
    for _ in range(epochs):
        for lot in rng.permutation(len(lots)):
            pick = lots[lot]
            ids, size = _pad([seqs[i] for i in pick])
            gold, _ = _pad([golds[i] for i in pick])
            b, t = ids.shape
            mask = np.arange(t) < size[:, None]
            wide = np.zeros((b, t + 2 * REACH), np.int64)
            wide[:, REACH : REACH + t] = ids
            used, inverse = np.unique(wide, return_inverse=True)
            inverse = inverse.reshape(wide.shape)
            slot = np.full(len(types), -1)
            slot[used] = np.arange(len(used))
            has = slot[flat_type] >= 0
            by = np.zeros((len(OFFSETS), len(used), n), np.float32)
            ft, ff = slot[flat_type[has]], flat_feat[has]
            ordered = np.argsort(ft, kind="stable")
            edge = np.flatnonzero(np.diff(ft[ordered], prepend=-1))
            for o in range(len(OFFSETS)):
                by[o, ft[ordered][edge]] = np.add.reduceat(params["w"][o, ff[ordered]], edge, axis=0)
            pair = type_shape[wide[:, REACH - 1 : REACH - 1 + t]] * n_shape + type_shape[ids]
            score = params["p"][pair].astype(np.float64)
            inside = [_pad([r[i] for i in pick])[0] for r in runs]
            for j, x in enumerate(inside):
                score += params[f"r{j}"][x]
            for o, off in enumerate(OFFSETS):
                score += by[o][inverse[:, REACH + off : REACH + off + t]]
            trans = np.where(move, params["t"], -1e4).astype(np.float64)
            first = np.where(begin, params["s"], -1e4)
            alpha, beta = np.zeros((b, t, n)), np.zeros((b, t, n))
            alpha[:, 0] = score[:, 0] + first
            big = np.exp(trans)
            for i in range(1, t):
                top = alpha[:, i - 1].max(axis=1, keepdims=True)
                nxt = np.log(np.exp(alpha[:, i - 1] - top) @ big + 1e-300) + top + score[:, i]
                alpha[:, i] = np.where(mask[:, i, None], nxt, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                v = score[:, i + 1] + beta[:, i + 1]
                top = v.max(axis=1, keepdims=True)
                nxt = np.log(np.exp(v - top) @ big.T + 1e-300) + top
                beta[:, i] = np.where(mask[:, i + 1, None], nxt, 0.0)
            top = alpha[:, -1].max(axis=1)
            z = np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1)) + top
            post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            truth = np.eye(n)[gold] * mask[..., None]
            resid = (truth - post).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in params.items()}
            both = mask[:, 1:]
            ab = alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
            expect = (np.exp(np.minimum(ab, 0.0)) * both[..., None, None]).sum(axis=(0, 1))
            moved = np.zeros((n, n))
            np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            grad["t"] = np.where(move, moved - expect, 0).astype(np.float32)
            grad["s"] = resid[:, 0].sum(axis=0)
            flat = resid.reshape(-1, n)
            where = np.argsort(pair.ravel(), kind="stable")
            edge = np.flatnonzero(np.diff(pair.ravel()[where], prepend=-1))
            grad["p"][pair.ravel()[where][edge]] = np.add.reduceat(flat[where], edge, axis=0)
            for j, x in enumerate(inside):
                where = np.argsort(x.ravel(), kind="stable")
                edge = np.flatnonzero(np.diff(x.ravel()[where], prepend=-1))
                grad[f"r{j}"][x.ravel()[where][edge]] = np.add.reduceat(flat[where], edge, axis=0)
                grad[f"r{j}"][0] = 0
            for o, off in enumerate(OFFSETS):
                at = inverse[:, REACH + off : REACH + off + t].ravel()
                where = np.argsort(at, kind="stable")
                edge = np.flatnonzero(np.diff(at[where], prepend=-1))
                g_type = np.zeros((len(types), n), np.float32)
                g_type[used[at[where][edge]]] = np.add.reduceat(flat[where], edge, axis=0)
                grad["w"][o, flat_feat[order_feat][feat_edges]] = np.add.reduceat(g_type[flat_type[order_feat]], feat_edges, axis=0)
            step += 1
            for k, g in grad.items():
                g = g / len(pick) - decay * params[k] * len(pick)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                params[k] += rate * (1 - step / (total + 1)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)
                kept[k] += (params[k] - kept[k]) * min(1.0, 20 / (total * 0.2 + 20))
    params = kept
    weights = np.ascontiguousarray(params["w"].transpose(1, 0, 2)).astype(np.float16).astype(np.float32)
    pairs = params["p"].astype(np.float16).astype(np.float32)
    return Tagger(feature_ids, shapes, weights, pairs, np.where(move, params["t"], -1e4), np.where(begin, params["s"], -1e4), run_ids, [params[f"r{j}"].astype(np.float16).astype(np.float32) for j in range(3)], common)


@lru_cache(maxsize=2)
def trained(folder: str = TOKENIZERS, n_fills: int = N_FILLS, seed: int = SEED) -> Tagger:
    """The tagger fitted on the labelled table; stored weights are used where they were fitted on this very table, else they are fitted anew.

    ``folder`` holds the public tokenizers whose pieces say how common a word is.
    """
    tagger = _fitted(folder, n_fills, seed)
    lean = np.array([LEAN.get(x, 0.0) for x in LABELS], np.float32)
    return replace(tagger, pairs=tagger.pairs + lean)


def _fitted(folder: str, n_fills: int, seed: int) -> Tagger:
    common = common_words(folder)
    if WEIGHTS.exists():
        with np.load(WEIGHTS) as kept:
            if str(kept["mark"]) == fingerprint(n_fills, seed):
                move, begin = allowed()
                ids = lambda k: {str(x): i for i, x in enumerate(kept[k])}
                return Tagger(
                    ids("features"), ids("shapes"), kept["weights"].astype(np.float32), kept["pairs"].astype(np.float32), np.where(move, kept["transition"], -1e4), np.where(begin, kept["start"], -1e4),
                    [kept[f"run_ids{j}"] for j in range(3)], [kept[f"runs{j}"].astype(np.float32) for j in range(3)], common,
                )
    return fit(labelled(n_fills, seed), common)


def runs_above(gain: np.ndarray, more: float) -> np.ndarray:
    """Positions that some stretch with a total gain above ``-more`` covers: the best stretch through each place, by prefix sums and running extremes."""
    total = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
    left = np.minimum.accumulate(total[:-1])
    right = np.maximum.accumulate(total[:0:-1])[::-1]
    return right - left + more > 0


class Decoder:
    """Tags texts in batches; scores of a token are worked out once per distinct token and kept while there is room.

    Scores are differences to label O. Viterbi only runs where it can change anything: a stretch is left at O without decoding if an upper bound of what
    any labels could gain over O, summed over every stretch through it, stays below zero. That gives what decoding whole texts gives.
    """

    def __init__(self, tagger: Tagger, room: int = 60_000, lot: int = 300_000) -> None:
        self.tagger, self.room, self.lot = tagger, room, lot
        trans, start = tagger.transition, tagger.start
        leave = trans[1:, 0] - trans[0, 0]
        self.bounds = []  # most that a label can gain by how it is reached, and what a stretch gains at its end, or at the end of a text
        for share in (0.0, 0.5, 1.0):  # this share of what leaving a label gains is counted where the label is entered, and taken back where one label follows another
            move = trans[:, 1:] - trans[0, 0] + share * leave - np.append(0.0, share * leave)[:, None]
            entry = np.maximum(move.max(axis=0), start[1:] - start[0] + share * leave)
            out = max(0.0, float(((1 - share) * leave).max()))
            self.bounds.append((entry.astype(np.float32), out, max(0.0, float((-share * leave).max()) - out)))
        over = lambda x: np.ascontiguousarray((x[:, 1:] - x[:, :1]).T, np.float32)
        self.pairs, self.runs = over(tagger.pairs), [over(r) for r in tagger.runs]
        self.reset()

    def reset(self) -> None:
        self.rows: dict[int, int] = {0: 0}
        self.shapes, self.own = np.zeros(1024, np.int64), np.zeros((1024, 5), np.int64)
        self.table = np.zeros((len(OFFSETS), len(LABELS) - 1, 1024), np.float32)
        self._put(0, "")

    def _put(self, row: int, token: str) -> None:
        if row == len(self.shapes):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=2)
            self.shapes = np.concatenate((self.shapes, np.zeros_like(self.shapes)))
            self.own = np.concatenate((self.own, np.zeros_like(self.own)))
        score = self.tagger.token_scores(token)
        self.table[:, :, row] = score[:, 1:] - score[:, :1]
        self.shapes[row] = self.tagger.shape_id(token)
        self.own[row] = attributes(token, self.tagger.common)

    def _ids(self, cut: Tokens) -> np.ndarray:
        codes, keys = pd.factorize(cut.key)
        if len(self.rows) + len(keys) > self.room:
            self.reset()
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        rows, own = self.rows, np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = rows.get(key)
            if row is None:
                row = rows[key] = len(rows)
                self._put(row, cut.token(first[i]))
            own[i] = row
        return own[codes]

    def _scores(self, cut: Tokens, ids: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """(labels but O, tokens): how far each label is ahead of O at each token."""
        place = np.arange(len(ids)) + REACH * (cut.owner + 1)
        wide = np.zeros(place[-1] + 1 + REACH, np.int64)  # REACH empty tokens before, between and behind the texts
        wide[place] = ids
        shapes = self.shapes[wide]
        pair = shapes[place - 1] * len(self.tagger.shape_ids) + shapes[place]
        parts = [(self.pairs, pair), *zip(self.runs, (look_up(known, k) for known, k in zip(self.tagger.run_ids, run_keys(self.own[ids], ~cut.lead, opens))))]
        parts += [(self.table[o], wide[place + off]) for o, off in enumerate(OFFSETS)]
        out, room = np.zeros((len(LABELS) - 1, len(ids)), np.float32), np.empty(len(ids), np.float32)
        for table, at in parts:
            for one, row in zip(table, out):
                one.take(at, out=room, mode="clip")
                row += room
        return out

    def tag(self, cut: Tokens) -> np.ndarray:
        """The label of every token."""
        labels = np.zeros(len(cut.start), np.int64)
        if not len(labels):
            return labels
        opens = np.diff(cut.owner, prepend=-1) > 0
        ahead = self._scores(cut, self._ids(cut), opens)
        new = np.flatnonzero(opens)
        closes = np.append(opens[1:], True)
        keep = np.ones(len(labels), bool)
        for entry, out, end in self.bounds:
            gain = np.insert((ahead + entry[:, None]).max(axis=0) + closes * end, new, -1e7)  # no stretch runs from one text into the next
            keep &= np.delete(runs_above(gain, out), new + np.arange(len(new)))
        live = np.flatnonzero(keep)
        if not len(live):
            return labels
        begin = np.flatnonzero((np.diff(live, prepend=-2) > 1) | opens[live])
        size = np.diff(np.append(begin, len(live)))
        order, at = np.argsort(-size, kind="stable"), 0
        trans, start = self.tagger.transition, self.tagger.start
        score = np.zeros((len(live), len(LABELS)))
        score[:, 1:] = ahead[:, live].T
        while at < len(order):
            longest = int(size[order[at]])
            lot = order[at : at + max(1, 30_000 // longest)]
            lot = lot[size[lot] * 2 >= longest]
            at += len(lot)
            here = begin[lot][:, None] + np.minimum(np.arange(longest), size[lot][:, None] - 1)
            a, b = live[begin[lot]], live[begin[lot] + size[lot] - 1]
            head = np.where(opens[a][:, None], start, trans[0])
            tail = np.where(closes[b][:, None], 0.0, trans[:, 0])
            path = viterbi(score[here], size[lot], trans, head, tail)
            inside = np.arange(longest) < size[lot][:, None]
            labels[live[here[inside]]] = path[inside]
        return labels


_SPELLED = {"zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh", "double"}
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "miss"}
_WORD = re.compile(r"[^\W\d_]+")


def plausible(kind: str, mention: str) -> bool:
    """The exact check of a mention: what every value of its type has to hold."""
    digits = sum(c.isdecimal() for c in mention)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", mention, re.I)) and bool(re.search(r"\.\w|\bdot\b", mention, re.I)) and not mention.startswith("[")
    if kind == "phone":
        return digits >= 7 or sum(w in _SPELLED for w in re.findall(r"[a-z]+", mention.lower())) >= 6
    if kind == "identity_number":
        return digits >= 4 and len(re.sub(r"[^\dA-Za-z]", "", mention)) >= 8 and ":" not in mention and not re.fullmatch(r"\d{4}-\d\d-\d\d", mention)
    if kind == "address":
        return digits >= 1 and any(c.isalpha() for c in mention)
    return any(len(w) > 1 and w.lower() not in _TITLES for w in _WORD.findall(mention)) and not re.search(r"[;!?<>()\[\]@\d]", mention)


def _lots(texts: list[str], chars: int, seam: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Lots of ``(text, from, keep_from, keep_to)`` of about ``chars`` characters; a longer text comes in pieces that overlap by twice ``seam``."""
    lot, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = min(len(text), at + chars)
            whole = end == len(text)
            if lot and held + end - at > chars:
                yield lot
                lot, held = [], 0
            lot.append((i, at, at + seam if at else 0, len(text) + 1 if whole else end - seam))
            held += end - at
            if whole:
                break
            at = end - 2 * seam
    if lot:
        yield lot


def mentions(texts: list[str], decoder: Decoder, seam: int = 4096) -> list[list[tuple[int, int, str]]]:
    """``(start, end, type)`` of every mention in each text, in order.

    Texts longer than a lot of the decoder are read in overlapping pieces and the seam is decoded twice; a mention belongs to the piece that has ``seam`` characters or more around it.
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for lot in _lots(texts, max(decoder.lot, 8 * seam), seam):
        parts = [texts[i][a : a + max(decoder.lot, 8 * seam)] for i, a, _, _ in lot]
        cut = tokenize(parts)
        labels = decoder.tag(cut)
        base = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        hot, k = np.flatnonzero(labels), 0
        while k < len(hot):
            a, own = hot[k], _OWN[labels[hot[k]]]
            b = a
            while k + 1 < len(hot) and hot[k + 1] == b + 1 and labels[hot[k + 1]] == 2 + 2 * own and cut.owner[b + 1] == cut.owner[a]:
                k, b = k + 1, hot[k + 1]
            k += 1
            i, from_, keep_from, keep_to = lot[cut.owner[a]]
            start = int(cut.start[a] - base[cut.owner[a]]) + from_
            end = int(cut.end[b] - base[cut.owner[a]]) + from_
            if keep_from <= start < keep_to and plausible(TYPES[own], texts[i][start:end]):
                out[i].append((start, end, TYPES[own]))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each mention replaced by its placeholder; line breaks inside a mention are kept, so that lines keep their numbers."""
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], PLACEHOLDER[kind], "\n" * text.count("\n", start, end)]
        at = end
    return "".join(parts + [text[at:]])


def _found(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    decoder = make()
    for pdf in batches:
        texts, rows = list(pdf["t"]), []
        for origin, row_id, text, spans in zip(pdf["origin"], pdf["row_id"], texts, mentions(texts, decoder)):
            for line, kind in sorted({(line, k) for a, b, k in spans for line in range(text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 2)}):
                rows.append((origin, row_id, line, kind))
        yield pd.DataFrame(rows, columns=["origin", "row_id", "line_no", "pii_type"])


def _redact(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    decoder = make()
    for pdf in batches:
        texts = list(pdf["t"])
        yield pdf.drop(columns="t").assign(text=[redacted(t, s) for t, s in zip(texts, mentions(texts, decoder))])


def _texts(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    rows = None
    for df, origin, row_id, text in parts:
        part = df.select(F.lit(origin).alias("origin"), F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("t"))
        rows = part if rows is None else rows.union(part)
    return rows.where("row_id is not null and t is not null and t <> ''")


def _run(parts: list[tuple[DataFrame, str, str, str]], tokenizers: str, body, schema: str) -> DataFrame:
    rows = _texts(parts)
    shared = rows.sparkSession.sparkContext.broadcast(trained(tokenizers))  # a few MB, whatever the data
    return spread(rows).mapInPandas(lambda it: body(it, lambda: Decoder(shared.value)), schema)


def personal_lines(*parts: tuple[DataFrame, str, str, str], tokenizers: str = TOKENIZERS) -> DataFrame:
    """``(origin, row_id, line_no, pii_type)``: each line that mentions personal information, and each type in it.

    ``parts`` are (table, origin, id column, text column). The tagger is fitted on the labelled table in this package and sent to the tasks (a few MB,
    whatever the data); texts are read whole, and what is found in a text depends on that text alone. A mention that runs over a line end counts in both
    lines. Null and empty texts and null ids give no rows; repeated rows count once; empty tables give no rows; other columns are not looked at.
    """
    return _run(list(parts), tokenizers, _found, "origin string, row_id long, line_no int, pii_type string").distinct()


def redact(*parts: tuple[DataFrame, str, str, str], tokenizers: str = TOKENIZERS) -> DataFrame:
    """``(origin, row_id, text)`` with every mention replaced by its typed placeholder; the same rows as in ``personal_lines``, repeated rows stay."""
    return _run(list(parts), tokenizers, _redact, "origin string, row_id long, text string")


if __name__ == "__main__":  # fits the tagger and stores its weights beside this file
    fit(labelled(N_FILLS, SEED), common_words()).save(WEIGHTS, fingerprint(N_FILLS, SEED))
