"""Language identification of mixed-language text.

Words are runs of letters. Letter n-grams (2 to 4, with word borders) are counted per language over all
training rows in ``BUCKETS`` hashed buckets. A word's scores are the sums of its n-grams' log probabilities for
the languages that its script leaves as candidates (those with a share of their letters in it). Viterbi over a text's words,
with a penalty for each switch of language, labels spans; the language of most letters is the text's.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernel

BUCKETS = 1 << 17
SMOOTHING = 0.5
SWITCH = 20.0
#: Least share of a language's training letters in a script to be a candidate for it.
SCRIPT_SHARE = 0.01
EXCLUDED = -1e4
UNKNOWN = "und"
#: Starts of the Unicode ranges of scripts, with the script's number; 0 is any other. Fixed values.
SCRIPTS = (
    (0x41, 1), (0x250, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xB80, 9),
    (0xC00, 0), (0xE00, 10), (0xE80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0),
    (0x3040, 13), (0x3100, 0), (0x3130, 12), (0x3190, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB10, 0),
    (0xFF21, 1), (0xFF66, 13), (0xFFA0, 12), (0xFFE0, 0), (0x20000, 14), (0x40000, 0),
)
N_SCRIPTS = 15


def tables() -> tuple[np.ndarray, np.ndarray]:
    return common.worker_model("letters", letter_tables)


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower-case code point, 0 if it's no letter; its script."""
    lower = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    starts = np.array([a for a, _ in SCRIPTS])
    at = np.searchsorted(starts, np.arange(sys.maxunicode + 1), side="right") - 1
    script = np.where(at < 0, 0, np.array([s for _, s in SCRIPTS])[at]).astype(np.uint8)
    return lower, script


@dataclass
class Words:
    """Words of texts joined by line feeds: places, lengths, numbers of the texts, scripts; n-gram buckets by letter, and each word's first letter among them."""

    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    script: np.ndarray
    grams: list[np.ndarray]
    first: np.ndarray


def cut(texts: list[str]) -> Words:
    lower, script = tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    v = np.zeros(len(points) + 4, dtype=np.uint32)
    v[2:-2] = lower[points]
    letter = v != 0
    edge = np.diff(letter.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    at = np.flatnonzero(letter)
    b, c, d = v[at - 1], v[at], v[at + 1]
    a = np.where(b != 0, v[at - 2], 0)
    two = b * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77)
    three = two * np.uint32(0xC2B2AE3D) ^ d * np.uint32(0x27D4EB2F)
    four = three * np.uint32(0x165667B1) ^ a * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    grams = [((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for x in (two, three, four)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    size = end - start
    first = np.cumsum(size) - size
    text = np.searchsorted(ends, start - 2, side="right")
    return Words(start - 2, size, text, script[points[start - 2]], grams, first)


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray
    candidates: np.ndarray


def trained(rows: DataFrame) -> DataFrame:
    """lang, bucket, n of training rows (text, lang): n-gram buckets, then letters by script from ``BUCKETS`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                counts = held.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
                for part in kernel.chunks(own, 1 << 19):
                    w = cut([own[i] for i in part])
                    for g in w.grams:
                        counts[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
                    counts[BUCKETS:] += np.bincount(w.script, weights=w.size, minlength=N_SCRIPTS).astype(np.int64)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    common.reachable(rows.sparkSession)
    return rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fitted(rows: DataFrame) -> Model:
    """The model of all training rows: at most languages x (``BUCKETS`` + scripts) counts reach the driver, 0.5 MB of model per language every task."""
    found = trained(rows.where("lang is not null and text is not null")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + N_SCRIPTS))
    number = {x: i for i, x in enumerate(langs)}
    counts[found["lang"].map(number).to_numpy(dtype=int), found["bucket"].to_numpy()] = found["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).T.astype(np.float32)
    candidates = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))).T
    candidates[~candidates.any(1)] = True
    return Model(langs, np.ascontiguousarray(logs), candidates)


def scores(w: Words, model: Model) -> np.ndarray:
    """Log probability of each word in each language."""
    if not len(w.start):
        return np.zeros((0, len(model.langs)), dtype=np.float32)
    letters = model.logs[w.grams[0]]
    letters += model.logs[w.grams[1]]
    letters += model.logs[w.grams[2]]
    out = np.add.reduceat(letters, w.first, axis=0)
    out[~model.candidates[w.script]] += EXCLUDED
    return out


def labelled(s: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word under the switching penalty; texts of a batch advance together, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    n, k = sizes[order], s.shape[1]
    base = (np.cumsum(sizes) - sizes)[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")
    kind = np.int8 if k < 128 else np.int32
    back = np.empty(s.shape, dtype=kind)
    own = np.arange(k, dtype=kind)[None, :]
    final = np.zeros((len(n), k), dtype=np.float64)
    delta = np.zeros((len(n), k))
    for t in range(longest):
        m = active[t]
        rows = base[:m] + t
        final[m : len(delta)] = delta[m:]
        delta = delta[:m]
        if t:
            top = delta.argmax(1)
            best = delta[np.arange(m), top][:, None] - switch
            stay = delta >= best
            back[rows] = np.where(stay, own, top[:, None].astype(kind))
            delta = np.where(stay, delta, best)
        delta = delta + s[rows]
    final[: len(delta)] = delta
    labels = np.zeros(len(s), dtype=kind)
    now = final.argmax(1).astype(kind)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        rows = base[:m] + t
        labels[rows] = now[:m]
        if t:
            now[:m] = back[rows, now[:m]]
    return labels


def identified(documents: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred, score (share of the letters), spans (start, end in code points, lang) of every row.

    A text without letters, an empty one or null is ``und`` with score 0 and no spans. Ties go to the first language by name.
    """
    k = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for group in kernel.chunks(texts, 2 << 20):
                found: list[tuple] = []
                own = [texts[i] for i in group]
                for part in kernel.chunks(own, 1 << 19):
                    w = cut([own[i] for i in part])
                    found.append((scores(w, model), w.text + part[0], w.start - _offsets(own, part)[w.text], w.size))
                s, text, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
                sizes = np.bincount(text, minlength=len(own))
                label = labelled(s, sizes).astype(np.int64) if k else np.zeros(0, dtype=np.int64)
                letters = np.bincount(text * max(k, 1) + label, weights=size, minlength=len(own) * max(k, 1)).reshape(len(own), -1)
                total = letters.sum(1)
                best = np.where((total > 0) & (k > 0), letters.argmax(1), k)
                share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0) if k else np.zeros(len(own))
                opens = np.ones(len(label), dtype=bool)
                opens[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(opens)
                last = np.append(at[1:], len(label)) - 1
                offsets = np.searchsorted(text[at], np.arange(len(own) + 1)).astype(np.int32)
                ends = (start + size)[last] if len(at) else np.zeros(0, dtype=np.int64)
                spans = pa.StructArray.from_arrays([pa.array(start[at], pa.int32()), pa.array(ends, pa.int32()), pa.array(names[label[at]], pa.string())], names=["s", "e", "lang"])
                own_columns = [c.slice(group[0], len(group)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own_columns, pa.array(names[best], pa.string()), pa.array(share), pa.ListArray.from_arrays(offsets, spans)], names=[*carry, "lang_pred", "score", "spans"])

    common.reachable(documents.sparkSession)
    rows, kinds = common.carried(documents, carry)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, spans array<struct<s:int,e:int,lang:string>>")


def _offsets(texts: list[str], part: list[int]) -> np.ndarray:
    sizes = np.array([len(texts[i]) + 1 for i in part])
    return np.cumsum(sizes) - sizes


def held_out() -> Column:
    return common.fold_is("doc_id", 3, 1)


def cross_fitted(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a model of the rows outside the held-out fold, applied to all rows."""
    docs = documents.select("doc_id", "text", "lang")
    model = fitted(docs.where(~held_out()))
    return identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
