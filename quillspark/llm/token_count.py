"""Token counts of a unigram tokenizer without making tokens.

For each distinct word an Aho-Corasick automaton lists every vocabulary piece that ends at each
character; dynamic programming over the ends carries the best score and the number of pieces on the best
path. Ties keep the earliest start, and a character that is no piece of its own costs the least score
less 10 and counts its UTF-8 bytes, as the tokenizers library's unigram model with byte fallback does.

Words are the pre-tokens of a Metaspace pre-tokenizer (a space, written as U+2581, begins a word, and one is put
before a text). Line feeds, which no piece holds, cut words further: a best path has to stop there.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, kernel

MARK = "▁"
#: Entries of a worker's word cache; it's emptied when full.
CACHE = 500_000
UNKNOWN_PENALTY = 10.0


class Counts:
    def __init__(self, pieces: list[tuple[str, float]]):
        """``pieces``: every entry with its score; control and byte entries match no text."""
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces:
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cuts = not any("\n" in p for p, _ in pieces)
        self.seen: dict[str, int] = {}

    def best(self, word: str) -> int:
        """Pieces on the best path through a word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(word):
            ends[end].append(hit)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            most, pieces, single = float("-inf"), 0, False
            for size, s in sorted(ends[end], reverse=True):
                single |= size == 1
                if score[end + 1 - size] + s > most:
                    most, pieces = score[end + 1 - size] + s, count[end + 1 - size] + 1
            if not single and score[end] + self.unknown > most:
                most, pieces = score[end] + self.unknown, count[end] + len(word[end].encode("utf-8", "replace"))
            score[end + 1], count[end + 1] = most, pieces
        return count[n]

    def word(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            if self.cuts and "\n" in word and word != "\n":
                parts = word.split("\n")
                found = sum(self.word(p) for p in parts if p) + (len(parts) - 1) * self.word("\n")
            else:
                found = self.best(word)
            self.seen[word] = found
        return found

    def text(self, text: str) -> int:
        if not text:
            return 0
        if len(self.seen) > CACHE:
            self.seen.clear()
        text = text.replace(" ", MARK)
        words = text.split(MARK)[1 if text[0] == MARK else 0 :]
        get, out = self.seen.get, 0
        for w in words:
            w = MARK + w
            n = get(w)
            out += self.word(w) if n is None else n
        return out


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, byte and control entries included, for the least score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counts(path: str) -> Counts:
    return common.worker_model(("counts", path), lambda: Counts(vocabulary(path)))


def counted(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of every row; a null or empty text has none. ``path``: the vocabulary file on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in kernel.chunks(texts, 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part[0], len(part)), pa.array([own.text(texts[i]) for i in part], pa.int64())], names=["doc_id", "n_tokens"])

    common.reachable(documents.sparkSession)
    return common.narrow(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
