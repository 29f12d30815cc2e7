"""BPE encoding and decoding by speculation and verification.

Texts split at ASCII white space into chunks; a chunk's pieces (the tokenizer's own pre-tokens) depend on
the chunk alone. For pieces not seen before, greedy longest match proposes tokens; all adjacent pairs
of a batch are tested at once against a table of compatible pairs (a pair is compatible if merging
its joint text gives the same two tokens, which for all adjacent pairs makes the proposal the exact
result); only pieces with an incompatible pair are merged exactly, rank by rank.

Supports tokenizer files of one shape: BPE with a word-end suffix, NFC and lower case, byte-level alphabet.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of a worker's chunk cache. Once full, new chunks are held for their batch only; after four times as many, it starts anew.
CACHE = 600_000
#: White space of the tokenizer's patterns (Unicode White_Space), fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """Encodes chunks of text as the tokenizer file at ``path`` says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or model["ignore_merges"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a word-end BPE without decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 0))
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE))
        self.cut = re.compile("|".join(f"({re.escape(x)})" for x in self.special)) if self.special else None
        self.bytes = byte_alphabet()
        self.known = np.zeros(0, dtype=np.int64)
        self.fits = np.zeros(0, dtype=bool)
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.blank = False
        self.text = [x.encode() for x in self.token]
        self.number = [b"%d" % i for i in range(len(self.token))]
        self.mark = os.path.commonprefix(list(self.special))
        self.pieces_out: dict[str, tuple[bytes, bytes]] = {}
        self.forget()

    def symbols(self, token: str) -> list[str]:
        """Single characters; the word-end suffix belongs to the last."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*token]

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact BPE: join the adjacent pair of the lowest rank, leftmost first, until none is left."""
        rank, none = self.rank.get, 1 << 40
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def long_merged(self, symbols: list[str]) -> list[str]:
        """``merged`` for long pieces: a heap of pairs over a linked list."""
        import heapq

        n = len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        alive: list[str | None] = list(symbols)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if alive[i] != x or j >= n or alive[j] != y:
                continue
            alive[i], alive[j] = x + y, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n and (r := self.rank.get((alive[k], alive[m]))) is not None:
                    heapq.heappush(heap, (r, k, alive[k], alive[m]))
        return [x for x in alive if x is not None]

    def exact(self, piece: str) -> tuple[int, ...]:
        s = self.symbols(piece)
        return tuple(self.vocab[t] for t in (self.merged(s) if len(s) < 64 else self.long_merged(s)) if t in self.vocab)

    def greedy(self, piece: str) -> tuple[int, ...] | None:
        """Longest vocabulary entry first; None where the rest matches none."""
        out, i, n = [], 0, len(piece)
        whole = n - len(self.suffix)
        get, longest = self.vocab.get, self.longest.get
        while i < n:
            for j in range(min(n, i + longest(piece[i : i + 2], 1)), i, -1):
                if (j < whole or j == n) and (t := get(piece[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return tuple(out)

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each key (left id << 32 | right id, or -1 - id for a lone token) whether the proposal stands; new keys are merged once."""
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = distinct if not len(self.known) else distinct[self.known[at] != distinct]
        if len(new):
            answers = []
            for k in new.tolist():
                tokens = [self.token[-1 - k]] if k < 0 else [self.token[k >> 32], self.token[k & 0xFFFFFFFF]]
                s = [x for t in tokens for x in self.symbols(t)]
                answers.append((self.merged(s) if len(s) < 64 else self.long_merged(s)) == tokens)
            places = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, places, new), np.insert(self.fits, places, answers)
            at = np.searchsorted(self.known, distinct)
        return self.fits[at][back]

    def learn_pieces(self, pieces: list[str]) -> None:
        """Put new pieces into the cache: propose, verify all pairs together, merge what fails."""
        proposals = [self.greedy(p) for p in pieces]
        keys: list[int] = []
        owner: list[int] = []
        for i, ids in enumerate(proposals):
            if ids:
                found = [-1 - ids[0]] if len(ids) == 1 else [a << 32 | b for a, b in zip(ids, ids[1:])]
                keys += found
                owner += [i] * len(found)
        right = np.ones(len(pieces), dtype=bool)
        if keys:
            right[np.array(owner)[~self.compatible(np.array(keys, dtype=np.int64))]] = False
        number, text = self.number, self.text
        for p, ids, fits in zip(pieces, proposals, right.tolist(), strict=True):
            if not ids or not fits:
                ids = self.exact(p)
            self.pieces_out[p] = b" ".join([number[i] for i in ids]), b" ".join([text[i] for i in ids])

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk in the byte-level alphabet; special tokens as they are."""
        if self.mark and self.mark in chunk:
            out: list[str] = []
            for part in self.cut.split(chunk):
                if part in self.special:
                    out.append(part)
                elif part:
                    out += self.plain(part)
            return out
        return self.plain(chunk)

    def plain(self, part: str) -> list[str]:
        suffix = self.suffix
        if part.isascii():
            part = part.lower()
            if part.isalpha():
                return [part + suffix]
            if part.isprintable():
                return [p + suffix for p in self.pieces.findall(part)]
        part = unicodedata.normalize("NFC", part)
        part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
        get = self.bytes.__getitem__
        return ["".join(map(get, p.encode())) + suffix for p in self.pieces.findall(part)]

    def learn(self, chunks: list[bytes]) -> None:
        split = [self.split(c.decode()) for c in chunks]
        out = self.pieces_out
        self.learn_pieces(list(set().union(*split).difference(out)))
        ids, decoded = self.ids, self.decoded
        for c, s in zip(chunks, split, strict=True):
            if len(s) == 1:
                ids[c], decoded[c] = out[s[0]]
            else:
                found = [x for p in s if (x := out[p])[0]]
                ids[c], decoded[c] = b" ".join([x[0] for x in found]), b" ".join([x[1] for x in found])
            self.blank |= not ids[c]

    def encode(self, texts: list[str | bytes]) -> tuple[list[bytes], list[bytes]]:
        """Decimal ids joined by one space, and the decoded text, of each text (a string, or its UTF-8)."""
        chunks = [(t if isinstance(t, bytes) else t.encode("utf-8", "replace")).split() for t in texts]
        new = set().union(*chunks).difference(self.ids)
        known = len(self.pieces_out)
        if new:
            self.learn(list(new))
        out = []
        for table in (self.ids, self.decoded):
            get = table.__getitem__
            out.append([b" ".join(filter(None, map(get, c)) if self.blank else map(get, c)) for c in chunks])
        if len(self.ids) > CACHE:
            self.passing += len(new)
            if self.passing > 4 * CACHE:
                self.forget()
            else:
                for c in new:
                    del self.ids[c], self.decoded[c]
                if len(self.pieces_out) > CACHE:
                    for p in list(itertools.islice(reversed(self.pieces_out), len(self.pieces_out) - known)):
                        del self.pieces_out[p]
        return out[0], out[1]

    def forget(self) -> None:
        self.ids.clear()
        self.decoded.clear()
        self.passing = 0
        self.pieces_out = {t: (self.number[i], self.text[i]) for t, i in self.special.items()}


def codec(path: str) -> Codec:
    return common.worker_model(("bpe", path), lambda: Codec(path))


def encoded(documents: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, ids (decimal, joined by one space), decoded of every row; a null or blank text has empty ones.

    ``path``: the tokenizer's JSON file on every worker. Memory: the cache, and batches of about 1 MB of text.
    """
    from . import kernel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = common.utf8(batch.column(0))
            for part in kernel.chunks(texts, 1 << 20):
                ids, decoded = own.encode([texts[i] for i in part])
                yield pa.RecordBatch.from_arrays([*(c.slice(part[0], len(part)) for c in batch.columns[1:]), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (ids, decoded))], names=[*carry, "ids", "decoded"])

    common.reachable(documents.sparkSession)
    rows, kinds = common.carried(documents, carry)
    return rows.mapInArrow(run, f"{kinds}, ids string, decoded string")


def token_count(ids):
    """Number of ids in a column of ``encoded``."""
    return F.when(F.length(ids) == 0, F.lit(0)).otherwise(F.length(ids) - F.length(F.translate(ids, " ", "")) + 1).cast("long")


def digests(codes: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encoded``'s result."""
    return codes.select("doc_id", token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
