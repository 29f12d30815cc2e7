"""Vectorised text kernel: 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for key, base in (("p", _P), ("q", _P_INV)):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            _powers[key] = np.multiply.accumulate(t)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _block_hashes(b: np.ndarray, tagged: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a lower-cased block that no word crosses; tagged: the low 5 bits are its bytes, 31 at most."""
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, dtype=U64)
    p, q = _power_tables(len(b) + 1)
    c = np.zeros(len(b) + 1, dtype=U64)
    np.cumsum((b.astype(U64) + U64(1)) * p[: len(b)], out=c[1:])
    raw = (c[ends] - c[starts]) * q[starts]
    size = (ends - starts).astype(U64)
    h = mix(raw + size * U64(0xD6E8FEB86659FD93))
    return starts, (h & ~U64(31)) | np.minimum(size, U64(31)) if tagged else h


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """A long text in pieces that no word crosses."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < at:
                later = [i for i in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
                cut = min(later, default=len(data) - 1)
            end = cut + 1
        yield data[at:end]
        at = end


def word_hashes(texts: list[bytes], lower: bool = True, block: int = 1 << 20, tagged: bool = False) -> list[np.ndarray]:
    """For each UTF-8 text the hashes of its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), in order."""
    out: list[np.ndarray] = [np.zeros(0, dtype=U64)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        if group:
            joined = np.frombuffer(b"\n".join(texts[i] for i in group), dtype=np.uint8)
            starts, h = _block_hashes(_LOWER[joined] if lower else joined, tagged)
            bounds = np.cumsum([len(texts[i]) + 1 for i in group])
            cuts = np.searchsorted(starts, bounds)
            for i, part in zip(group, np.split(h, cuts[:-1]), strict=True):
                out[i] = part
            group.clear()

    for i, t in enumerate(texts):
        if len(t) > block:
            parts = [np.frombuffer(x, dtype=np.uint8) for x in _pieces(t, block)]
            out[i] = np.concatenate([_block_hashes(_LOWER[x] if lower else x, tagged)[1] for x in parts])
            continue
        if held + len(t) > block:
            flush()
            held = 0
        group.append(i)
        held += len(t) + 1
    flush()
    return out


def chunks(texts: list[bytes], most: int) -> Iterator[list[int]]:
    """Indices of the texts in runs of about ``most`` bytes."""
    run: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(t)
    if run:
        yield run


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of fewer words, the whole sequence as one; of none, empty."""
    if not len(h):
        return h
    mult = U64(0xC2B2AE3D27D4EB4F)
    n = len(h) - k + 1
    if n < 1:
        x = U64(len(h)) * np.ones(1, dtype=U64)
        for v in h:
            x = x * mult + v
        return mix(x)
    x = np.full(n, k, dtype=U64)
    for i in range(k):
        x = x * mult + h[i : i + n]
    x = mix(x)
    x.sort()
    keep = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
