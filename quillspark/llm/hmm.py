"""Hidden Markov language model over words.

Tokens are hashed words and an end per text. Counts of all training tokens are grouped in Spark. Every token with
``HEAD_COUNT`` training tokens has emissions of its own, whatever the table's size; the others share one class per
word length, where a word has its add-one share. The head (the most frequent tokens, never more than ``HEAD``) goes
to every task; emissions of the other tokens stay in a table, and a join by token brings them to blocks of texts.

Baum-Welch: each pass runs over all training texts, with forward and backward values carried over whole texts;
sums are added up per partition or token, then in Spark. It ends once a pass raises the likelihood of a token by
less than ``GAIN`` (log10) over the pass before, and after ``PASSES`` passes in any case. Scoring is the scaled forward recursion over the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernel

STATES, PASSES, SEGMENT = 4, 3, 64
#: Tokens whose expectations are held at a time.
RUN = 1 << 17
#: log10 per token.
GAIN = 1e-3
HEAD, HEAD_COUNT = 1 << 20, 5
#: Steps of the counts, per doubling, at one of which the head ends.
STEPS = 8
CLASSES = 32
#: Tokens without a training count, per state, that smooth the emissions in proportion to symbol counts.
PRIOR = 10.0
#: Distinct tokens that a task holds before it hands them on.
HELD = 2_000_000
END = np.zeros(1, dtype=np.uint64)


def tokens(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's words and one end; the low 5 bits are the word's bytes (at most 31), 0 for the end."""
    return [np.concatenate([h, END]) for h in kernel.word_hashes(texts, tagged=True)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = [], []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], names=["h", "n"])
    for batch in batches:
        texts = common.utf8(batch.column(0))
        for part in kernel.chunks(texts, 4 << 20):
            k, n = np.unique(np.concatenate(tokens([texts[i] for i in part])), return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                k, n = _summed(keys, counts)
                keys, counts = [k], [n]
                if len(k) > HELD // 2:
                    yield out()
                    keys, counts = [], []
    if keys:
        k, n = _summed(keys, counts)
        keys, counts = [k], [n]
        yield out()


def token_counts(train: DataFrame) -> DataFrame:
    """h, c of every training token; written."""
    common.reachable(train.sparkSession)
    found = train.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))
    return common.written(found, "counts")


@dataclass
class Vocabulary:
    """The head's hashes (sorted) and counts, and the classes' token and word counts."""

    keys: np.ndarray
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int
    #: Least count of the head.
    least: int = HEAD_COUNT
    #: h, c of the tokens outside the head that have emissions of their own (None: there are none), and sum(c + 0.5).
    more: DataFrame | None = None
    more_base: float = 0.0

    def __post_init__(self):
        self.places = np.searchsorted(self.keys, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(48)) if len(self.keys) else np.zeros((1 << 16) + 1, dtype=np.int64)
        self.places[-1] = len(self.keys)
        self.most = int(np.diff(self.places).max())

    @property
    def symbols(self) -> int:
        return len(self.keys) + CLASSES

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Symbol of each token: its place in the head, or the head's size plus its class."""
        out = (len(self.keys) + (h & np.uint64(31)).astype(np.int64)).astype(np.int64)
        bucket = (h >> np.uint64(48)).astype(np.int64)
        low, high = self.places[bucket], self.places[bucket + 1]
        for _ in range(max(1, self.most.bit_length() + 1) if len(self.keys) else 0):
            middle = (low + high) >> 1
            below = self.keys[np.minimum(middle, len(self.keys) - 1)] < h
            open_ = low < high
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        if len(self.keys):
            at = np.minimum(low, len(self.keys) - 1)
            out = np.where(self.keys[at] == h, at, out)
        return out


def head_least(counts: DataFrame) -> int:
    """The least count, among the starts of steps, that at most ``HEAD`` tokens reach."""
    step = F.floor(F.log2("c") * STEPS).alias("step")
    sizes = counts.where(F.col("c") >= HEAD_COUNT).groupBy(step).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # at most 64 * STEPS rows
    held, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["n"]
        if held > HEAD:
            return least
        least = r["least"]
    return HEAD_COUNT


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = head_least(counts)
    head = counts.where(F.col("c") >= least).toArrow()  # at most HEAD rows
    tail = counts.where(F.col("c") < HEAD_COUNT).groupBy(F.col("h").bitwiseAND(31).alias("k")).agg(F.sum("c"), F.count("*")).collect()
    more = counts.where((F.col("c") < least) & (F.col("c") >= HEAD_COUNT))
    base = more.agg(F.sum(F.col("c") + 0.5)).first()[0]
    keys = head["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    sums = np.zeros((2, CLASSES), dtype=np.int64)
    for k, c, w in tail:
        sums[:, k] = c, w
    return Vocabulary(keys[order], head["c"].to_numpy().astype(np.int64)[order], sums[0], sums[1], n, v, least, more if base else None, base or 0.0)


@dataclass
class Chain:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    share: np.ndarray
    #: h, c, e0.. of the tokens outside the head with emissions of their own.
    more: DataFrame | None = None


EACH = [f"e{k}" for k in range(STATES)]
SUMS = [f"g{k}" for k in range(STATES)]


def _uneven(ids: np.ndarray) -> np.ndarray:
    return 0.5 + np.stack([kernel.mix(ids + np.uint64(7919 * (s + 1))) / 2.0**64 for s in range(STATES)], axis=1)


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e = (batch.column(1).to_numpy(zero_copy_only=False) + 0.5)[:, None] * _uneven(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, e.T)], names=["h", "c", *EACH])


def _shared(emit: np.ndarray, more: DataFrame | None) -> tuple[np.ndarray, DataFrame | None]:
    """Both parts of the emissions, divided by each state's sum over them."""
    total = emit.sum(0)
    if more is not None:
        more = common.written(more, "emissions")
        total = total + np.array(more.agg(*[F.sum(e) for e in EACH]).first(), dtype=float)
        path = more.written_path
        more = more.select("h", "c", *[(F.col(e) / float(t)).alias(e) for e, t in zip(EACH, total, strict=True)])
        more.written_path = path
    return emit / total, more


def begun(v: Vocabulary) -> Chain:
    """Symbol frequencies, made unequal per state by each symbol's hash; states that tend to stay."""
    base = np.concatenate([v.counts, v.class_tokens]) + 0.5
    ids = np.concatenate([v.keys, np.arange(CLASSES, dtype=np.uint64)])
    more = None if v.more is None else v.more.select("h", "c").mapInArrow(_begun, "h long, c long, " + ", ".join(f"{e} double" for e in EACH))
    emit, more = _shared(base[:, None] * _uneven(ids), more)
    even = np.full(STATES, 1 / STATES)
    return Chain(even, 0.7 * np.eye(STATES) + 0.3 / STATES, emit, even, more)


def _depths(whole: np.ndarray) -> np.ndarray:
    """Of each segment how many in a row, up to and with it, are whole."""
    at = np.arange(len(whole))
    return at - np.maximum.accumulate(np.where(whole, -1, at))


def _by_depth(depth: np.ndarray) -> Iterator[np.ndarray]:
    """Segments of depth 1, of depth 2, and so on."""
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    for low, high in zip(ends, ends[1:]):
        yield order[low:high]


def _borders(b: np.ndarray, f: np.ndarray, m: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Forward values before each segment, and backward values after it up to a factor, of a stream cut into segments.

    Segments in which no text starts (whole ones) carry values across by the product of their steps; chains of them advance together.
    """
    rows = b.shape[1]
    unit = lambda x: x / x.sum(-1, keepdims=True)
    whole = ~f.any(0)
    cut = np.flatnonzero(~whole)
    steps, place = b[:, whole], np.cumsum(whole) - 1
    through = np.repeat(np.eye(STATES)[None], steps.shape[1], 0)
    for t in range(len(b)):
        through = (through.reshape(-1, STATES) @ m.move).reshape(through.shape) * steps[t][:, None, :]
        if t % 16 == 15:  # often enough for the exponents of doubles
            through /= through.sum((1, 2))[:, None, None]
    own, starts = b[:, cut], f[:, cut]
    last = np.zeros((len(cut), STATES))
    for t in range(len(b)):
        last = unit(np.where(starts[t][:, None], m.start, last @ m.move) * own[t] + 1e-300)
    head, opens = np.ones((len(cut), STATES)), starts.argmax(0)
    for t in range(len(b) - 1, -1, -1):
        head = np.where((t < opens)[:, None], unit((own[t] * head) @ m.move.T), head)
    before, after = np.full((rows + 1, STATES), 1 / STATES), np.ones((rows + 1, STATES))
    before[cut + 1], after[cut] = last, unit(head)
    for r in _by_depth(_depths(whole)):
        before[r + 1] = unit((before[r][:, None, :] @ through[place[r]])[:, 0])
    for r in _by_depth(_depths(whole[::-1])):
        r = rows - 1 - r
        after[r] = unit((through[place[r]] @ after[r + 1][:, :, None])[:, :, 0])
    return before[:-1], after[1:]


def expected(sym: np.ndarray, first: np.ndarray, m: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected emissions (symbol, state), moves, starts and state counts of a stream of tokens, and its log10 probability.

    ``first`` marks the first token of a text, which follows no other. The stream is cut into segments that
    advance together; what crosses their borders is found first, so that results are those of whole texts.
    """
    n = len(sym)
    rows = -(-n // SEGMENT)
    pad = rows * SEGMENT - n
    s = np.pad(sym, (0, pad)).reshape(rows, SEGMENT).T
    f = np.pad(first, (0, pad), constant_values=True).reshape(rows, SEGMENT).T
    b = m.emit[s]
    if pad:
        b[SEGMENT - pad :, -1] = 1.0
    before, after = _borders(b, f, m)
    alpha, scale = np.empty_like(b), np.empty((SEGMENT, rows))
    for t in range(SEGMENT):
        prior = (before if t == 0 else alpha[t - 1]) @ m.move
        prior[f[t]] = m.start
        a = prior * b[t]
        scale[t] = a.sum(1)
        alpha[t] = a / scale[t][:, None]
    logs = float(np.log10(scale).ravel(order="F")[:n].sum())
    moves = np.zeros((STATES, STATES))
    ends = alpha[-1].copy()
    beta = after / (ends * after).sum(1)[:, None]
    gamma = alpha  # overwritten from the end
    gamma[-1] = ends * beta
    for t in range(SEGMENT - 2, -1, -1):
        w = b[t + 1] * beta / scale[t + 1][:, None]
        w[f[t + 1]] = 0.0
        moves += alpha[t].T @ w
        if t < SEGMENT - 2:
            gamma[t + 1] = alpha[t + 1] * beta
        beta = w @ m.move.T
        beta[f[t + 1]] = 1.0
    go = ~f[0][1:]
    moves += ends[:-1][go].T @ (b[0] * beta / scale[0][:, None])[1:][go]
    gamma[0] = alpha[0] * beta
    g = gamma.transpose(1, 0, 2).reshape(-1, STATES)[:n]
    emitted = np.stack([np.bincount(sym, weights=g[:, k], minlength=len(m.emit)) for k in range(STATES)], axis=1)
    return emitted, m.move * moves, g[first].sum(0), g.sum(0), logs


def _encoded(v: Vocabulary) -> Callable:
    """Blocks of texts as symbols; a token outside the head is the number of symbols plus its place in ``rare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.utf8(batch.column(1))
            for part in kernel.chunks(texts, 4 << 20):
                own = tokens([texts[i] for i in part])
                sizes, h = np.array([len(x) for x in own], dtype=np.int32), np.concatenate(own)
                sym = v.lookup(h)
                out = sym >= len(v.keys)
                rare, place = np.unique(h[out], return_inverse=True)
                sym[out] = v.symbols + place
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column(0).slice(part[0], len(part)).cast(pa.int64()), pa.array(rare.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([lists[0], pa.array([sizes.tobytes()]), pa.array([pa.compress(sym.astype(np.int32).tobytes(), "zstd", asbytes=True)]), lists[1]], names=["ids", "sizes", "sym", "rare"])

    return run


def blocks(documents: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of texts, and (block, h) of the tokens in them whose emissions are in a table."""
    rows = documents.mapInArrow(_encoded(replace(v, more=None)), "ids array<bigint>, sizes binary, sym binary, rare array<bigint>")
    rows = common.written(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")
    if v.more is None:
        return rows, None
    return rows, common.written(rows.select("block", F.explode("rare").alias("h")).join(v.more.select("h"), "h"), "uses")


def _supplied(rows: DataFrame, uses: DataFrame | None, m: Chain) -> DataFrame:
    """The blocks with the emissions of their tokens outside the head."""
    own = "array<struct<h:bigint," + ",".join(f"{e}:float" for e in EACH) + ">>"
    if uses is None:
        return rows.select("ids", "sizes", "sym", "rare", F.array().cast(own).alias("own"))
    found = uses.join(m.more, "h").groupBy("block").agg(F.collect_list(F.struct("h", *[F.col(e).cast("float").alias(e) for e in EACH])).alias("own"))
    return rows.join(found, "block", "left").select("ids", "sizes", "sym", "rare", F.coalesce("own", F.array().cast(own)).alias("own"))


def _sent(m: Chain) -> Chain:
    """The chain as tasks get it."""
    return replace(m, emit=m.emit.astype(np.float32), more=None)


def _unpacked(batch: pa.RecordBatch, v: Vocabulary, m: Chain) -> Iterator[tuple]:
    """Per block: its ids, sizes, symbols, hashes outside the head, hashes with own emissions, and a chain with those after the others."""
    for i in range(batch.num_rows):
        sizes = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int32).astype(np.int64)
        sym = np.frombuffer(pa.decompress(batch.column(2)[i].as_py(), 4 * int(sizes.sum()), "zstd"), dtype=np.int32).astype(np.int64)
        rare = batch.column(3)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
        own = batch.column(4)[i].values
        h = own.field(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        h, e = h[order], np.stack([own.field(k + 1).to_numpy(zero_copy_only=False) for k in range(STATES)], axis=1)[order].astype(np.float32)
        to = len(v.keys) + (rare & np.uint64(31)).astype(np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, rare), len(h) - 1)
            to = np.where(h[at] == rare, v.symbols + at, to)
        local = np.concatenate([np.arange(v.symbols, dtype=np.int64), to])[sym]
        yield batch.column(0)[i].values, sizes, sym, local, rare, h, replace(m, emit=np.concatenate([m.emit, e]))


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Tokens of whole texts, about ``RUN`` at a time."""
    ends = np.cumsum(sizes)
    a = 0
    while a < ends[-1]:
        i = min(int(np.searchsorted(ends, a + RUN)), len(ends) - 1)
        yield a, int(ends[i])
        a = int(ends[i])


def _pass(v: Vocabulary, m: Chain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((v.symbols, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), np.zeros(STATES), np.zeros(STATES)]
        out = lambda i, h, rows: pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), h, *(pa.array(rows[:, k], pa.float32()) for k in range(STATES))], names=["i", "h", *SUMS])
        for batch in batches:
            for _, sizes, _, sym, _, h, chain in _unpacked(batch, v, m):
                more = np.zeros((len(h), STATES))
                first = np.zeros(len(sym), dtype=bool)
                first[np.cumsum(sizes) - sizes] = True
                for a, b in _runs(sizes):
                    emitted, *others = expected(sym[a:b], first[a:b], chain)
                    more += emitted[v.symbols :]
                    for x, y in zip(total, [emitted[: v.symbols], *others], strict=True):
                        x += y
                if len(h):
                    yield out(np.full(len(h), v.symbols), pa.array(h.view(np.int64)), more)
        rows = np.concatenate([total[1], *(x[None] for x in total[2:]), total[0]])
        ids = np.concatenate([np.arange(-STATES - 3, 0), np.arange(v.symbols)])
        some = np.flatnonzero(rows.any(1))
        yield out(ids[some], pa.nulls(len(some), pa.int64()), rows[some])

    return run


def trained(train: DataFrame, v: Vocabulary, passes: int = PASSES) -> Chain:
    """Baum-Welch over all training texts, at most ``passes``; the sums that reach the driver have a row per symbol of the head and class."""
    m = begun(v)
    if not passes:
        return m
    base = np.concatenate([v.counts, v.class_tokens]) + 0.5
    part = PRIOR / (base.sum() + v.more_base)
    rows, uses = blocks(train.select(F.lit(None).cast("long").alias("doc_id"), "text"), v)
    slim = replace(v, more=None)
    reached = -math.inf
    for _ in range(passes):
        found = _supplied(rows, uses, m).mapInArrow(_pass(slim, _sent(m)), "i long, h long, " + ", ".join(f"{g} float" for g in SUMS))
        found = found.groupBy("i", "h").agg(*[F.sum(g).alias(g) for g in SUMS])
        found = found if v.more is None else common.written(found, "sums")
        head = found.where("h is null").drop("h").toArrow()
        got = np.zeros((v.symbols + STATES + 3, STATES))
        at = head["i"].to_numpy() + STATES + 3
        for k, g in enumerate(SUMS):
            got[at, k] = head[g].to_numpy()
        del head
        move, start, share = got[:STATES] + 0.1, got[STATES] + 0.1, got[STATES + 1] + 0.1
        more = None
        if v.more is not None:
            more = v.more.join(found.where("h is not null").drop("i"), "h").select("h", "c", *[(F.col(g) + F.lit(part) * (F.col("c") + 0.5)).alias(e) for g, e in zip(SUMS, EACH, strict=True)])
        emit, more = _shared(got[STATES + 3 :] + part * base[:, None], more)
        if more is not None:
            common.dropped(found, m.more)
        del found
        train.sparkSession._jvm.System.gc()  # Spark deletes the shuffle files of plans that the driver has let go
        m = Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit, share / share.sum(), more)
        before, reached = reached, got[STATES + 2, 0] / max(1, v.tokens)
        if reached - before < GAIN:
            break
    common.dropped(*[t for t in (rows, uses) if t is not None])
    return m


def forward(sym: np.ndarray, sizes: np.ndarray, m: Chain) -> np.ndarray:
    """log10 probability of each text's symbols (at least one each); texts advance together, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    base = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
    logs = np.zeros(len(n))
    for t, k in enumerate(active):
        a = (np.repeat(m.start[None], k, 0) if t == 0 else alpha[:k] @ m.move) * m.emit[sym[base[:k] + t]]
        scale = a.sum(1)
        logs[:k] += np.log10(scale)
        alpha = a / scale[:, None]
    out = np.empty(len(n))
    out[order] = logs
    return out


def _scored(v: Vocabulary, m: Chain) -> Callable:
    logs = np.log10((np.concatenate([v.counts, np.zeros(CLASSES)]) + 1) / (v.tokens + v.words + 1))
    logs[len(v.keys) :] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, sym, local, rare, _, chain in _unpacked(batch, v, m):
                out = sym >= v.symbols
                text = np.repeat(np.arange(len(sizes)), sizes)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text[out], minlength=len(sizes)))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(offsets, pa.array(rare[sym[out] - v.symbols].view(np.int64)))
                base = np.bincount(text, weights=np.where(out, 0.0, logs[np.where(out, 0, sym)]), minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(base), pa.array(forward(local, sizes, chain)), tail], names=["doc_id", "n_tokens", "base", "model", "tail"])

    return run


def scored(documents: DataFrame, counts: DataFrame, v: Vocabulary, m: Chain) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``documents`` (doc_id, text); a null text is empty."""
    common.reachable(documents.sparkSession)
    whole, uses = blocks(common.narrow(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), v)
    found = _supplied(whole, uses, m)
    rows = found.mapInArrow(_scored(replace(v, more=None), _sent(m)), "doc_id long, n_tokens long, base double, model double, tail array<bigint>")
    rows = common.written(rows.withColumn("uid", F.monotonically_increasing_id()), "scored")
    common.dropped(*[t for t in (whole, uses) if t is not None])
    each = rows.select("uid", F.explode("tail").alias("h")).join(counts.where(F.col("c") < v.least), "h", "left")
    c = F.coalesce("c", F.lit(0)) + 1
    whole = [math.log10(t + w + 1) for t, w in zip(v.class_tokens.tolist(), v.class_words.tolist(), strict=True)]
    part = F.log10(c) - F.get(F.array(*[F.lit(x) for x in whole]), F.col("h").bitwiseAND(31).cast("int"))
    sums = each.groupBy("uid").agg(F.count("c").alias("known"), F.sum(F.log10(c / F.lit(float(v.tokens + v.words + 1)))).alias("more"), F.sum(F.when(c <= HEAD_COUNT, part)).alias("inside"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("uid", "doc_id", "n_tokens", "base", "model", F.size("tail").alias("rare")).join(sums, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_tokens") - F.col("rare") + zero("known")).alias("n_known"),
        (F.col("base") + zero("more")).alias("base_score"),
        (F.col("model") + zero("inside")).alias("score"),
    )


def held_out() -> Column:
    return common.fold_is("doc_id", 7, 2)


def language_model(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: trained outside the held-out fold, applied to all rows.

    Rows that repeat a doc_id are texts of their own. Without training rows every token has probability 1 in the base.
    """
    docs = common.narrow(documents, "doc_id", "text")
    train = docs.where(~held_out())
    counts = token_counts(train)
    v = vocabulary(counts)
    out = scored(docs, counts, v, trained(train, v))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")
