"""Near-duplicate documents by SetSketch registers.

Each document's set of five-word shingles becomes ``REGISTERS`` truncated minima of exponentially
distributed hashes, on an exponentially spaced scale (SetSketch). Registers merge by maximum. Bands of
equal registers propose pairs; the pairwise likelihood of the counts of larger, smaller and equal
registers rejects what can't reach the similarity; full shingle sets confirm the rest.

Groups: documents with equal sets collapse into one node first. Within a band's bucket, members are
compared with leaders (of a salted part of the bucket, and of the bucket), not with each other. Then
only members outside the bucket's main component meet the bucket's other components, each pair in its
first common band. That join's condition holds the sizes, a finer sketch of one bit per register and, for
members that pass these with any other, the full sets: of a bucket's pairs none but links become rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, kernel

SIMILARITY = (75, 100)
SHINGLE = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Of the sketch: base, rate of the exponential distribution, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair goes if its best likelihood beats the best at a linked similarity by this log ratio (about 5.5 sigma).
REJECT = 15.0
#: Registers of the fine sketch (one bit each), and most unequal bits of a pair that may link: the mean at 0.75, 128, and 4.5 sigma.
FINE, FINE_UNEQUAL = 1024, 176
#: Sub-leaders per bucket.
SALTS = 8
#: Leaders with which a member is compared in the first step.
LEADERS = 4
#: Rows of small columns per task.
ROWS_PER_TASK = 50_000
#: Rows of small columns that a set of shingles counts for.
SET_ROWS = 30
#: Most document ids that are broadcast (8 bytes each); beyond it, a shuffled join takes over.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 63, REGISTERS + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, REGISTERS + FINE, dtype=np.uint64) * np.uint64(2)


def registers(sets: list[np.ndarray], first: int = 0, count: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets of 64-bit hashes: ``count`` of them from the hash function ``first`` on."""
    x = np.concatenate(sets)
    offsets = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((count, len(sets)), dtype=np.uint64)
    t = np.empty_like(x)
    for i in range(count):
        np.multiply(x, _A[first + i], out=t)
        t += _B[first + i]
        np.minimum.reduceat(t, offsets, out=least[i])
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1.0 - np.log(value) / math.log(BASE)), 0, TOP).astype(np.uint16)


def _log_p(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger by the first set, given the share x of elements only there."""
    return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1.0)


def likelihood(up: np.ndarray, down: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log likelihood of a Jaccard similarity, jointly from larger, smaller and equal registers; u + v = 1."""
    p, q = _log_p(u - v * j), _log_p(v - u * j)
    return up * np.log(p) + down * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1.0))


def may_link(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Pairs whose registers and exact set sizes leave a similarity of 0.75 possible."""
    num, den = SIMILARITY
    fits = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    up, down = (ra > rb).sum(1).astype(float), (ra < rb).sum(1).astype(float)
    same = ra.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)
    every = np.stack([likelihood(up, down, same, u, v, g * most) for g in grid])
    linked = np.stack([likelihood(up, down, same, u, v, np.maximum(num / den, g * most)) for g in grid[70:]])
    return fits & (every.max(0) - linked.max(0) <= REJECT)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = common.utf8(batch.column(1))
        for run in kernel.chunks(texts, 1 << 20):
            sets = [kernel.shingle_set(h, SHINGLE) for h in kernel.word_hashes([texts[i] for i in run])]
            full = [s for s in sets if len(s)]
            regs = iter(registers(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in run], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "regs"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, registers; the last two null for an empty set."""
    common.reachable(docs.sparkSession)
    return common.narrow(docs, "doc_id", "text").mapInArrow(_sketched, "doc_id long, n_shingles long, digest binary, regs binary")


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(values.view(np.int64)))


def _listed(fine: bool) -> Callable:
    """Of each text with words its digest and, as longs, its set or the fine sketch of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.utf8(batch.column(1))
            for part in kernel.chunks(texts, 1 << 19):
                sets = [kernel.shingle_set(h, SHINGLE) for h in kernel.word_hashes([texts[i] for i in part])]
                some = [i for i, s in zip(part, sets, strict=True) if len(s)]
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                if fine:
                    bits = np.ascontiguousarray(np.packbits(registers(sets, REGISTERS, FINE) & 1, axis=1)).view(np.int64)
                    values = _lists(bits.ravel(), [FINE // 64] * len(sets))
                else:
                    values = _lists(np.concatenate(sets), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array([_digest(s) for s in sets], pa.binary()), values], names=["doc_id", "digest", "s"])

    return run


def _of_nodes(docs: DataFrame, nodes: DataFrame, fine: bool = False) -> DataFrame:
    """node, s (array of longs) of ``nodes`` (node, doc_id, digest); a document's other texts of the same id don't have that digest."""
    ids = nodes.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    found = texts.mapInArrow(_listed(fine), "doc_id long, digest binary, s array<bigint>")
    return found.join(nodes, ["doc_id", "digest"]).select("node", "s").dropDuplicates(["node"])


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            keep = may_link(_as_registers(batch.column(2)), _as_registers(batch.column(3)), na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _similar(x: str, y: str) -> Column:
    """Sets (arrays of distinct longs) that are similar enough."""
    num, den = SIMILARITY
    both, total = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return both * (num + den) >= total * num


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of candidate pairs (a < b), those whose sets are similar enough; written."""
    ra = nodes.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    rb = nodes.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(ra, "a").join(rb, "b").select("a", "b", "ra", "rb", "na", "nb")
    likely = common.written(_packed(both, 4 * pairs.count()).mapInArrow(_estimated, "a long, b long"), "likely")
    ids = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    size = likely.count()
    sets = _of_nodes(docs, nodes.join(ids, "node", "left_semi").select("node", "doc_id", "digest"))
    sets = common.written(_packed(sets, SET_ROWS * size), "sets")
    sa, sb = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    out = common.written(_packed(likely.join(sa, "a").join(sb, (likely["b"] == sb["b"]) & _similar("sa", "sb")).select("a", likely["b"]), SET_ROWS * size), "links")
    common.dropped(likely, sets)
    return out


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """At most one partition per ``ROWS_PER_TASK`` of about ``rows`` rows, and eight: a small table isn't dealt to as many tasks as a large one. Never more than there are."""
    return df.coalesce(8 + rows // ROWS_PER_TASK)


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) of every id in the links (a, b): least neighbours and pointer jumps, to a fixed point."""
    size = 2 * links.count()
    both = common.written(_packed(links.select("a", "b").union(links.select("b", "a")).distinct(), size), "edges")
    now = common.written(_packed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), size), "labels")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        nearer = now.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("via"))
        root = now.select(F.col("id").alias("via"), F.col("comp").alias("root"))
        step = nearer.join(root, "via").select("id", F.least("via", "root").alias("comp"), (F.least("via", "root") != F.col("was")).alias("moved"))
        after = common.written(_packed(step, size), "labels")
        moved = after.where("moved").limit(1).count()
        common.dropped(now)
        now = after
        if not moved:
            common.dropped(both)
            return now.select("id", "comp")


def _same_ids(member: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that repeat a doc_id."""
    ends = member.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a != last").select("doc_id", "a")
    return member.join(ends, "doc_id").where("node != a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text).

    Rows without words, and rows with a null text, are linked with nothing: component_id is their doc_id.
    Nodes of the graph are distinct shingle sets; rows that repeat a doc_id link their sets, and so are in one
    component. A null doc_id takes part through equal sets only; its component_id is the smallest doc_id of
    that set's component, or null, and it's kept only if that is null.
    """
    docs = common.narrow(documents, "doc_id", "text")
    sig = common.written(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = sig.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))).alias("node"))
    slim = sig.select("doc_id", "digest", "n_shingles")
    none = F.lit(None).cast("long")
    member = slim.join(classes, "digest").select("doc_id", "n_shingles", "rep", "node").union(slim.where("digest is null").select("doc_id", "n_shingles", none, none))
    rows = sig.count()
    member = common.written(_packed(member, rows), "members")
    leads = classes.where("node is not null").select("node", "rep")
    nodes = sig.withColumnRenamed("row", "node").join(leads, "node").select("node", "rep", "doc_id", "digest", "n_shingles", "regs")
    nodes = common.written(_packed(nodes, 4 * rows), "nodes")
    common.dropped(sig)

    width = 2 * ROWS
    each = F.sequence(F.lit(0), F.lit(BANDS - 1))
    keys = F.transform(each, lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    bands = nodes.select("node", F.posexplode(keys).alias("band", "key")).withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.lit(SALTS)))
    parts = bands.groupBy("key", "salt").agg(F.min("node").alias("sub"), F.count("*").alias("n"))
    tops = parts.groupBy("key").agg(F.min("sub").alias("top"), F.sum("n").alias("total")).where("total > 1").drop("total")
    leaders = parts.join(tops, "key").select("key", "salt", "sub", "top")
    shared = common.written(_packed(bands.join(leaders, ["key", "salt"]).select("key", "band", "node", "sub", "top"), rows * BANDS), "shared")
    held = shared.count()
    first = shared.where("node != sub").select(F.col("sub").alias("a"), F.col("node").alias("b")).union(shared.where("sub != top and node = sub").select(F.col("top").alias("a"), F.col("sub").alias("b")))
    # Of a member's leaders (at most two per band) those of most bands; what this leaves untested is left to the exact step below.
    best = W.partitionBy("b").orderBy(F.desc("n"), "a")
    first = first.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(best)).where(F.col("i") <= LEADERS).select("a", "b")
    first = common.written(_packed(first, held), "first")
    found = common.written(_packed(_links(first, nodes, docs).union(_same_ids(member)), held), "found")
    comps = components(found)

    owner = F.coalesce("comp", "node")

    def unsettled(comps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the buckets that still have more than one component, and each such bucket's main one."""
        marked = shared.select("key", "band", "node").join(comps.withColumnRenamed("id", "node"), "node", "left").select("key", "band", "node", owner.alias("comp"))
        mixed = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
        rows = common.written(_packed(marked.join(mixed, "key", "left_semi"), held), "open")
        sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
        return rows, sizes.groupBy("key").agg(F.max_by(F.struct("comp", "low", "high"), F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"), "m.low", "m.high")

    # Members outside a bucket's main component are first compared with two members of that, to settle most of them cheaply.
    before, main = unsettled(comps)
    ends = before.join(main, "key").where("comp != main").select("node", F.explode(F.array("low", "high")).alias("y")).where("node != y")
    ends = ends.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b"), "node").groupBy("a", "b", "node").agg(F.count("*").alias("n"))
    ends = ends.withColumn("i", F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "a", "b"))).where(F.col("i") <= LEADERS).select("a", "b").distinct()
    second = common.written(_packed(ends.join(first, ["a", "b"], "left_anti"), held), "second")
    found = common.written(_packed(found.union(_links(second, nodes, docs)), held), "found")
    comps = components(found)
    open_, main = unsettled(comps)
    fine = _of_nodes(docs, nodes.join(open_.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "digest"), fine=True)
    about = nodes.select("node", F.col("n_shingles").alias("n"), keys.alias("keys"))
    full = common.written(_packed(open_.join(fine.withColumnRenamed("s", "fine"), "node").join(about, "node").join(main.select("key", "main"), "key"), 4 * held), "fine")
    common.dropped(shared, before, open_, first, second)
    comps = _late(docs, nodes, full, found, comps)
    low = comps.withColumnRenamed("id", "node").join(nodes.select("node", "rep"), "node")
    least = low.groupBy("comp").agg(F.min("rep").alias("least"))
    labels = common.written(_packed(low.join(least, "comp").select("node", "least"), rows), "labels")
    common.dropped(full, nodes, found)
    some, alone = member.where("rep is not null"), member.where("rep is null")
    result = some.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    result = result.union(alone.select("doc_id", "n_shingles", "doc_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _late(docs: DataFrame, nodes: DataFrame, full: DataFrame, found: DataFrame, comps: DataFrame) -> DataFrame:
    """The components once members outside the main component of a bucket have met its other components.

    Two semi-joins keep the members that the sizes and the fine sketch pair with any other; only those get their
    sets, which decide in the conditions of the joins after that. Whether a member links with the main component
    is a semi-join too; links between the other components, as they are by then, are the only pairs that become
    rows. The main component never meets itself.
    """
    num, den = SIMILARITY
    unequal = sum((F.bit_count(F.get("x.fine", F.lit(k)).bitwiseXOR(F.get("y.fine", F.lit(k)))) for k in range(FINE // 64)), F.lit(0))
    untested = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    sized = (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)
    earliest = F.array_position(F.zip_with("x.keys", "y.keys", lambda a, b: a == b), True) == F.col("x.band") + 1
    meet = untested & sized & (unequal <= FINE_UNEQUAL) & earliest
    outside = full.where("comp != main")
    x = common.written(outside.alias("x").join(full.alias("y"), meet, "left_semi"), "outside")
    y = common.written(full.alias("y").join(x.alias("x"), meet, "left_semi"), "inside")
    need = x.select("node").union(y.select("node")).distinct()
    size = SET_ROWS * (x.count() + y.count())
    sets = common.written(_packed(_of_nodes(docs, nodes.join(need, "node", "left_semi").select("node", "doc_id", "digest")), size), "sets")
    like = meet & _similar("x.s", "y.s")
    full_x, full_y = (common.written(_packed(t.join(sets, "node"), size), "members") for t in (x, y.where("comp != main")))
    main = y.where("comp = main").join(sets, "node")
    joined = full_x.alias("x").join(main.alias("y"), like, "left_semi").select(F.least("node", "main").alias("a"), F.greatest("node", "main").alias("b")).distinct()
    joined = common.written(joined, "joined")
    found = found.union(joined)
    if joined.limit(1).count():
        comps = components(found)
    now = comps.withColumnRenamed("id", "node").withColumnRenamed("comp", "now")
    ends = [t.drop("comp").join(now, "node", "left").withColumn("comp", F.coalesce("now", "node")) for t in (full_x, full_y)]
    pair = ends[0].alias("x").join(ends[1].alias("y"), like)
    late = common.written(pair.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "late")
    if late.limit(1).count():
        comps = components(found.union(late))
    common.dropped(x, y, sets, full_x, full_y, joined, late)
    return comps
