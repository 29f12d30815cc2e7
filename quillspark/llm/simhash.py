"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits: each is set if it's set in over half the XXH64 hashes of the text's four-word
shingles. Texts with equal fingerprints are one node. Nodes link at ``DISTANCE`` or fewer differing bits.

Multi-index hashing: the bits are cut into segments. By the pigeonhole principle a linked pair differs in at
most ``r`` bits in one of the first segments, or in at most ``r - 1`` in one of the others. So each fingerprint
is filed under its value in each segment, and looks under all values of a small Hamming ball around it. Complete
distances verify what meets there, and a value yields no more links than connect those who met: a spanning forest,
not all linked pairs of a dense group.

A segment value under which more than ``HOT`` fingerprints are filed would be compared n x n. Its members, and
all that look there, go another exact way: each is filed under every midpoint, that is under the 2,081 values
of its own ball of half the distance. Two fingerprints link if and only if they share a midpoint, so all that
share one are linked, a midpoint has 2,081 at most, and one star of links for each is enough: no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernel
from .near_dedup import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
#: Most fingerprints under one segment value that are compared with each other.
HOT = 512
#: Distinct fingerprints from which on two long segments replace three short ones: they have fewer chance meetings and more probes.
MANY = 1 << 25
#: Most hot segment values that are broadcast (12 bytes each); beyond it, the same joins shuffle.
BROADCAST_KEYS = 1_000_000


def _votes(words: list[bytes], first: bool) -> tuple[np.ndarray, int]:
    """How many of the shingles that end in these words set each bit, and their number; not first: the first three words only lead in."""
    k = min(SHINGLE, len(words)) if first else SHINGLE
    if len(words) < k:
        return np.zeros(BITS, np.int64), 0
    joined = b" ".join(words)
    at = np.cumsum([0, *(len(w) + 1 for w in words)])
    starts, ends = at[: len(words) - k + 1].tolist(), (at[k:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)], dtype="<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64), len(hashes)


def fingerprint(text: bytes, piece: int = 1 << 20) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; zero without words. Long texts are taken by pieces that no word crosses."""
    votes, n, lead = np.zeros(BITS, np.int64), 0, []
    pieces = [text] if len(text) <= piece else kernel._pieces(text, piece)
    for part in pieces:
        words = part.lower().split()
        if not words:
            continue
        if n == 0 and len(lead) + len(words) < SHINGLE:
            lead += words
            continue
        more, count = _votes(lead + words, n == 0)
        votes, n = votes + more, n + count
        lead = (lead + words)[-(SHINGLE - 1) :]
    if n == 0 and lead:
        votes, n = _votes(lead, True)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(t) for t in common.utf8(batch.column(1))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed long) of every row of ``docs`` (doc_id, text); a null text has no words."""
    common.reachable(docs.sparkSession)
    return common.narrow(docs, "doc_id", "text").mapInArrow(_fingerprinted, "doc_id long, fp long")


def _long(x: int) -> int:
    """The signed long with the bits of x."""
    return x - (1 << 64) if x >> 63 else x


def _ball(bits: list[int], radius: int) -> list[int]:
    """Masks of at most ``radius`` of the bits."""
    return [_long(sum(1 << b for b in some)) for k in range(radius + 1) for some in combinations(bits, k)]


def segments(n: int, distance: int = DISTANCE) -> list[tuple[int, list[int]]]:
    """For ``n`` segments the mask of each and the masks of its ball: a pair within the distance meets in one of them."""
    cuts = [BITS * i // n for i in range(n + 1)]
    radius, rest = divmod(distance, n)
    out = []
    for i in range(n):
        bits, r = list(range(cuts[i], cuts[i + 1])), radius if i <= rest else radius - 1
        if r >= 0:
            out.append((_long(sum(1 << b for b in bits)), _ball(bits, r)))
    return out


def _around(fp: str, ball: list[int]) -> Column:
    """The values of a ball around a value; its masks stand in the plan as one literal."""
    return F.transform(F.lit(np.array(ball, dtype=np.int64)), lambda m: F.col(fp).bitwiseXOR(m))


def _filed(nodes: DataFrame, parts: list[tuple[int, list[int]]]) -> DataFrame:
    """fp, seg, key: each fingerprint under its own value in every segment."""
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, (mask, _) in enumerate(parts)])
    return nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.seg", "k.key")


def _looked_up(filed: DataFrame, parts: list[tuple[int, list[int]]]) -> DataFrame:
    """fp, seg, key, owner: each filed fingerprint under all values of its segment's ball; it owns its own value."""
    by_seg = [filed.where(F.col("seg") == i).select("fp", "seg", F.col("key").alias("own"), F.explode(_around("key", ball)).alias("key")).select("fp", "seg", "key", (F.col("key") == F.col("own")).alias("owner")) for i, (_, ball) in enumerate(parts)]
    out = by_seg[0]
    for x in by_seg[1:]:
        out = out.union(x)
    return out


def _spanned(distance: int) -> Callable:
    """Of rows (visitors, owners) that met under one segment value: links enough to connect all that are within the distance of an owner, one fewer than there are at most.

    Every owner is compared with everyone, vectorised; two visitors meet under another value or segment.
    """

    def links_of(owners: np.ndarray, everyone: np.ndarray) -> list[tuple[int, int]]:
        label = np.arange(len(everyone))
        out = []
        for i in range(len(owners)):
            near = np.flatnonzero(np.bitwise_count(everyone ^ owners[i]) <= distance)
            groups = np.unique(label[near])
            if len(groups) > 1:
                # Labels are places of a member: the groups' members named by them are linked to the owner's group.
                out += [(int(everyone[groups[0]]), int(everyone[g])) for g in groups[1:]]
                label[np.isin(label, groups)] = groups[0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            for visitors, owners in zip(batch.column(0), batch.column(1), strict=True):
                own = np.array(owners.as_py(), np.int64).view(np.uint64)
                pairs += links_of(own, np.concatenate([own, np.array(visitors.as_py(), np.int64).view(np.uint64)]))
            cols = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["a", "b"])

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT, many: int = MANY) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``nodes`` (fp), enough of them to connect all that are within the distance; written."""
    parts = segments(3 if nodes.count() <= many else 2, distance)
    filed = common.written(_filed(nodes, parts), "filed")
    crowded = common.written(filed.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key"), "crowded")
    n = crowded.count()
    if n:
        side = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded
        quiet = common.written(filed.join(side, ["seg", "key"], "left_anti"), "quiet")
        looking = _looked_up(filed, parts).join(side, ["seg", "key"], "left_semi").select("fp").distinct()
        met = looking.select("fp", F.explode(_around("fp", _ball(list(range(BITS)), distance // 2))).alias("mid"))
        if distance % 2:  # the midpoint of an odd distance is one bit nearer to either end
            raise ValueError("an even distance has midpoints")
        shared = met.groupBy("mid").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        star = shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b").distinct()
    else:
        quiet, star = filed, None
    met = _looked_up(quiet, parts).groupBy("seg", "key").agg(F.sort_array(F.collect_list(F.struct("owner", "fp"))).alias("met"))
    met = met.where((F.size("met") > 1) & F.col("met")[F.size("met") - 1]["owner"])
    common.reachable(nodes.sparkSession)
    found = met.select(F.filter("met", lambda x: ~x["owner"])["fp"].alias("visitors"), F.filter("met", lambda x: x["owner"])["fp"].alias("owners")).mapInArrow(_spanned(distance), "a long, b long").distinct()
    out = common.written(found.union(star) if star is not None else found, "links")
    common.dropped(filed, crowded, *([quiet] if n else []))
    return out


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, hot: int = HOT, many: int = MANY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``documents`` (doc_id, text).

    A text without words, an empty one and a null one have the fingerprint zero, which links like any other.
    Rows that repeat a doc_id are one document and link their fingerprints. A null doc_id takes part through its
    fingerprint; its component_id is the smallest doc_id of that component, or null if there's none. An empty table
    gives no rows; columns but doc_id and text aren't read. Distances are even.
    """
    if distance % 2:
        raise ValueError("an even distance is needed")
    sig = common.written(fingerprints(documents), "fingerprints")
    nodes = common.written(sig.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = links(nodes.select("fp"), distance, hot, many)
    same = sig.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    same = sig.join(same, "doc_id").where("fp != a").select("a", F.col("fp").alias("b"))
    edges = common.written(found.union(same), "links")
    comps = components(edges).withColumnRenamed("id", "fp")
    marked = nodes.join(comps, "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = marked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = common.written(marked.join(least, "comp").select("fp", "component_id"), "labels")
    common.dropped(found, edges, nodes)
    return sig.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
