"""Prefix trie of conversations: one row per distinct beginning, with sums over everything below it.

Turns become 128-bit digests of (role, text) with the text's length, so texts are read once and not shuffled. Conversations
with equal turns are one class, with its number and smallest id: copies don't weigh on a task.

Classes are dealt by the digest of their first turn. In a task, a trie of dictionaries is built for all first turns that it
got, and walked in postorder without recursion. A first turn with more than ``limit`` turns below it is taken apart instead:
Spark finds how many turns all its classes share (from the smallest and the largest sequence) and makes those nodes, a
chain; its classes are dealt again by the digest up to the turn after that, and so on until every part is small. The nodes of a chain get
their sums from the parts below, deepest first. The root is such a chain of one node. A single long conversation is a chain too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import common

#: Conversations that share the turns of one: those of equal id but for the last two digits.
FAMILY = 100
#: The shared turns are crc32(id) modulo this.
SHARED = 6
#: Most turns of a part (and the mean of a group of parts) that a task makes a trie of, unless that would leave more than CHAINS parts to take apart.
LIMIT = 2_000
#: Most chains at any size of the table (the limit grows to this end); their keys are broadcast at about 40 bytes each.
CHAINS = 1_000_000
#: Ids that agree but for so many low bits are one block: it's hashed as a whole.
ID_BITS = 10
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and seq (array of digest and length per turn) of every conversation with the first turns of its family's first put in.

    Null roles and texts are empty. Turns are in the order of ``turn``, null first, then of their digests. Rows without a conv_id are left out.
    """
    c = common.narrow(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = c.select("conv_id", "turn", _digest(role, text).alias("dig"), F.length(text).alias("n"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "dig", "n"))), lambda t: F.struct(t["dig"].alias("dig"), t["n"].alias("n")))
    own = common.written(slim.groupBy("conv_id").agg(turns.alias("own")), "turns")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(first, "base", "left")
    nothing = F.array().cast(own.schema["own"].dataType)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", nothing), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(nothing)
    rest = F.when(F.col("h") < F.size("own"), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(1)))).otherwise(nothing)
    return both.select("conv_id", F.concat(head, rest).alias("seq"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and block, the SHA-256 of each key's ids: the blocks pass through the hash one by one."""
    key, state = None, None
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])


def classes(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence of the conversations ``convs`` (conv_id, seq): digs and lens (arrays), n, low (smallest id) and ends, the hash of all ids; written.

    Ids meet in blocks of 1,024 neighbours before they're shuffled to their class, and pass through its hash block by block.
    """
    key = F.unhex(F.md5(F.array_join(F.transform("seq", lambda t: F.hex(t["dig"])), "")))
    rows = convs.select("conv_id", key.alias("key"), F.shiftright("conv_id", ID_BITS).alias("block"), "seq")
    ids = F.sort_array(F.collect_set("conv_id"))
    blocks = rows.groupBy("key", "block").agg(ids.alias("ids"), F.first("seq").alias("seq"))
    blocks = blocks.select("key", "block", "seq", F.size("ids").alias("n"), F.col("ids")[0].alias("low"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    blocks = common.written(blocks, "ids")
    found = blocks.groupBy("key").agg(F.first("seq").alias("seq"), F.sum("n").alias("n"), F.min("low").alias("low"), F.count("*").alias("blocks"), F.first("ids").alias("ids"))
    found = common.written(found, "classes")
    many = blocks.join(found.where("blocks > 1").select("key"), "key", "left_semi").select("key", "block", "ids")
    hashed = many.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_hashed, "key binary, ends string")
    ends = F.coalesce("ends", F.sha2("ids", 256))
    digs, lens = F.transform("seq", lambda t: t["dig"]), F.transform("seq", lambda t: t["n"])
    out = common.written(found.join(hashed, "key", "left").select(digs.alias("digs"), lens.alias("lens"), "n", "low", ends.alias("ends")), "classes")
    common.dropped(blocks, found)
    return out


NODES = "over binary, top boolean, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Trie:
    """A trie of dictionaries over node numbers; what each node needs stands in lists by number. A parent's number is below its children's."""

    def __init__(self) -> None:
        self.child: list[dict[bytes, int]] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.size: list[int] = []
        self.n: list[int] = []
        self.low: list[int] = []
        self.ends: list[str] = []

    def node(self, parent: int, depth: int, size: int, low: int) -> int:
        for held, x in ((self.child, {}), (self.parent, parent), (self.depth, depth), (self.size, size), (self.n, 0), (self.low, low), (self.ends, _EMPTY)):
            held.append(x)
        return len(self.n) - 1

    def add(self, at: int, depth: int, digs: list[bytes], lens: list[int], n: int, low: int, ends: str) -> None:
        """A class from the node ``at`` of that depth on: ``digs`` are its turns below."""
        self.n[at] += n
        self.low[at] = min(self.low[at], low)
        for d, (dig, size) in enumerate(zip(digs, lens, strict=True), depth + 1):
            below = self.child[at].get(dig)
            if below is None:
                below = self.child[at][dig] = self.node(at, d, size, low)
            at = below
            self.n[at] += n
            self.low[at] = min(self.low[at], low)
        self.ends[at] = ends

    def postorder(self, roots: list[int]) -> Iterator[int]:
        """Each node after its children, with a stack of its own."""
        for root in roots:
            stack = [(root, iter(self.child[root].values()))]
            while stack:
                at, below = stack[-1]
                found = next(below, None)
                if found is None:
                    stack.pop()
                    yield at
                else:
                    stack.append((found, iter(self.child[found].values())))


def _built(group: pd.DataFrame) -> pd.DataFrame:
    """The tries of some first turns (or later parts): rows g, up, at, digs, lens, n, low, ends, over, where ``at`` is the depth of the part's top, ``over`` the chain above and ``up`` the smallest id there."""
    t = Trie()
    tops: dict[bytes, int] = {}
    above: dict[int, tuple[bytes, int]] = {}
    for g, up, at, digs, lens, n, low, ends, over in zip(*(group[c] for c in ("g", "up", "at", "digs", "lens", "n", "low", "ends", "over")), strict=True):
        g = bytes(g)
        digs, lens = [bytes(d) for d in digs[at - 1 :]], [int(x) for x in lens[at - 1 :]]
        if g not in tops:
            tops[g] = t.node(-1, at, lens[0], low)
            above[tops[g]] = (bytes(over), up)
        t.add(tops[g], at, digs[1:], lens[1:], n, low, ends)
    leaves, saved = [0] * len(t.n), [0] * len(t.n)
    for at in t.postorder(list(tops.values())):
        leaves[at] += not t.child[at]
        saved[at] += (t.n[at] - 1) * t.size[at]
        if t.parent[at] >= 0:
            leaves[t.parent[at]] += leaves[at]
            saved[t.parent[at]] += saved[at]
    return pd.DataFrame(
        {
            "over": [above[i][0] if p < 0 else None for i, p in enumerate(t.parent)],
            "top": [p < 0 for p in t.parent],
            "conv_id": np.array(t.low, np.int64),
            "depth": np.array(t.depth, np.int32),
            "parent_conv_id": np.array([above[i][1] if p < 0 else t.low[p] for i, p in enumerate(t.parent)], np.int64),
            "n_convs": np.array(t.n, np.int64),
            "n_children": np.array([len(x) for x in t.child], np.int64),
            "n_leaves": np.array(leaves, np.int64),
            "saved_tokens": np.array(saved, np.int64),
            "ends_sha256": t.ends,
        }
    )


@F.pandas_udf(ArrayType(LongType()))
def _running(lens: pd.Series, n: pd.Series, saved: pd.Series) -> pd.Series:
    """For each node of a chain, what is saved from there down: its own and later turns' share, and what the parts below save."""
    return pd.Series([(np.cumsum(np.asarray(x, np.int64)[::-1] * (k - 1))[::-1] + s) for x, k, s in zip(lens, n, saved, strict=True)])


def _common(x: str, y: str) -> Column:
    """How many turns two sequences begin with alike."""
    differs = F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b))
    return F.when(F.size(differs) == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)), F.size(differs) + 1) - 1).cast("int")


def _parted(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """Rows of parts that are small enough, chains of those that aren't, the rows below the chains, and the parts that aren't small; two are None if there's no chain."""
    large = rows.groupBy("g").agg(F.sum(F.size("digs") - F.col("at") + 1).alias("turns")).where(F.col("turns") > limit).select("g")
    large = common.written(large, "large")
    if not large.limit(1).count():
        return rows, None, None, large
    side = F.broadcast(large)
    small = rows.join(side, "g", "left_anti")
    chains = _chains(rows.join(side, "g", "left_semi"))
    below = rows.join(F.broadcast(chains.select("g", "to", F.col("low").alias("own"))), "g").where(F.size("digs") > F.col("to"))
    key = F.unhex(F.md5(F.concat("g", F.lit("/"), F.get("digs", F.col("to")))))
    below = common.written(below.select(key.alias("g"), F.col("own").alias("up"), (F.col("to") + 1).alias("at"), "digs", "lens", "n", "low", "ends", F.col("g").alias("over")), "parts")
    return small, chains, below, large


def _chains(rows: DataFrame) -> DataFrame:
    """One row per part g: its nodes reach from depth ``at`` to ``to``; lens of those, sums, and the ends at the last; written."""
    sums = rows.groupBy("g").agg(
        F.min("digs").alias("least"), F.max("digs").alias("most"), F.min_by(F.struct("lens", "ends"), "digs").alias("first"),
        F.sum("n").alias("n"), F.min("low").alias("low"), F.first("up").alias("up"), F.first("at").alias("at"), F.first("over").alias("over"),
    )
    to = F.greatest(_common("least", "most"), "at")
    sums = sums.withColumn("to", to)
    # Where a class ends at the chain's last node it's the smallest one, since it's the beginning of all others.
    ends = F.when(F.size("least") == F.col("to"), F.col("first.ends")).otherwise(F.lit(_EMPTY))
    lens = F.slice("first.lens", F.col("at"), F.col("to") - F.col("at") + 1)
    return common.written(sums.select("g", "over", "up", "at", "to", lens.alias("lens"), "n", "low", ends.alias("ends")), "chains")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations (see ``rebuilt``): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id are left out; other nulls are empty texts. Repeated rows are turns of their own. Rebuilt conversations without turns end at the root.
    An empty table has no conversation, and so no node. A conversation is one row (20 bytes a turn). Columns but conv_id, turn, role and text aren't read.
    """
    spark = conversations.sparkSession
    common.reachable(spark)
    convs = classes(rebuilt(conversations))
    total = convs.agg(F.count("*").alias("rows"), F.sum(F.size("digs")).alias("turns"), F.min("low").alias("low"), F.sum("n").alias("n")).collect()[0]
    empty = spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    if not total["rows"]:
        return empty
    limit = max(limit, total["turns"] // CHAINS)
    at_root = convs.where(F.size("digs") == 0).select("ends").collect()  # one class at most
    rows = convs.where(F.size("digs") > 0).select(F.unhex(F.md5(F.get("digs", F.lit(0)))).alias("g"), F.lit(total["low"]).alias("up"), F.lit(1).alias("at"), "digs", "lens", "n", "low", "ends", F.lit(b"").alias("over"))
    levels, small, spent = [], [], [convs]
    while rows is not None:
        part, chains, below, large = _parted(rows, limit)
        small.append(part)
        spent.append(large)
        if chains is not None:
            levels.append(chains)
            spent.append(below)
        rows = below
    parts = small[0]
    for x in small[1:]:
        parts = parts.union(x)
    bucket = F.pmod(F.xxhash64("g"), F.lit(1 + total["turns"] // limit))
    tries = common.written(parts.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_built, NODES), "nodes")
    common.dropped(*spent)
    # Of the parts' tops, what the nodes above add up.
    sums = tries.where("top").select("over", "n_leaves", "saved_tokens")
    nodes = tries.drop("over", "top")
    for chains in reversed(levels):
        below = sums.groupBy("over").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("over", "g")
        whole = common.written(_summed(chains, below), "chains")
        steps = whole.select("*", F.posexplode("below").alias("i", "saved_tokens"))
        last = F.col("i") == F.size("lens") - 1
        nodes = nodes.union(
            steps.select(
                F.col("low").alias("conv_id"), (F.col("at") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", F.when(last, F.col("ends")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
            )
        )
        others = sums.join(F.broadcast(chains.select(F.col("g").alias("over"))), "over", "left_anti")
        sums = others.union(whole.select("over", F.col("leaves").alias("n_leaves"), F.col("below")[0].alias("saved_tokens")))
    top = sums.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = top.select(
        F.lit(total["low"]).alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).alias("n_convs"), "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.lit(at_root[0][0] if at_root else _EMPTY).alias("ends_sha256"),
    )
    return nodes.union(root).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema.fields])


def _summed(chains: DataFrame, below: DataFrame) -> DataFrame:
    """The chains with the number of parts below, leaves, and for each node the tokens saved from there down."""
    both = chains.join(below, "g", "left").withColumn("children", F.coalesce("children", F.lit(0))).withColumn("leaves", F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)))
    return both.withColumn("below", _running("lens", "n", F.coalesce("saved", F.lit(0))))
