"""Media payloads as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has ``MASK`` bits of zeros (with least and
largest sizes). Spark joins chunk digests over all payloads: each chunk belongs to the payload with the
least digest that holds it. The store has a row per payload: its manifest (the ordered chunk list as bytes) and
the bytes of the chunks it owns. To read a payload back, chunks of other owners are joined in by digest, the list
is put together and its digest verified. A payload's stored form is its manifest and then its chunks, as read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernel

LEAST, MOST, MASK = 256, 8192, 10
ALIGN = 64
#: Bytes hashed at a time.
BLOCK = 1 << 22
#: Most rows (documents with chunks they don't own, and their digests) that are broadcast; beyond it, a shuffled join.
BROADCAST_ROWS = 400_000
MAGIC = b"CDC1"


@functools.cache
def gear() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded with zeros to a positive multiple of ``ALIGN``, and their number before."""
    data = (text or "").encode("utf-8", "replace")
    size = max(ALIGN, -(-len(data) // ALIGN) * ALIGN)
    return data.ljust(size, b"\0"), len(data)


def marks(data: bytes) -> np.ndarray:
    """Places after which the hash of the last 32 bytes allows a cut; the hash starts anew with each payload."""
    out = []
    low = np.uint32((1 << MASK) - 1) << np.uint32(32 - MASK)
    for at in range(0, len(data), BLOCK):
        start = max(0, at - 31)
        h = gear()[np.frombuffer(data, dtype=np.uint8, count=min(len(data), at + BLOCK) - start, offset=start)]
        for k in (1, 2, 4, 8, 16):  # the sum of g[i - j] << j over 2 k bytes, from that over k
            if len(h) > k:
                h[k:] += h[:-k] << np.uint32(k)
        hits = np.flatnonzero((h & low) == 0) + start + 1
        out.append(hits[hits > at])
    return np.concatenate(out)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    ends, start, found = [], 0, marks(data).tolist()
    i = 0
    while start < len(data):
        limit = min(start + MOST, len(data))
        while i < len(found) and found[i] < start + LEAST:
            i += 1
        end = found[i] if i < len(found) and found[i] < limit else limit
        ends.append(end)
        start = end
    return ends


def chunked(data: bytes) -> tuple[list[bytes], list[int]]:
    """Digests and sizes of the chunks."""
    ends = cuts(data)
    starts = [0, *ends[:-1]]
    return [hashlib.sha256(data[a:b]).digest() for a, b in zip(starts, ends)], [b - a for a, b in zip(starts, ends)]


ENTRY = np.dtype([("size", "<u4"), ("digest", "V32")])


def manifest(digests: list[bytes], sizes: list[int]) -> bytes:
    """The ordered chunk list: a mark, the number of chunks, then size and digest of each."""
    entries = np.empty(len(sizes), dtype=ENTRY)
    entries["size"], entries["digest"] = sizes, np.frombuffer(b"".join(digests), dtype="V32")
    return MAGIC + struct.pack("<I", len(sizes)) + entries.tobytes()


def listed(data: bytes) -> tuple[list[bytes], list[int]]:
    """Digests and sizes of a manifest."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk list")
    entries = np.frombuffer(data, dtype=ENTRY, count=struct.unpack("<I", data[4:8])[0], offset=8)
    return [x.tobytes() for x in entries["digest"]], entries["size"].tolist()


def feature(digests: list[bytes], sizes: list[int], data: bytes) -> str:
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    entropy = round(float(-(p * np.log2(p)).sum()), 4)
    return f"chunks={len(sizes)};distinct={len(set(digests))};longest={max(sizes)};sum={int((counts * np.arange(256)).sum())};bytes={len(p)};entropy={entropy:.4f}"


INDEX = "doc_id long, n_bytes long, pid binary, digests array<binary>"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column(1):
            data, n = payload(t.as_py())
            rows.append((n, hashlib.sha256(data).digest(), chunked(data)[0]))
        n, pid, digests = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(pid, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "pid", "digests"])


STORE = "pid binary, manifest binary, own array<boolean>, data binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, foreign digests) the rows of the store."""
    kinds = (pa.binary(), pa.binary(), pa.list_(pa.bool_()), pa.binary())
    for batch in batches:
        texts, foreign = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in kernel.chunks([t or "" for t in texts], 1 << 22):
            rows = []
            for i in part:
                data, _ = payload(texts[i])
                digests, sizes = chunked(data)
                other, first, own, kept, at = set(foreign[i] or ()), set(), [], [], 0
                for d, n in zip(digests, sizes, strict=True):
                    own.append(d not in other and d not in first)
                    if own[-1]:
                        kept.append(data[at : at + n])
                        first.add(d)
                    at += n
                rows.append((hashlib.sha256(data).digest(), manifest(digests, sizes), own, b"".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=["pid", "manifest", "own", "data"])


def _parts(digests: list[bytes], sizes: list[int], own: list[bool], data: bytes) -> dict[bytes, bytes]:
    out, at = {}, 0
    for d, n, mine in zip(digests, sizes, own, strict=True):
        if mine:
            out[d] = data[at : at + n]
            at += n
    return out


def _offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, bytes of the wanted chunks of rows (manifest, own, data, wanted)."""
    for batch in batches:
        found: dict[bytes, bytes] = {}
        for stored, own, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = _parts(*listed(stored), own, data)
            found |= {d: parts[d] for d in wanted if d in parts}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "bytes"])


READ = "pid binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (pid, manifest, own, data, foreign chunks) the payload's features; fails if a payload isn't what was stored."""
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for pid, stored, own, data, foreign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digests, sizes = listed(stored)
            parts = _parts(digests, sizes, own, data) | {x["digest"]: x["bytes"] for x in foreign or ()}
            whole = b"".join([parts[d] for d in digests])
            if hashlib.sha256(whole).digest() != pid:
                raise ValueError(f"payload {pid.hex()} can't be reconstructed")
            media = stored + whole
            rows.append((pid, len(whole), pid.hex(), zlib.crc32(whole[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature(digests, sizes, whole)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, kinds, strict=True)], names=["pid", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, pid (payload digest), digests of every row (doc_id, text); written."""
    common.reachable(docs.sparkSession)
    return common.written(common.narrow(docs, "doc_id", "text").mapInArrow(_indexed, INDEX), "chunks")


def store(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store of the payloads of ``docs`` (each chunk once), and pid, digest, owner of chunks that others own.

    A payload is stored by the row with its least doc_id; rows without one store theirs only if all rows of the payload are such.
    """
    payloads = found.groupBy("pid").agg(F.min("doc_id").alias("keeper"))
    # A payload's chunk list follows from its digest, so any of its rows gives it.
    keepers = found.join(payloads, "pid").where("doc_id <=> keeper").select("doc_id", "pid", "digests")
    each = keepers.select("pid", F.explode(F.array_distinct("digests")).alias("digest"))
    owners = each.groupBy("digest").agg(F.min("pid").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    foreign = common.written(each.join(owners, "digest").where("pid != owner").distinct(), "foreign")
    lists = foreign.groupBy("pid").agg(F.collect_list("digest").alias("foreign"))
    others = found.join(payloads, "pid").where("not (doc_id <=> keeper)").select("doc_id", "pid")
    skip = others.select("doc_id", "pid", F.lit(True).alias("skip"), F.lit(None).cast("array<binary>").alias("foreign"))
    partly = keepers.select("doc_id", "pid").join(lists, "pid").select("doc_id", "pid", F.lit(False).alias("skip"), "foreign")
    notes = common.written(skip.unionByName(partly).distinct(), "notes").withColumnRenamed("doc_id", "_id")
    few = notes.count() <= BROADCAST_ROWS and foreign.count() <= BROADCAST_ROWS
    size = F.octet_length(F.coalesce("text", F.lit("")).cast("binary"))
    pad = F.greatest(F.lit(ALIGN), (F.ceil(size / ALIGN) * ALIGN).cast("int")) - size
    digest = F.unhex(F.sha2(F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.repeat(F.lit("00"), pad))), 256))
    rows = common.narrow(docs, "doc_id", "text").withColumn("_pid", digest)
    rows = rows.join(F.broadcast(notes) if few else notes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_pid") == F.col("pid")), "left")
    rows = rows.where("skip is null or not skip").select("text", "foreign")
    return common.written(rows.mapInArrow(_stored, STORE), "store"), foreign


def read(stored: DataFrame, foreign: DataFrame) -> DataFrame:
    """pid and what ``_read`` makes of each stored payload."""
    whole = stored.where(F.forall("own", lambda x: x)).withColumn("foreign", F.lit(None).cast("array<struct<digest:binary,bytes:binary>>"))
    wanted = foreign.groupBy("owner").agg(F.collect_set("digest").alias("wanted"))
    few = foreign.count() <= BROADCAST_ROWS
    offers = stored.join(F.broadcast(wanted) if few else wanted, stored["pid"] == wanted["owner"]).select("manifest", "own", "data", "wanted")
    chunks = offers.mapInArrow(_offered, "digest binary, bytes binary").dropDuplicates(["digest"])
    filled = foreign.select("pid", "digest").join(chunks, "digest").groupBy("pid").agg(F.collect_list(F.struct("digest", "bytes")).alias("foreign"))
    partly = stored.where(F.exists("own", lambda x: ~x)).join(filled, "pid", "left").select(*whole.columns)
    return whole.mapInArrow(_read, READ).unionByName(partly.mapInArrow(_read, READ))


def round_trip(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row of ``documents``.

    A null text is an empty payload of 64 zeros. Equal texts share one stored payload; rows that repeat a doc_id each have a result row.
    """
    found = index(documents)
    stored, foreign = store(documents, found)
    features = read(stored, foreign).dropDuplicates(["pid"])
    return found.select("doc_id", "n_bytes", "pid").join(features, "pid").select("doc_id", "n_bytes", *[c for c in features.columns if c != "pid"])
