"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards of about ``SHARD_BYTES`` of payload, whose bounds come
from a histogram of ids (``BINS`` bins, then every bin above a shard's size is cut into ``CUT`` again until
none is or it holds a single id). Each task writes its shard in id order and rolls to a new file once
``ROLL_BYTES`` are compressed. Files are written under temporary names; tasks rename those that successful
tasks have listed, and then the driver writes the manifest, a row per file. Headers and digests are made
anew from the payload, with a fixed date, so that the same table gives the same bytes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: For tables of many TB, pass sizes of about 1 GB to ``write``: the driver holds a bound per shard and a row per file.
SHARD_BYTES, ROLL_BYTES = 16 << 20, 4 << 20
BINS, CUT = 4096, 16
#: Payloads of at least this many bytes are compared.
MIN_DEDUP_BYTES = 0
#: Most repeated digests that are broadcast; beyond it, a shuffled join takes over.
BROADCAST_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One WARC record; a revisit if ``first`` is another page."""
    revisit = first is not None and first != page_id
    digest = base32_sha1(payload)
    urn = lambda i: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{i}:{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Page-Id": "" if page_id is None else page_id, "Payload-Length": len(payload),
    }
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": urn(first), "Refers-To-Page": first}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def squeezed(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """Records of a file of gzip members, one at a time."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        parts = []
        for at in range(0, len(view), 1 << 16):
            parts.append(z.decompress(view[at : at + (1 << 16)]))
            if z.eof:
                view = view[at + min(1 << 16, len(view) - at) - len(z.unused_data) :]
                break
        else:
            raise ValueError("a gzip member is cut off")
        yield b"".join(parts)


def parsed(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of a record; its digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"])
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest or len(payload) != n:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("Page-Id"), n, digest, fields["WARC-Type"], number("Refers-To-Page"), payload


def place(col: str | Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the column: a binary search in an array that is folded once."""
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    x = F.col(col) if isinstance(col, str) else col
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= x, at + s).otherwise(at)) if bounds else F.lit(0)


def _bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first, from (page_id, bytes) of the pages with an id.

    A round brings to the driver ``BINS`` rows, or ``CUT`` for each bin above a shard's size: bounded by the number of shards.
    """
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None or total <= shard_bytes:
        return []
    width = max(1, -(-(high - low + 1) // BINS))
    start = F.lit(low) + F.floor((F.col("page_id") - low) / width) * width
    bins = {k: (v, width) for k, v in sizes.groupBy(start.alias("start")).agg(F.sum("bytes")).collect()}
    while heavy := sorted(k for k, (v, w) in bins.items() if v > shard_bytes and w > 1):
        width = max(-(-bins[k][1] // CUT) for k in heavy)
        at = F.get(F.split(F.lit(",".join(map(str, heavy))), ",").cast("array<bigint>"), place("page_id", heavy) - 1)
        ends = F.get(F.split(F.lit(",".join(str(k + bins[k][1]) for k in heavy)), ",").cast("array<bigint>"), place("page_id", heavy) - 1)
        inside = sizes.withColumn("at", at).where(F.col("at").isNotNull() & (F.col("page_id") < ends))
        found = inside.groupBy((F.col("at") + F.floor((F.col("page_id") - F.col("at")) / width) * width).alias("start")).agg(F.sum("bytes")).collect()
        for k in heavy:
            del bins[k]
        bins |= {k: (v, width) for k, v in found}
    out, held = [], 0
    for k in sorted(bins):
        if held and held + bins[k][0] > shard_bytes:
            out.append(k)
            held = 0
        held += bins[k][0]
    return out


def write(pages: DataFrame, to: str, shard_bytes: int | None = None, roll_bytes: int | None = None) -> list[dict]:
    """Write ``pages`` (page_id, url, html) as gzip WARC files under ``to``; returns the manifest, which stands there too.

    A null html is an empty payload, a null url ``urn:none``; pages without a page_id come first, in shards of their
    own by the hash of url and html, and are responses only if no page with an id has their payload. Rows that repeat a page_id are records of their own,
    all of the same type if their payloads are equal. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    common.reachable(spark)
    rows = common.narrow(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.unhex(F.sha1("html")))
    shard_bytes, roll_bytes = shard_bytes or SHARD_BYTES, roll_bytes or ROLL_BYTES
    marked = rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("bytes"))
    firsts = marked.where(F.col("bytes") >= MIN_DEDUP_BYTES).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    firsts = common.written(firsts, "firsts")
    few = firsts.count() <= BROADCAST_DIGESTS
    bounds = _bounds(marked.where("page_id is not null").select("page_id", "bytes"), shard_bytes)
    unnamed = marked.where("page_id is null").agg(F.count("*"), F.sum("bytes")).first()
    first = -(-max(1, unnamed[1]) // shard_bytes) if unnamed[0] else 0
    n = first + len(bounds) + 1
    at = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", "html"), F.lit(max(1, first))).cast("int")).otherwise(place("page_id", bounds) + first)
    out = rows.join(F.broadcast(firsts) if few else firsts, "sha", "left").select(at.alias("shard"), "page_id", "url", "html", "first")
    out = out.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", "html", "url")
    temp = f"{to}/_temporary"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(temp)
        system.create_dir(base, recursive=True)
        shard, roll, sink, name, state = None, 0, None, "", [0, 0, hashlib.sha256()]
        done: list[tuple] = []

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((f"part-{shard:06d}-{roll:04d}.warc.gz", name, state[0], state[1], state[2].hexdigest()))
            sink = None

        for batch in batches:
            for s, page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or s != shard or state[0] >= roll_bytes:
                    close()
                    shard, roll = s, roll + 1 if s == shard else 0
                    name, state = f"{uuid.uuid4().hex}.warc.gz", [0, 0, hashlib.sha256()]
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                data = squeezed(record(page, url, html.encode("utf-8", "replace"), first))
                sink.write(data)
                state[0] += len(data)
                state[1] += 1
                state[2].update(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [()] * 5, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "temp", "bytes", "records", "sha256"])

    listed = common.written(out.mapInArrow(save, "file string, temp string, bytes long, records long, sha256 string"), "files")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rename the listed files; what a lost task has renamed already is left."""
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(to)
        for batch in batches:
            for file, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{base}/_temporary/{name}").type != fs.FileType.NotFound:
                    system.move(f"{base}/_temporary/{name}", f"{base}/{file}")
                elif system.get_file_info(f"{base}/{file}").type == fs.FileType.NotFound:
                    raise OSError(f"{file} can't be committed")
            yield batch.slice(0, 0)

    listed.select("file", "temp").mapInArrow(commit, "file string, temp string").count()
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(to))
    manifest = [{k: x[k] for k in ("file", "bytes", "records", "sha256")} for x in listed.orderBy("file").collect()]
    stream = system.create(path(f"{to}/_manifest.tmp"), True)
    stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
    stream.close()
    system.rename(path(f"{to}/_manifest.tmp"), path(f"{to}/_manifest.json"))
    system.delete(path(temp), True)
    common.dropped(firsts, listed)
    return manifest


def shard_of(page_id: int, bounds: list[int]) -> int:
    """The rule of ``place`` in plain Python, for tests."""
    return bisect.bisect_right(bounds, page_id)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives under ``path``; the digests are checked."""
    common.reachable(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [parsed(m)[:5] for m in members(content.as_py())]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(records, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back: a row per record."""
    to = common.new_path(pages.sparkSession, "warc")
    write(pages, to)
    return read(pages.sparkSession, to)
