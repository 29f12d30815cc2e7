"""Vector code compression: product quantisation of integer vectors with partial-distance search.

Components become integers (``floor(1024 * x)``), so that distances, sums and means are exact and don't depend on how
rows are dealt. A vector is cut into ``PARTS``; each part gets the index of its nearest entry in that part's codebook.

The search takes dimensions in descending variance of the codebook. After the first few, the entry with the least
partial distance is completed, which gives each vector a complete distance to beat; after every further group of dimensions a
mask drops the (vector, entry) pairs whose partial distance strictly exceeds it. A pair that could still tie is kept, so
the result is that of the full search, lower index first.

Codebooks are of a fixed size (256 entries a part), so they go to every task, and a task returns no more than one sum per
entry; Spark adds those up. All else stays in the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integers saturate here, so that a squared distance fits a long for up to 2,048 dimensions: components beyond 32,768 aren't told apart.
LIMIT = 1 << 25
#: Vectors that are searched at once.
BLOCK = 512
#: Most distinct labels that are broadcast (a label and a long each); beyond it, a shuffled join takes over.
BROADCAST_LABELS = 1_000_000
#: Dimensions before the first complete distance, and between two masks.
STEP = 4


def nearest(x: np.ndarray, book: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of ``book`` (entries x width) for each row of ``x``; ties go to the lower index."""
    width = book.shape[1]
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    index, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        head = min(step, width)
        partial = np.zeros((len(part), len(book)), np.int64)
        for d in range(head):
            diff = part[:, d, None] - book[None, :, d]
            partial += diff * diff
        guess = partial.argmin(1)
        rest = part[:, head:] - book[guess, head:]
        bound = partial[np.arange(len(part)), guess] + (rest * rest).sum(1)
        row, entry = np.nonzero(partial <= bound[:, None])
        acc = partial[row, entry]
        for at in range(head, width, step):
            diff = part[row, at : at + step] - book[entry, at : at + step]
            acc = acc + (diff * diff).sum(1)
            alive = acc <= bound[row]
            row, entry, acc = row[alive], entry[alive], acc[alive]
        # What is left is complete; the guess is among it, so every row has at least one. By distance, then index.
        first = np.lexsort((entry, acc, row))
        row, entry, acc = row[first], entry[first], acc[first]
        head_of = np.flatnonzero(np.diff(row, prepend=-1))
        index[lo : lo + len(part)], best[lo : lo + len(part)] = entry[head_of], acc[head_of]
    return index, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def _searched(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors summed over the parts."""
    width = books.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in found], 1), sum(e for _, e in found)


def _summed(books, dim: int) -> Callable:
    """One row per part and entry that this task's vectors use: their count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = books.value
        parts, entries, width = value.shape
        sums, counts = np.zeros(value.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dim)
                codes, _ = _searched(x, value)
                for p in range(parts):
                    np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        cols = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), *(pa.array(sums[part, entry, j]) for j in range(width))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *(f"s{j}" for j in range(width))])

    return run


def _coded(books, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = _searched(_matrix(batch.column(2), dim), books.value)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (array of ints) of the rows whose vectors have finite components only; written.

    The length that counts is that of the vector with the smallest vec_id whose length is a positive multiple of ``PARTS``;
    vectors of other lengths are dropped too, as they have no place in the codebooks.
    """
    x = common.narrow(vectors, "vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    kept = x.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & finite).select("vec_id", "label", whole.alias("v"))
    table = common.written(kept, "integers")
    first = table.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).limit(1).collect()
    if not first:
        return table
    out = table.where(F.size("v") == first[0][0])
    out.written_path = table.written_path
    return out


def first_books(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x width: the vectors of the smallest vec_ids (null last; of equal ids the smaller vector first), cut."""
    rows = table.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    x = np.array([r[0] for r in rows], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def trained(table: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning every part and taking floors of means; unused entries stay."""
    spark = table.sparkSession
    books = first_books(table)
    parts, _, width = books.shape
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        schema = ", ".join(["part int", "entry int", "n long", *(f"s{j} long" for j in range(width))])
        sums = table.select("v").mapInArrow(_summed(sent, parts * width), schema)
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
        books = books.copy()
        for r in total.collect():  # at most parts x entries rows
            books[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
        sent.destroy()
    return books


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows of ``vectors`` (vec_id, embedding, label) with finite vectors.

    Rows with a null vector, or null or non-finite components, are dropped, and so are empty vectors and those of another
    length (see ``integers``). Rows that repeat a vec_id or a vector each count and are returned. With fewer than 256 rows the codebooks have
    as many entries. Null labels are one label. An empty table gives no rows. Other columns aren't read.
    """
    common.reachable(vectors.sparkSession)
    spark = vectors.sparkSession
    table = integers(vectors)
    if not table.limit(1).count():
        return table.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(table)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    sent = spark.sparkContext.broadcast(books)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    coded = common.written(table.select("vec_id", "label", "v").mapInArrow(_coded(sent, books.shape[0] * books.shape[2]), schema), "codes")
    common.dropped(table)
    by_label = common.written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    side = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    out = coded.join(side, coded["label"].eqNullSafe(side["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
