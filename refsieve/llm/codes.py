"""Operator 12: product codes of vectors, fitted by Lloyd rounds that move only what changed.

Components become floor(1024 x); a vector is cut into ``PARTS`` parts, each
position of which has a codebook of ``ENTRIES`` entries, at first those parts of
the smallest ids. A round

1. assigns every part to its nearest entry and writes the rows with the previous
   and the new assignment to the shared folder;
2. reads the rows of which an assignment changed and sums, within each task, a
   plus for the new entry and a minus for the old one; only these sums are
   shuffled, at most ``PARTS * ENTRIES`` counts and vectors a task;
3. adds them to the running integer sums, which the driver writes beside the
   rows; they and the codebooks are of a fixed size, whatever the input's.

All sums and distances are exact integers, so results depend on neither
partitions nor order.

Rows whose vector is null or empty, or holds null or non-finite components, are
dropped; so are, as they have no place in the codebooks, vectors of another
length than that of the least id, and components of which floor(1024 x) is 2^22 or more in size. A length that
PARTS does not divide raises. Null ids are kept and come last among the
candidates for a codebook; repeated ids are rows of their own, the lesser vector
first. With fewer rows than ENTRIES the codebooks are that much shorter. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import broadcast_if_small, send, tidied, written
from refsieve.llm.vectors import integers, length_of, products

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bytes of a row of label sums in a broadcast hash table.
LABEL_BYTES = 64

STATE = "vec_id bigint, label bigint, v array<int>, old binary, code binary, error bigint"
_STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())), ("old", pa.binary()), ("code", pa.binary()), ("error", pa.int64())])


def _lists(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(matrix.ravel(), pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(matrix.shape[1], 1), dtype=np.int32)[: len(matrix) + 1]), flat)


def matrix_of(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def state(table: DataFrame, size: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """The kept rows as integers, without assignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = integers(batch.column(2), size, SCALE)
            ids, labels = (batch.column(i).filter(pa.array(kept)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, _lists(whole), *(pa.nulls(len(whole), f.type) for f in list(_STATE)[3:])], schema=_STATE)

    source = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("x"))
    return source.mapInArrow(tidied(run), STATE)


def nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the code (a byte for each part) and the sum of squared distances; ties to the lower index."""
    width = books.shape[2]
    codes, error = np.empty((len(v), PARTS), np.uint8), np.zeros(len(v), np.int64)
    for part in range(PARTS):
        x, book = v[:, part * width : (part + 1) * width], books[part]
        far = (book * book).sum(axis=1)[None, :] - 2 * products(x, book)
        at = far.argmin(axis=1)
        codes[:, part] = at
        error += far[np.arange(len(v)), at] + (x * x).sum(axis=1)
    return codes, error


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with their assignment so far as ``old``, and the one to ``books`` as ``code``."""
    sent = send(rows.sparkSession, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = nearest(matrix_of(batch.column(2)), sent())
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), packed, pa.array(error)], schema=_STATE)

    return rows.mapInArrow(tidied(run), STATE)


def changes(rows: DataFrame, width: int) -> DataFrame:
    """(slot, delta): what changed assignments add to the running sums.

    The slots of an entry are its ``width`` component sums and its count, entry
    after entry, part after part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix_of(batch.column(0)).reshape(-1, PARTS, width)
            first = np.asarray(batch.column(1).is_null())
            new = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, PARTS)
            old = np.frombuffer(b"".join(x or bytes(PARTS) for x in batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
            one = np.concatenate([v, np.ones((len(v), PARTS, 1), np.int64)], axis=2)
            for part in range(PARTS):
                moved = first | (new[:, part] != old[:, part])
                np.add.at(sums[part], new[moved, part], one[moved, part])
                left = moved & ~first
                np.subtract.at(sums[part], old[left, part], one[left, part])
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["slot", "delta"])

    moved = rows.where("old is null or old <> code").select("v", "old", "code")
    return moved.mapInArrow(tidied(run), "slot bigint, delta bigint").groupBy("slot").agg(F.sum("delta").alias("delta"))


def fit(rows: DataFrame, books: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The rows assigned to the last codebooks, and these."""
    spark, width = rows.sparkSession, books.shape[2]
    sums = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
    for step in range(ROUNDS):
        rows = written(assigned(rows, books), f"codes-{step}")
        moved = written(changes(rows, width), f"codes-moved-{step}").toArrow()
        sums.ravel()[moved.column("slot").to_numpy()] += moved.column("delta").to_numpy()
        count = sums[:, : books.shape[1], width:]
        books = np.where(count > 0, sums[:, : books.shape[1], :width] // np.maximum(count, 1), books)
        at = np.flatnonzero(sums)
        kept = pa.table({"slot": pa.array(at), "total": pa.array(sums.ravel()[at])})
        written(spark.createDataFrame(kept), f"codes-sums-{step}")
    return written(assigned(rows, books), "codes-last"), books


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    size, out = length_of(table, id_col, vector_col), "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if size % PARTS:
        raise ValueError(f"vectors of {size} components cannot be cut into {PARTS} equal parts")
    if not size:
        return table.sparkSession.createDataFrame([], out)
    rows = written(state(table, size, id_col, vector_col, label_col), "codes-state")
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow().column("v")
    if not len(seeds):
        return table.sparkSession.createDataFrame([], out)
    books = matrix_of(seeds.combine_chunks()).reshape(len(seeds), PARTS, -1).transpose(1, 0, 2)
    rows, books = fit(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = written(rows.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error")), "codes-labels")
    coded = rows.join(broadcast_if_small(sums, LABEL_BYTES), F.col("label").eqNullSafe(F.col("its")))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
