"""What several operators share: durable tables, Arrow row streams, hashing."""

from __future__ import annotations

import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only while its rows, at so many bytes each in a hash table, stay below this.
BROADCAST_BYTES = 64_000_000

#: Rows of an Arrow batch in written tables.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A-Z to a-z on bytes; other bytes, so all non-ASCII text, stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir.

    Where that is unset, a temporary one if the driver runs all tasks; on a
    cluster, whose executors would not see it, that raises.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.refsieve.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="refsieve-")
        spark.conf.set("spark.refsieve.dir", base)
    return f"{base.rstrip('/')}/refsieve-{spark.sparkContext.applicationId}"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run within."""
    usual = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, min(int(usual), rows) if int(usual) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, usual)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage durably.

    Python functions on the way get BATCH_ROWS rows at once at most, as rows may hold long texts or sets.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, BATCH_ROWS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over Arrow batches; in the end, what it freed goes back to the system, as Python workers are used again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows take less than BROADCAST_BYTES; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


class Sent:
    """A value broadcast by value, classes included; a call gives it in Python workers, unpacked once a task."""

    def __init__(self, packed: object) -> None:
        self.packed, self.held = packed, []

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "held": []}

    def __call__(self) -> object:
        if not self.held:
            self.held.append(pickle.loads(self.packed.value))
        return self.held[0]

    def release(self) -> None:
        """Free the executors' copies, when what needed them has been written."""
        self.packed.unpersist()


def send(spark: SparkSession, value: object) -> Sent:
    return Sent(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time, so that long texts are never all decoded at once."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def arrow_rows(schema: pa.Schema, rows: Iterator[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(schema, held)
            held = []
    if held:
        yield to_batch(schema, held)


def to_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def ddl_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; other types are given as Arrow by the caller."""
    return pa.schema([(n, ARROW[t]) for n, t in (part.strip().split(" ", 1) for part in ddl.split(","))])


def map_rows(df: DataFrame, row: Callable[..., tuple], ddl: str, size: int = 2048) -> DataFrame:
    """Apply ``row(*columns) -> tuple`` to every row, Arrow in and out."""
    schema = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(schema, (row(*r) for r in rows_of(batches)), size)

    return df.mapInArrow(tidied(run), ddl)


def keep_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, all columns unchanged, for which ``keep(batch)`` is true: a filter in one pass, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), type=pa.bool_()))

    return df.mapInArrow(tidied(run), df.schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pieces(text: str, size: int, between: re.Pattern[str]) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, each of which ends where ``between`` matches: no word is cut."""
    at = 0
    while at < len(text):
        found = between.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1
_CODE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(1 << 15, 1 << (n - 1).bit_length())
        for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.cumprod(out)
    return _POWERS["p"], _POWERS["q"]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, by prefix sums of a polynomial hash."""
    p, q = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[np.frombuffer(data, np.uint8)] * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts])


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each starts and ends there."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    return b" ".join(words), ends - lens, ends


def shingle_set(text: str | None, k: int = 5, step: int = 20_000) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text (all words if fewer; none: empty).

    Long texts are hashed in runs of ``step`` words that overlap by k - 1.
    """
    words = utf8(text).translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, max(1, len(words) - k + 1), step):
        data, starts, ends = word_spans(words[at : at + step + k - 1])
        n = len(starts)
        parts.append(span_hashes(data, starts[: n - k + 1], ends[k - 1 :]) if n >= k else span_hashes(data, starts[:1], ends[-1:]))
    return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))
