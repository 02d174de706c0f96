"""Operator 4: a quality classifier on document statistics.

``STATS`` statistics of each whole text are standardised and mapped to random
Fourier features, which approximate a Gaussian kernel. Each partition of the
labelled rows sums its part of the normal equations; their total, solved on the
driver, gives ridge scores. An isotonic fit to binned scores of a fold that the
ridge did not see turns scores into probabilities.

All labelled rows outside the held-out fold are used; what reaches the driver
is of fixed size. Null and empty texts have statistics of zero and are scored
like others. Labels other than 0 and 1 are left out; a document with several
labels counts once for each; without labels of both kinds every score is 0.5.
Repeated rows give repeated results. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import rows_of, send, tidied, utf8, written
from refsieve.llm.learn import fold, isotonic

FEATURES, SCALE, RIDGE = 160, 3.0, 1e-3
#: Of the five folds, 0 is held out, CALIBRATION fits the isotonic part and the rest the ridge.
CALIBRATION = 1
BINS = 400
#: The score from which a document counts as good.
LEAST = 0.3
_CLASS = np.full(256, 7, np.int64)  # other
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()", b"!")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 0
_STEP = 1 << 20
_END = re.compile(rb"[.!?]\s")
NAMES = ("bytes", "lower", "upper", "digit", "blank", "line", "stop", "bang", "other", "words", "word_length", "long_words", "distinct", "sentence", "lines_repeated", "line_length", "short_words", "symbol_words", "max_word")
STATS = len(NAMES)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of NAMES; zeros if it has no bytes."""
    data = utf8(text)
    if not data:
        return np.zeros(STATS)
    n = len(data)
    kinds = np.zeros(8)
    for at in range(0, n, _STEP):
        kinds += np.bincount(_CLASS[np.frombuffer(data[at : at + _STEP], np.uint8)], minlength=8)
    words = data.split()
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    edge = sum(w[-1:] in b"%$*&#|!" for w in words)
    m = max(1, len(words))
    rest = [np.log1p(len(words)), lens.mean(), (lens > 14).mean(), len(set(words)) / m, m / (1 + len(_END.findall(data))), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), (lens < 4).mean(), edge / m, np.log1p(lens.max())]
    rest[4] = np.log1p(rest[4])
    return np.concatenate([[np.log1p(n)], kinds / n, rest])


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fold, x): one pass over the texts, written as a narrow table."""
    schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, part, statistics(text)) for key, part, text in rows_of(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    source = docs.select(F.col(id_col).cast("bigint"), fold(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return written(source.mapInArrow(tidied(run), "doc_id bigint, fold bigint, x array<double>"), "statistics")


class Kernel:
    """Standardisation and random Fourier features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / SCALE, (STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATS)


class Scorer:
    def __init__(self, kernel: Kernel | None, beta: np.ndarray | None, points: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.kernel, self.beta, self.points = kernel, beta, points

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.beta

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.points), 0.0, 1.0)


def fit(rows: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> Scorer:
    """Fit on ``described`` rows and their labels."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    known = written(rows.where("fold <> 0").join(marked, "doc_id").select("fold", "x", "y"), "labelled")
    main = known.where(F.col("fold") != CALIBRATION)
    counts = main.agg(F.count("*"), F.sum("y"), *[F.avg(F.get("x", F.lit(i))) for i in range(STATS)], *[F.stddev_pop(F.get("x", F.lit(i))) for i in range(STATS)]).first()
    if not counts[0] or counts[1] in (0, counts[0]):
        return Scorer(None, None, None)
    kernel = Kernel(np.array(counts[2 : 2 + STATS]), np.array(counts[2 + STATS :]))
    size = FEATURES + 1
    sent = send(rows.sparkSession, kernel)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for batch in batches:
            z = sent()(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            total += np.concatenate([(z.T @ z).ravel(), z.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    summed = main.select("x", "y").mapInArrow(tidied(parts), "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
    gram, moment = summed[: size * size].reshape(size, size), summed[size * size :]
    beta = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.diag([*np.ones(FEATURES), 0.0]) / FEATURES + 1e-9 * np.eye(size), moment)
    scorer = Scorer(kernel, beta, None)
    held = send(rows.sparkSession, scorer)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.rint(held().raw(_matrix(batch.column(0))) * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["at", "y"])

    bins = known.where(F.col("fold") == CALIBRATION).select("x", "y").mapInArrow(tidied(binned), "at bigint, y double").groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("at")
    if bins.empty:
        scorer.points = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    else:
        scorer.points = isotonic(bins["at"].to_numpy() / BINS, bins["y"].to_numpy(), bins["n"].to_numpy())
    return scorer


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = described(docs, id_col, text_col)
    sent = send(docs.sparkSession, fit(rows, labels, label_col, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent()(_matrix(batch.column(2)))
            held = batch.column(1).to_numpy(zero_copy_only=False) == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(p), pa.array((p >= LEAST).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, score double, predicted int")
