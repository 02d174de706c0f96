"""Operator 10: toxicity by a classifier chain.

Features are the words of a whole text and the openings of its words, hashed,
present or not. A chain of linear models predicts the categories in order; each
later model also reads the probabilities of the earlier ones, and is trained
with out-of-fold probabilities, so that it sees errors of the kind it will meet.

The one label, toxic or not, is split by what carries it: ``explicit`` rows
hold a word that is common in toxic texts and rare in others, ``coded`` ones are
toxic without. The chain is explicit, coded, toxic.

Null and empty texts have no features and get the probabilities of the bias.
Labels other than 0 and 1 are left out. With no toxic or no clean label all
probabilities are 0. Repeated rows give repeated results. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import give_back, rows_of, send, span_hashes, tidied, utf8, word_spans
from refsieve.llm.learn import fold, sample, sigmoid

CATEGORIES = ("explicit", "coded", "toxic")
#: Bound of the labelled documents that the chain is trained on, gathered as feature numbers.
SAMPLE = 8_000
SELECTED, FOLDS, STEPS, DECAY = 384, 5, 150, 3e-5
#: Copies of each toxic row that keep each feature with a chance of THIN: evidence that mostly comes together must also do alone.
COPIES, THIN = 3, 0.3
#: A lifted feature: so many times as frequent in toxic texts, in so many of them at least. An explicit word: lifted, and in such a share of them.
LIFT, LEAST_ROWS, EXPLICIT_SHARE = 12.0, 3, 0.1
#: The probability from which a document counts as toxic.
LEAST = 0.5
OPENINGS = (4, 5, 6)
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = 1 << 20


def features(text: str | None) -> np.ndarray:
    """The distinct features of a whole text as uint32: even numbers for words, odd ones for openings of words."""
    words: set[bytes] = set()
    for at in range(0, len(text or ""), _STEP):  # a word cut at a chunk's end counts as two
        words.update(utf8(text[at : at + _STEP].lower()).translate(_FOLD).split())
    if not words:
        return np.empty(0, np.uint32)
    data, starts, ends = word_spans(sorted(words))
    high = np.uint64(32)
    found = [(span_hashes(data, starts, ends) >> high).astype(np.uint32) & np.uint32(0xFFFFFFFE)]
    for n in OPENINGS:
        if (long := ends - starts > n).any():
            found.append(((span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)) >> high).astype(np.uint32) | np.uint32(1))
    return np.unique(np.concatenate(found))


class Linear:
    """Logistic regression by Adam steps on all rows, the rarer class weighted up to a fifth of the whole."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        n, d = x.shape
        self.w, self.b = np.zeros(d, np.float32), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        weight = np.where(y > 0, max(1.0, 0.2 * n / max(1.0, y.sum())), 1.0).astype(np.float32)
        weight /= weight.mean()
        m, v, rate = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), 0.3
        for step in range(1, STEPS + 1):
            miss = ((sigmoid(x @ self.w + self.b) - y) * weight / n).astype(np.float32)
            grad = np.append(x.T @ miss + DECAY * self.w, miss.sum()).astype(np.float32)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w -= move[:-1].astype(np.float32)
            self.b -= float(move[-1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.w + self.b)


class Chain:
    def __init__(self, chosen: np.ndarray, models: list[Linear]) -> None:
        self.chosen, self.models = chosen, models

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """The categories' probabilities, from a text's features."""
        if not self.models:
            return np.zeros(len(CATEGORIES))
        x = np.isin(self.chosen, found).astype(np.float32)[None, :]
        for model in self.models:
            x = np.hstack([x, model(x)[:, None].astype(np.float32)])
        return x[0, len(self.chosen) :].astype(np.float64)


def train(rows: list[tuple[int, bytes]]) -> Chain:
    """From (toxic, features)."""
    y = np.array([r[0] for r in rows], np.float32)
    if not len(y) or not 0 < y.sum() < len(y):
        return Chain(np.empty(0, np.uint32), [])
    found = [np.frombuffer(f, np.uint32) for _, f in rows]
    names, flat = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    pos = np.bincount(flat, weights=y[owner], minlength=len(names))
    neg = np.bincount(flat, minlength=len(names)) - pos
    odds = np.log((pos + 0.1) / (y.sum() + 0.2)) - np.log((neg + 0.1) / (len(y) - y.sum() + 0.2))
    picked = np.sort(np.argsort(-np.abs(odds) * np.sqrt(pos), kind="stable")[:SELECTED])
    lifted = (odds > np.log(LIFT)) & (pos >= LEAST_ROWS)
    plain = lifted & (names % 2 == 0) & (pos >= EXPLICIT_SHARE * y.sum())
    at = np.full(len(names), -1)
    at[picked] = np.arange(len(picked))
    x = np.zeros((len(rows), len(picked)), np.float32)
    there = at[flat] >= 0
    x[owner[there], at[flat[there]]] = 1
    chosen, strong = names[picked], lifted[picked]
    explicit = np.bincount(owner, weights=plain[flat], minlength=len(rows)) > 0
    part, own = np.arange(len(rows)) % FOLDS, len(rows)
    rng = np.random.default_rng(9)
    for _ in range(COPIES):
        thin = x[:own] * (rng.random((own, len(chosen))) < THIN)
        good = (y[:own] > 0) & (thin[:, strong].any(axis=1))
        x, y, explicit, part = np.vstack([x, thin[good]]), np.append(y, y[:own][good]), np.append(explicit, explicit[:own][good]), np.append(part, part[:own][good])
    models, out = [], np.zeros(len(y))
    for target in (y * explicit, y * ~explicit, y):
        out = np.zeros(len(y), np.float32)
        for k in range(FOLDS):
            out[part == k] = Linear(x[part != k], target[part != k])(x[part == k])
        models.append(Linear(x, target))
        x = np.hstack([x, out[:, None]])
    return Chain(chosen, models)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Chain:
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    picked = sample(marked.where(fold() != 0), SAMPLE)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, y, features(text).tobytes()) for key, y, text in rows_of(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    # The sample is bounded, so its ids are broadcast to the scan of the texts; of each id one text is taken.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("bigint"), F.col("y").cast("bigint"), "text")
    found = texts.mapInArrow(tidied(run), "doc_id bigint, y bigint, found binary").groupBy("doc_id").agg(F.min(F.struct("y", "found")).alias("row"))
    chain = train(sorted((int(r.y), bytes(r.found)) for r in found.select("row.*").collect()))
    give_back()  # the driver lives on
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, p_explicit, p_coded, score, toxic."""
    sent = send(docs.sparkSession, chain)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.float64()) for c in ("p_explicit", "p_coded", "score")), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, held, text in rows_of(iter([batch])):
                p = sent()(features(text))
                rows.append((key, held, *map(float, p), bool(p[-1] >= LEAST)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    source = docs.select(F.col(id_col).cast("bigint"), (fold(id_col) == 0).alias("held"), F.col(text_col).cast("string"))
    return source.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, p_explicit double, p_coded double, score double, toxic boolean")
