"""Operator 1: language identification by averaged hashed subword embeddings and a linear softmax.

A text's letters are case-folded and split into words; the byte n-grams of each
word with its borders are hashed to ``BUCKETS``. The mean of their embeddings
goes through a linear softmax. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on at most ``SAMPLE`` labelled texts. A
temperature and the rejection threshold are then set on a fifth of that sample
that the descent did not see.

Null texts and texts without a letter are `und`, score 0, rejected. Every other
text gets a learned language; ``rejected`` tells whether the calibrated score is
below the threshold. Without any labelled text all are `und`. Long texts are
hashed whole, in pieces that end between words. Repeated rows give repeated results, ties go to the
language first in order; extra columns are not read by ``predict`` and are kept
by ``keep_known``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import give_back, keep_rows, mix, pieces, rows_of, send, tidied, utf8
from refsieve.llm.learn import fold, sample, softmax, temperature

BUCKETS, WIDTH = 1 << 13, 16
SIZES = (1, 2, 3, 4)
#: Bound of the labelled texts that the model is trained on, and that are gathered on the driver as bucket counts.
SAMPLE = 2_500
STEPS, BATCH, RATE = 744, 32, 0.5
CHUNK = 1 << 18
#: The largest share of accepted texts that may be wrong, and the largest share of known texts that may be rejected, on the calibration fold.
ERROR, LOSS = 0.01, 0.002
_OTHER = re.compile(r"[\W\d_]+")


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in a whole text; None without a letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    total = np.zeros(BUCKETS, np.int64)
    for piece in pieces(text.lower(), CHUNK, _OTHER):
        data = np.frombuffer(utf8(" " + _OTHER.sub(" ", piece) + " "), np.uint8)
        code, blank = data.astype(np.uint64), data == 32
        gram = np.zeros(len(data), np.uint64)
        inner = np.zeros(len(data), bool)  # a blank inside, so not one word's
        for n in range(1, max(SIZES) + 1):
            if n > len(data):
                break
            gram = gram[: len(data) - n + 1] * np.uint64(257) + code[n - 1 :]
            inner = inner[: len(data) - n + 1]
            if n > 2:
                inner = inner | blank[n - 2 : len(data) - 1]
            if n in SIZES:
                keep = ~inner & ~(blank[: len(gram)] & blank[n - 1 :])
                total += np.bincount((mix(gram[keep] + np.uint64(n << 40)) >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    return total


class Model:
    """Languages, bucket weights (embeddings times softmax) and bias, temperature and threshold."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, heat: float, least: float) -> None:
        self.names, self.weights, self.bias, self.heat, self.least = names, weights, bias, heat, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = counts(text)
        if found is None or not self.names or not found.any():
            return "und", 0.0, True
        at = np.flatnonzero(found)
        logits = (found[at] @ self.weights[at]) / found[at].sum() + self.bias
        p = softmax(logits / self.heat)
        best = int(np.argmax(p))
        return self.names[best], float(p[best]), bool(p[best] < self.least)


def train(rows: list[tuple[str, bytes, bytes]], seed: int = 3) -> Model:
    """From (language, bucket indexes as uint16, counts as float32)."""
    names = sorted({lang for lang, _, _ in rows})
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names)), 1.0, 0.0)
    found = [(np.frombuffer(at, np.uint16), np.frombuffer(n, np.float32)) for _, at, n in rows]
    y = np.array([names.index(lang) for lang, _, _ in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, seen = order[: len(rows) // 5], order[len(rows) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)

    def share(at: np.ndarray, short: bool) -> np.ndarray:
        part = np.zeros((len(at), BUCKETS), np.float32)
        for i, (where, n) in enumerate(found[j] for j in at):
            if short:  # as if the text were short: a few of its n-grams
                n = rng.multinomial(rng.integers(3, 80), n.astype(np.float64) / n.sum(dtype=np.float64))
            part[i, where] = n / n.sum()
        return part

    order = iter(())
    for step in range(STEPS):  # as many for a small table as for a full sample
        if (at := next(order, None)) is None:
            order = iter(np.array_split(rng.permutation(seen), max(1, len(seen) // BATCH)))
            at = next(order)
        rate = RATE * 40 * (1 - step / STEPS)
        mean = share(at, rng.random() < 0.5)
        hidden = mean @ emb
        grad = softmax(hidden @ out + bias)
        grad[np.arange(len(at)), y[at]] -= 1
        grad /= len(at)
        back = grad @ out.T
        out -= RATE * 4 * hidden.T @ grad
        bias -= 0.02 * grad.sum(0)
        emb -= rate * mean.T @ back
    weights = emb @ out
    if not len(held):
        return Model(names, weights, bias, 1.0, 0.0)
    # A batch at a time: only one batch's bucket matrix is ever held.
    logits = np.concatenate([share(at, short) @ weights + bias for short in (False, True, True, True) for at in np.array_split(held, -(-len(held) // BATCH))])
    truth = np.tile(y[held], 4)
    heat = temperature(logits, truth)
    p = softmax(logits / heat)
    return Model(names, weights, bias, heat, threshold(p.max(1), p.argmax(1) == truth))


def threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The least score at which accepted texts err by at most ERROR, but never one that rejects over LOSS of the right ones."""
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= ERROR)
    least = score[order][good[-1]] if len(good) else 1.0
    return float(min(least, np.quantile(score[right], LOSS) if right.any() else 0.0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on labelled rows outside the held-out fold."""
    ddl = "lang string, at binary, n binary"
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang in rows_of(iter([batch])):
                found = counts(text)
                if found is not None and found.any():
                    at = np.flatnonzero(found)
                    rows.append((lang, at.astype(np.uint16).tobytes(), found[at].astype(np.float32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    learnable = docs.where(F.col(lang_col).isNotNull() & (fold(id_col) != 0)).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    picked = sample(learnable, SAMPLE).select("text", "lang").mapInArrow(tidied(run), ddl).collect()
    model = train(sorted((r.lang, bytes(r.at), bytes(r.n)) for r in picked))
    del picked
    give_back()  # the driver lives on
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    sent = send(docs.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, held, *sent().predict(text)) for key, held, text in rows_of(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    source = docs.select(F.col(id_col).cast("bigint"), (fold(id_col) == 0).alias("held"), F.col(text_col).cast("string"))
    return source.mapInArrow(tidied(run), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the texts that the model rejects."""
    sent = send(docs.sparkSession, model)
    at = docs.columns.index(text_col)
    return keep_rows(docs, lambda batch: np.array([not sent().predict(v.as_py())[2] for v in batch.column(at)], bool))


