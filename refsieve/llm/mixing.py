"""Operator 3: mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Token counts by (source, language, topic) cell are raked to target shares of
each of the three marginals, ``ROUNDS`` times over. With r a cell's raked
tokens over its actual tokens, its documents have the probability min(1, r) and
the weight max(1, r), so that the sample's expected weighted tokens are the
raked ones, in under-represented cells too. A document is kept if a hash of its
id and the seed falls below its probability.

Null source, language or text are the groups "", "" and an empty text of no
tokens; a document without tokens has the probability of its cell, which is 0 if
the cell has no tokens. Targets default to ``balanced``: each value's share of a
marginal is proportional to the square root of its tokens. A target value that
the table lacks is left out and the rest is scaled to one; if it lacks all of a
marginal, or has no tokens, nothing is sampled. Repeated rows get
the same probability and draw; an empty table gives an empty result. Extra
columns are ignored by ``weigh`` and kept by ``mix``, which names its own apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import written

ROUNDS = 12
SEED = "mix-1"
#: Cells, or values of a dimension (about 60 bytes each), up to this many are broadcast.
BROADCAST_CELLS = 500_000
DIMENSIONS = ("source", "lang", "topic")
#: Patterns of the topics, first match wins, else prose.
TOPICS = (("table", r"\|[^|\n]*\|"), ("legal", r"[Ll]icen[sc]e|rights reserved|[Cc]opyright"), ("noise", r"[%$*&#]{3}|!!"), ("contact", r"[0-9]{3}|@"))


def topic_of(text: Column) -> Column:
    """The topic of a text by ``TOPICS``; null text is prose."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    parts = F.split(text, r"[\x20\x09-\x0D]+", -1)
    edges = (F.element_at(parts, 1) == "").cast("bigint") + (F.element_at(parts, -1) == "").cast("bigint")
    return F.when(F.length(text) > 0, F.greatest(F.size(parts).cast("bigint") - edges, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id's text, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))


def _goals(cells: DataFrame, name: str, targets: dict[str, float] | None) -> DataFrame:
    """(name, goal_<name>): the target share of each value of one dimension."""
    sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("mass"))
    if targets is None:
        share = F.sqrt("mass")
    else:
        share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("value")), F.lit(0.0))
    shares = sums.select("value", share.alias("share"))
    whole = shares.agg(F.sum("share").alias("whole"))  # one row
    return shares.crossJoin(F.broadcast(whole)).select(F.col("value").alias(name), F.coalesce(F.try_divide("share", "whole"), F.lit(0.0)).alias(f"goal_{name}"))


def _scaled(cells: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``raked``: its tokens times the factor of its value in each dimension of ``factors``."""
    raked = F.col("tokens").cast("double")
    for name, table in factors.items():
        cells = cells.join(table.select(F.col("value").alias(name), F.col("factor").alias(f"by_{name}")), name)
        raked = raked * F.col(f"by_{name}")
    return cells.withColumn("raked", raked).drop(*[f"by_{name}" for name in factors])


def fitted(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, probability, weight) from ``cells`` (source, lang, topic, tokens).

    A cell's raked tokens are its tokens times one factor for each dimension. A
    step sums the cells by the values of one dimension, scaled by the factors of
    the others, and sets its factors to goal over sum. The sums are combined
    before they are shuffled, so a value that most cells share makes no large
    task; what a step writes to the shared folder is a row for each value.
    """
    cells = written(cells, "cells")
    goals = {name: written(_goals(cells, name, (targets or {}).get(name)), f"goals-{name}") for name in DIMENSIONS}
    few = {name: goals[name].count() <= BROADCAST_CELLS for name in DIMENSIONS}

    def sized(name: str, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few[name] else table

    for name in DIMENSIONS:
        cells = cells.join(sized(name, goals[name]), name)
    cells = written(cells, "cells-goals")
    factors: dict[str, DataFrame] = {}
    for _ in range(rounds):
        for name in DIMENSIONS:
            others = {other: table for other, table in factors.items() if other != name}
            sums = _scaled(cells, others).groupBy(F.col(name).alias("value")).agg(F.sum("raked").alias("mass"), F.min(f"goal_{name}").alias("goal"))
            factor = F.when(F.col("mass") > 0, F.col("goal") / F.col("mass")).otherwise(0.0).alias("factor")
            factors[name] = sized(name, written(sums.select("value", factor), f"factors-{name}"))
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))  # one row
    ratio = F.when(F.col("tokens") > 0, F.col("raked") * F.col("total") / F.col("tokens")).otherwise(0.0)
    return _scaled(cells, factors).crossJoin(F.broadcast(total)).select(*DIMENSIONS, F.round(F.least(F.lit(1.0), ratio), 9).alias("probability"), F.round(F.greatest(F.lit(1.0), ratio), 9).alias("weight"))


def described(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> list[Column]:
    """The columns source, lang, topic and n_tokens, computed from a row."""
    return [F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), topic_of(F.col(text_col)).alias("topic"), tokens_of(F.col(text_col)).alias("n_tokens")]


def _join(rows: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """Each row with its cell's weight; cells are broadcast while they are few, else joined by a shuffle that can split hot cells."""
    weights = written(weights, "weights")
    return rows.join(F.broadcast(weights) if weights.count() <= BROADCAST_CELLS else weights, on, "left")


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, weight, kept."""
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *described(docs, text_col, source_col, lang_col)), "described")
    weights = fitted(cells_of(rows), targets)
    out = _join(rows, weights, list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "probability", "weight", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled documents: all columns of ``docs``, and ``mix_topic`` and ``mix_weight`` after them.

    A new column whose name is taken gets the first free one of mix_weight_2, mix_weight_3 and so on.
    """
    own = described(docs, text_col, source_col, lang_col)
    weights = fitted(cells_of(docs.select(*own)), targets)
    names = {"source": "__refsieve_source", "lang": "__refsieve_lang", "topic": "__refsieve_topic"}
    taken = {c.lower() for c in docs.columns}
    rows = docs.select("*", *[c.alias(names[n]) for c, n in zip(own, DIMENSIONS, strict=False)])
    out = _join(rows, weights.withColumnsRenamed(names | {"probability": "__refsieve_p", "weight": "__refsieve_weight"}), list(names.values()))
    kept = out.where(draw(F.col(id_col), seed) < F.col("__refsieve_p"))
    return kept.select(*docs.columns, *[F.col(f"__refsieve_{c}").alias(free_name(f"mix_{c}", taken)) for c in ("topic", "weight")])


def free_name(name: str, taken: set[str]) -> str:
    return name if name not in taken else next(new for i in range(2, len(taken) + 3) if (new := f"{name}_{i}") not in taken)
