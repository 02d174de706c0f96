"""Counters, readiness, ledger, differences, ordering, cache, and lint of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refsieve.functions.text import arxiv_valid
from refsieve.operators.lint import with_first
from refsieve.plans.schemas import CACHE_DAYS, NEGATIVE_CACHE_DAYS

VERDICTS = ("correct", "mismatch", "partial", "invalid", "unknown")
_FLAGS = ("retracted", "doi_splice", "arxiv_doi_mismatch", "wrong_pmid_signal", "unmatched", "retried_recovered", "breaker_skipped")
_ROUTES = {"existence_only": "existence_only", "mismatch_gated": "mismatch_gated", "existence_title_match": "existence_title_match", "title_corroborated": "title_corroborated"}


def union_legs(*legs: DataFrame) -> DataFrame:
    """All legs in order; columns that a leg lacks are null."""
    out = legs[0].withColumn("leg", F.lit(0))
    for i, leg in enumerate(legs[1:], 1):
        out = out.unionByName(leg.withColumn("leg", F.lit(i)), allowMissingColumns=True)
    return out


def counters(rows: DataFrame) -> list[Column]:
    """The counters of a run, as aggregates over ``rows``."""
    have = set(rows.columns)
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    aggs = [F.count("*").alias("total"), *[count(F.col("verdict") == v).alias(v) for v in VERDICTS]]
    aggs += [(count(F.col(f)) if f in have else F.lit(0).cast("long")).alias(f) for f in _FLAGS]
    aggs += [(count(F.col("route") == r) if "route" in have else F.lit(0).cast("long")).alias(n) for r, n in _ROUTES.items()]
    aggs.append((count(F.col("network_error")) if "network_error" in have else F.lit(0).cast("long")).alias("network_errors"))
    of = lambda kind, when: count((F.col("kind") == kind) & when) if "kind" in have else F.lit(0).cast("long")
    aggs += [of("doi", F.col("valid")).alias("doi_resolved") if "valid" in have else F.lit(0).cast("long").alias("doi_resolved"), of("arxiv", F.col("verdict") == "invalid").alias("arxiv_invalid"), (count(F.col("merged_into").isNotNull()) if "merged_into" in have else F.lit(0).cast("long")).alias("doi_merged_into_pmid")]
    return aggs


def stats(rows: DataFrame) -> DataFrame:
    """One row of counters, by conditional counts in one pass."""
    return rows.agg(*counters(rows))


def delta_counts(changes: DataFrame) -> DataFrame:
    """Rows of ``delta`` by category."""
    return changes.groupBy("category").agg(F.count("*").alias("n"))


def source_mix(rows: DataFrame, source: str = "meta_source") -> DataFrame:
    """By source of the metadata: rows, correct ones and their share in percent."""
    correct = F.count_if(F.col("verdict") == "correct")
    return rows.groupBy(source).agg(F.count("*").alias("n"), correct.alias("correct"), F.round(100.0 * correct / F.count("*"), 2).alias("percent"))


def breaker_rejects(calls: DataFrame) -> DataFrame:
    """Rejected calls (url) by host, most first (A10)."""
    return calls.groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host")


def subset(rows: DataFrame, verdicts: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one of the verdicts or with one of the flags; of neither, all (P10)."""
    if not verdicts and not flags:
        return rows
    wanted = F.col("verdict").isin(*verdicts)
    for flag in flags:
        wanted = wanted | F.coalesce(F.col(flag), F.lit(False))
    return rows.where(wanted)


def readiness(counts: DataFrame) -> DataFrame:
    """ready, problems, line and exit_code from ``stats``. Partial rows are no problem; network failures block."""
    c = F.col
    problems = c("invalid") + c("mismatch") + c("retracted") + c("doi_splice") + c("arxiv_doi_mismatch")
    checked_only = F.greatest(c("unknown") - c("network_errors"), F.lit(0))
    part = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {text}")))
    parts = F.concat_ws(", ", part(c("invalid"), "invalid"), part(c("mismatch"), "mismatched"), part(c("retracted"), "retracted"), part(c("doi_splice"), "DOI-spliced"), part(c("arxiv_doi_mismatch"), "arXiv-DOI pairing mismatch"), part(c("network_errors"), "unverified (network)"), part(checked_only, "existence-checked only"))
    ready = (problems == 0) & (c("network_errors") == 0)
    good = F.concat(F.lit("SUBMISSION READY"), F.when(checked_only > 0, F.concat(F.lit("; "), checked_only.cast("string"), F.lit(" existence-checked only"))).otherwise(""))
    return counts.select(ready.alias("ready"), problems.alias("problems"), F.when(ready, good).otherwise(F.concat(F.lit("NOT SUBMISSION-READY — "), parts)).alias("line"), F.when(c("network_errors") > 0, 2).when(problems > 0, 1).otherwise(0).alias("exit_code"))


def ledger(rows: DataFrame) -> DataFrame:
    """key, bucket (answered, partially, unresolved) and why, for every row."""
    bucket = F.when(F.col("verdict").isin("correct", "mismatch", "invalid"), "answered").when(F.col("verdict") == "partial", "partially").otherwise("unresolved")
    why = F.when(bucket == "answered", F.when(F.col("route") == "existence_only", "existence").otherwise(F.col("verdict"))).when((bucket == "unresolved") & F.coalesce("network_error", F.lit(False)), "network — retry when reachable").otherwise(F.substring("details", 1, 100))
    return rows.select(F.col("id").alias("key"), "input_ord", bucket.alias("bucket"), why.alias("why"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, category) of two runs' rows (key, verdict, retracted; new: network_error too), keyed alike on both sides.

    A full outer join; a row may be newly retracted and new at once.
    """
    bad = ["mismatch", "invalid", "unknown"]
    o = old.select("key", F.col("verdict").alias("was"), F.coalesce("retracted", F.lit(False)).alias("old_retracted"), F.lit(True).alias("in_old"))
    n = new.select("key", F.col("verdict").alias("now"), F.coalesce("retracted", F.lit(False)).alias("new_retracted"), F.coalesce("network_error", F.lit(False)).alias("down"), F.lit(True).alias("in_new"))
    both = o.join(n, "key", "full_outer")
    retracted = F.col("in_new") & F.col("new_retracted") & ~F.coalesce("old_retracted", F.lit(False))
    here, there = F.coalesce("in_new", F.lit(False)), F.coalesce("in_old", F.lit(False))
    change = F.when(here & ~there, "new").when(there & ~here, "dropped").when((F.col("was") == "correct") & F.col("now").isin(bad) & ~F.col("new_retracted") & ~F.col("down"), "degraded").when(F.col("was").isin(bad) & (F.col("now") == "correct"), "improved")
    found = F.filter(F.array(F.when(retracted, "newly_retracted"), change), lambda x: x.isNotNull())
    return both.select("key", F.explode(found).alias("category"), "was", "now")


SEVERITY = {"mismatch": 1, "invalid": 2, "partial": 3, "unknown": 4, "correct": 5}


def severity(verdict: Column, flagged: Column) -> Column:
    rank = F.lit(9)
    for name, value in SEVERITY.items():
        rank = F.when(verdict == name, value).otherwise(rank)
    return F.when(F.coalesce(flagged, F.lit(False)), 0).otherwise(rank)


def by_severity(rows: DataFrame) -> DataFrame:
    """``rows`` with ``severity``, sorted by it and the input order."""
    return rows.withColumn("severity", severity(F.col("verdict"), F.col("retracted") | F.col("doi_splice"))).orderBy("severity", "input_ord")


def cited_rank(count: str = "cited_by_count", order: str = "input_ord") -> list[Column]:
    return [F.col(count).isNotNull().desc(), F.coalesce(count, F.lit(0)).desc(), F.col(order).asc()]


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    """Cache rows that still hold: found ones longer than not-found ones."""
    days = F.when(F.col("valid"), CACHE_DAYS).otherwise(min(CACHE_DAYS, NEGATIVE_CACHE_DAYS))
    return cache.where(F.col("cached_at") > now - F.make_dt_interval(days))


def upserted(cache: DataFrame, found: DataFrame, key: str = "pmid") -> DataFrame:
    """The cache with new records over old ones, latest first; network failures are never stored."""
    rows = cache.unionByName(found.where(~F.coalesce("network_error", F.lit(False))).select(*cache.columns))
    others = [c for c in cache.columns if c not in (key, "cached_at")]
    order = Window.partitionBy(key).orderBy(F.col("cached_at").desc(), *others)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def lint(claims: DataFrame) -> DataFrame:
    """(input_ord, tag, severity) of claims rows (input_ord, pmid, doi, arxiv_id, title); the rules that the claims array's own columns allow; ``lint.claims`` has all."""
    c = F.col
    text = lambda k: F.trim(F.coalesce(c(k), F.lit("")))
    key = F.coalesce(*[F.nullif(text(k), F.lit("")) for k in ("pmid", "doi", "arxiv_id")])
    rows = with_first(claims.withColumn("__key", key), order="input_ord")
    rules = [
        (key.isNull(), "missing_id", "ERROR"),
        (text("pmid").rlike(r"\D"), "pmid_not_digits", "ERROR"),
        ((text("arxiv_id") != "") & ~arxiv_valid(text("arxiv_id")), "arxiv_shape", "ERROR"),
        ((text("doi") != "") & ~F.lower(text("doi")).rlike(r"^(https?://(dx\.)?doi\.org/|doi:\s*)?10\.\d{4,9}/"), "doi_prefix", "WARN"),
        (c("input_ord") > c("__first"), "duplicate_key", "WARN"),
        (text("title") == "", "no_title", "WARN"),
    ]
    issues = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(tag).alias("tag"), F.lit(level).alias("severity"))) for when, tag, level in rules])
    return rows.select("input_ord", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select("input_ord", "i.tag", "i.severity")


def numbered_entries(lines: DataFrame, key: str, order: str, start: Column) -> DataFrame:
    """Lines with the number of the entry that they belong to: a running count of starts."""
    return lines.withColumn("entry", F.sum(start.cast("long")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
