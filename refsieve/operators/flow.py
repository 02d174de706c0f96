"""How work items come together: precedence of inputs, claims for scanned hits, cache and fresh records, and the whole audit.

Everything is a join or a filter on identifiers; which branch applies is decided
from the inputs that are given, not from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.operators import rollup, verify
from refsieve.sources import extract, files
from refsieve.sources.context import parse_context

c = F.col
CLAIM_FIELDS = ("claimed_title", "claimed_authors", "claimed_journal", "claimed_year", "claimed_doi")
#: Items above which a run deserves a note.
MANY_ITEMS = 2000


def chosen_input(ids: DataFrame | None, scanned: DataFrame | None, claims: DataFrame | None) -> DataFrame:
    """Ids before a source, which they make ignored; claims alone only if there is neither (P5)."""
    for rows in (ids, scanned, claims):
        if rows is not None:
            return rows
    raise ValueError("give ids, a source or claims")


def guard(items: DataFrame, most: int = MANY_ITEMS, key: str = "id") -> DataFrame:
    """One row: distinct items and whether that is above ``most``; 0 never warns."""
    n = items.agg(F.count_distinct(key).alias("n_items"))
    return n.withColumn("warn", (F.lit(most) > 0) & (c("n_items") > most))


def contexts(hits: DataFrame, key: str = "id") -> DataFrame:
    """(key, n_contexts, first_ord, first_context): repeated citations of one id; the first is what dedup keeps (A2)."""
    first = F.min_by("context", "input_ord")
    return hits.groupBy(key).agg(F.count("*").alias("n_contexts"), F.min("input_ord").alias("first_ord"), first.alias("first_context"))


def with_claims(hits: DataFrame, explicit: DataFrame, parsed: Column | None = None) -> DataFrame:
    """Scanned hits with the claim that the user gave for their id, else the one parsed from their context.

    ``explicit`` has id and the claimed columns, one row per id; ``parsed`` is a
    struct of the same, by default read from ``context``. ``explicit`` becomes
    true where a given claim was used.
    """
    given = explicit.select("id", F.struct(*[c(f) for f in CLAIM_FIELDS]).alias("__given"))
    rows = hits.join(given, "id", "left").withColumn("__parsed", parse_context(c("context")) if parsed is None else parsed)
    rows = rows.withColumn("explicit", c("__given").isNotNull())
    return rows.withColumns({f: F.when(c("explicit"), c("__given")[f]).otherwise(c("__parsed")[f]) for f in CLAIM_FIELDS}).drop("__given", "__parsed")


def split_by_cache(items: DataFrame, cache: DataFrame, now: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(held, missing): items whose record is cached and still holds, and those to be looked up."""
    known = rollup.fresh(cache, now).select(c("pmid").alias("__known")).distinct()
    on = c(key) == c("__known")
    return items.join(known, on, "left_semi"), items.join(known, on, "left_anti")


def records_of(items: DataFrame, cached: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Items with ``record``: the cached one, else the fresh one, else one that says it is missing; and ``from``, which."""
    fields = [f for f in cached.columns if f != "pmid" and f in fresh.columns]
    pack = lambda rows, name: rows.select(c("pmid").alias(key), F.struct(*[c(f) for f in fields]).alias(name))
    rows = items.join(pack(cached, "__c"), key, "left").join(pack(fresh, "__f"), key, "left")
    source = F.when(c("__c").isNotNull(), "cache").when(c("__f").isNotNull(), "fresh").otherwise("missing")
    return rows.withColumns({"record": F.coalesce("__c", "__f"), "from": source}).drop("__c", "__f")


def scanned_items(documents: DataFrame) -> DataFrame:
    """Work items of all identifiers in documents (path, basename, text): one pass over the texts for all kinds."""
    hits = extract.extract(documents.select("basename", "text"), key="basename")
    order = F.xxhash64("basename", "id_kind", "pos", "id")
    return hits.select("id", c("id_kind").alias("kind"), c("basename").alias("label"), F.lit(False).alias("explicit"), order.alias("input_ord"), "context")


def audit(items: DataFrame, registry: DataFrame, doi_records: DataFrame, arxiv_records: DataFrame, sequence: bool = True, key: str = "id") -> DataFrame:
    """All legs of work items with a ``kind``, each ``key`` once; DOIs of papers already verified by PMID are merged into those."""
    of = lambda kind, fold: verify.keep_first(items.where(c("kind") == kind), key, fold)
    pmids = verify.verify_pmid(of("pmid", False), registry, sequence)
    # Which papers are verified is asked of the registry; the graded rows would be graded once more for it.
    known = verify.with_registry(items.where("kind = 'pmid'").select("id"), registry)
    dois = verify.verify_doi(verify.doi_merged(of("doi", True), known), doi_records, registry, sequence)
    arxiv = verify.verify_arxiv(of("arxiv", True), arxiv_records, registry, sequence)
    titles = verify.title_search(of("title", False), registry, sequence)
    return rollup.union_legs(pmids, dois, arxiv, titles)


def audit_folder(spark: SparkSession, folder: str, explicit: DataFrame, registry: DataFrame, doi_records: DataFrame, arxiv_records: DataFrame) -> DataFrame:
    """From files to graded rows: scan, extract, claims, legs."""
    items = with_claims(scanned_items(files.scan(spark, folder)), explicit)
    return audit(items, registry, doi_records, arxiv_records)
