"""Claims and registries made from the driver's tables, which hold no citations.

Integer arithmetic only, so that DuckDB builds the same rows; each view exists as
a DataFrame and as SQL, next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generated rows.
JOURNALS = ("New England Journal of Medicine", "Pediatric Rheumatology", "Annals of the Rheumatic Diseases", "The Lancet", "Journal of Clinical Immunology")
SHORT = ("N Engl J Med", "Pediatr Rheumatol", "Ann Rheum Dis", "Lancet", "J Clin Immunol")
FAMILIES = ("Ravelli", "Martini", "Zaripova", "Midgley", "Christmas", "Smith", "Garcia")
CLASSES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _authors(k: Column) -> Column:
    return F.array(*[F.concat(_pick(FAMILIES, k + i), F.lit(f" {mark}")) for i, mark in enumerate("AB")], F.concat(_pick(FAMILIES, k + 2), F.lit(" C")))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a registered paper; some are not found, some unreachable, some retracted."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    return rows.select(
        (k + 10_000_000).cast("string").alias("pmid"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"), F.lit("trial"), F.concat(F.lit("k"), k.cast("string"))).alias("title"),
        _authors(k).alias("authors"), _pick(JOURNALS, F.col("p_size")).alias("journal"), F.concat((F.col("p_size") % 30 + 1990).cast("string"), F.lit(" Dec")).alias("pubdate"),
        (k % 40 + 1).cast("string").alias("volume"), F.when(k % 3 == 0, (k % 12 + 1).cast("string")).alias("issue"), (k % 900 + 1).cast("string").alias("pages"),
        F.concat(F.lit("10.1000/part."), k.cast("string")).alias("doi"), ((k % 41 != 0) & (k % 53 != 0)).alias("valid"), ((k % 53 == 0) & (k % 41 != 0)).alias("network_error"), (k % 97 == 0).alias("retracted"),
        F.when(k % 5 != 0, (k % 1000).cast("int")).alias("cited_by_count"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a citation of a part, right or wrong in one of eight ways; a third is scanned, not vouched for."""
    o = F.col("o_orderkey")
    part = registry(spark, sf_dir).select(F.col("pmid").alias("id"), "title", "authors", "journal", "pubdate", "doi")
    # The file is one row group and so one task; real claims come in many, so these are dealt to all cores.
    orders = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism)
    rows = orders.select(o.alias("input_ord"), "o_custkey", (o % CLASSES).alias("class"), (F.col("o_custkey") + 10_000_000).cast("string").alias("id"))
    rows = rows.join(part, "id")
    kind, key = F.col("class"), F.col("o_custkey")
    title = F.when(kind.isin(1, 2), F.when(kind == 1, F.concat(F.lit("unrelated survey number "), (key % 17).cast("string")))).when(kind == 6, F.concat(F.lit("trial of "), F.regexp_replace("title", " trial ", " "))).otherwise(F.col("title"))
    authors = F.when(kind.isin(3, 7), F.lit(None)).when(kind == 4, F.array(F.lit("Nobody X"), F.lit("Noone Y"))).otherwise(F.transform(F.slice("authors", 1, 2), lambda a: F.regexp_extract(a, r"^(\S+)", 1)))
    journal = F.when(kind.isin(5, 7), F.when(kind == 5, F.lit("Acta Botanica"))).when(key % 2 == 0, F.col("journal")).otherwise(_pick(SHORT, F.array_position(F.array(*map(F.lit, JOURNALS)), F.col("journal")) - 1))
    year = F.when(kind == 7, F.lit(None)).when(kind == 5, F.lit("2024")).otherwise(F.regexp_extract("pubdate", r"(\d{4})", 1))
    doi = F.when(kind == 5, F.lit("https://doi.org/10.1000/OTHER.1")).when(key % 4 == 0, F.concat(F.lit("doi:"), F.upper("doi"), F.lit(".")))
    return rows.select("id", F.when(F.col("input_ord") % 3 == 0, "scan.txt").otherwise("claims").alias("label"), (F.col("input_ord") % 3 != 0).alias("explicit"), "input_ord", "class", title.alias("claimed_title"), authors.alias("claimed_authors"), journal.alias("claimed_journal"), year.alias("claimed_year"), doi.alias("claimed_doi"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql() -> str:
    """CTEs registry and claims with the same rows."""
    name = lambda i: f"{_list(FAMILIES)}[((p_partkey + {i}) % {len(FAMILIES)}) + 1]"
    return f"""registry AS (
  SELECT CAST(p_partkey + 10000000 AS VARCHAR) AS pmid,
         p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) || ' trial k' || p_partkey AS title,
         [{name(0)} || ' A', {name(1)} || ' B', {name(2)} || ' C'] AS authors,
         {_list(JOURNALS)}[(p_size % 5) + 1] AS journal, CAST(p_size % 30 + 1990 AS VARCHAR) || ' Dec' AS pubdate,
         CAST(p_partkey % 40 + 1 AS VARCHAR) AS volume, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 12 + 1 AS VARCHAR) END AS issue, CAST(p_partkey % 900 + 1 AS VARCHAR) AS pages,
         '10.1000/part.' || p_partkey AS doi, (p_partkey % 41 <> 0 AND p_partkey % 53 <> 0) AS valid,
         (p_partkey % 53 = 0 AND p_partkey % 41 <> 0) AS network_error, (p_partkey % 97 = 0) AS retracted,
         CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 1000 AS INTEGER) END AS cited_by_count
  FROM part
), claims AS (
  SELECT id, CASE WHEN input_ord % 3 = 0 THEN 'scan.txt' ELSE 'claims' END AS label, input_ord % 3 <> 0 AS explicit, input_ord, class,
         CASE WHEN class = 1 THEN 'unrelated survey number ' || (o_custkey % 17) WHEN class = 2 THEN NULL WHEN class = 6 THEN 'trial of ' || replace(title, ' trial ', ' ') ELSE title END AS claimed_title,
         CASE WHEN class IN (3, 7) THEN NULL WHEN class = 4 THEN ['Nobody X', 'Noone Y'] ELSE [split_part(authors[1], ' ', 1), split_part(authors[2], ' ', 1)] END AS claimed_authors,
         CASE WHEN class = 5 THEN 'Acta Botanica' WHEN class = 7 THEN NULL WHEN o_custkey % 2 = 0 THEN journal ELSE {_list(SHORT)}[list_position({_list(JOURNALS)}, journal)] END AS claimed_journal,
         CASE WHEN class = 7 THEN NULL WHEN class = 5 THEN '2024' ELSE regexp_extract(pubdate, '(\\d{{4}})', 1) END AS claimed_year,
         CASE WHEN class = 5 THEN 'https://doi.org/10.1000/OTHER.1' WHEN o_custkey % 4 = 0 THEN 'doi:' || upper(doi) || '.' END AS claimed_doi
  FROM (SELECT o_orderkey AS input_ord, o_custkey, o_orderkey % {CLASSES} AS class, CAST(o_custkey + 10000000 AS VARCHAR) AS id FROM orders) o
  JOIN (SELECT pmid AS id, title, authors, journal, pubdate, doi FROM registry) r USING (id)
)"""
