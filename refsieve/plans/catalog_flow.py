"""More named queries: lint, joins of inputs with claims, cache and links, registry decoding, changes and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.operators import cache, export, flow, lint, rollup, verify
from refsieve.operators.durable import shared_folder
from refsieve.plans import oracles, synth
from refsieve.plans.catalog import _ARXIV_LEG, _CACHE, _CHANGES, _DOI, _PMID, _arxiv, _cache, _candidates, _delta, _doi_records, _rows, _title_leg, query
from refsieve.sources import bibliography, blocks, records, sheets
from refsieve.streaming import citations

c = F.col
_SYNTH = f"WITH {synth.sql()}"


def _key(column: str = "pmid") -> Column:
    return c(column).cast("long") - 10_000_000


# Lint

_SHEET = """SELECT o_orderkey AS line, CASE WHEN o_orderkey % 8 = 0 THEN 'x1' WHEN o_orderkey % 8 IN (1, 2, 5, 6) THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS pmid,
  CASE WHEN o_orderkey % 8 = 1 THEN '11.1/x' WHEN o_orderkey % 8 = 5 THEN 'https://doi.org/10.1000/A.' || (o_custkey % 50) END AS doi,
  CASE WHEN o_orderkey % 8 = 2 THEN CASE WHEN o_custkey % 2 = 0 THEN '2113.00001' ELSE '2101.' || lpad(CAST(o_custkey % 99 AS VARCHAR), 5, '0') END END AS arxiv_id,
  CASE WHEN o_orderkey % 8 = 6 THEN CASE WHEN o_orderkey % 16 = 6 THEN ' ' ELSE 'lone title' END WHEN o_orderkey % 5 = 0 THEN '' ELSE 'a title' END AS title FROM orders"""


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    o, k = c("o_orderkey"), c("o_custkey")
    arxiv = F.when(k % 2 == 0, "2113.00001").otherwise(F.concat(F.lit("2101."), F.lpad((k % 99).cast("string"), 5, "0")))
    return synth.table(spark, d, "orders").select(
        o.alias("line"), F.when(o % 8 == 0, "x1").when(~(o % 8).isin(1, 2, 5, 6), k.cast("string")).alias("pmid"),
        F.when(o % 8 == 1, "11.1/x").when(o % 8 == 5, F.concat(F.lit("https://doi.org/10.1000/A."), (k % 50).cast("string"))).alias("doi"), F.when(o % 8 == 2, arxiv).alias("arxiv_id"),
        F.when(o % 8 == 6, F.when(o % 16 == 6, " ").otherwise("lone title")).when(o % 5 == 0, "").otherwise("a title").alias("title"),
    )


_SHEET_ISSUES = f"""r AS (
  SELECT *, CASE WHEN regexp_matches(pmid, '^[0-9]+$') THEN 'pmid ' || pmid WHEN arxiv_id IS NOT NULL THEN 'arxiv ' || lower(arxiv_id) WHEN doi IS NOT NULL THEN 'doi ' || {oracles.clean_doi('doi')} END AS key,
         pmid IS NULL AND doi IS NULL AND arxiv_id IS NULL AS bare FROM ({_SHEET})
), n AS (SELECT *, min(line) OVER (PARTITION BY key) AS first FROM r
), issues AS (
  SELECT line, 'blank_row' AS tag, 'INFO' AS severity FROM n WHERE bare AND trim(title) = '' UNION ALL SELECT line, 'missing_id', 'ERROR' FROM n WHERE bare AND trim(title) <> ''
  UNION ALL SELECT line, 'pmid_not_digits', 'ERROR' FROM n WHERE pmid = 'x1' UNION ALL SELECT line, 'arxiv_shape', 'ERROR' FROM n WHERE arxiv_id = '2113.00001'
  UNION ALL SELECT line, 'doi_prefix', 'ERROR' FROM n WHERE doi = '11.1/x' UNION ALL SELECT line, 'no_title', 'WARN' FROM n WHERE NOT bare AND title = ''
  UNION ALL SELECT line, 'duplicate_key', 'WARN' FROM n WHERE key IS NOT NULL AND line > first
)"""


@query(f"WITH {_SHEET_ISSUES} SELECT * FROM issues")
def lint_sheet(spark: SparkSession, d: str) -> DataFrame:
    return lint.sheet(_sheet(spark, d)).drop("message")


@query(f"WITH {_SHEET_ISSUES} SELECT severity, count(*) AS n FROM issues GROUP BY severity")
def lint_severities(spark: SparkSession, d: str) -> DataFrame:
    return lint.severity_counts(lint.sheet(_sheet(spark, d)))


@query(f"WITH {_SHEET_ISSUES} SELECT count_if(severity = 'ERROR') AS errors, count_if(severity = 'WARN') AS warnings, count_if(severity = 'INFO') AS infos, CAST(max(CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END) AS INT) AS exit_code FROM issues")
def lint_outcome(spark: SparkSession, d: str) -> DataFrame:
    return lint.outcome(lint.sheet(_sheet(spark, d)))


@query("""WITH r AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'pmid ' || o_custkey END AS key, o_orderkey % 9 = 0 AS broken, o_orderkey % 4 = 0 AS misspelt, o_orderkey % 3 = 0 AS text_authors, o_orderkey % 7 = 0 AS untitled FROM orders),
n AS (SELECT *, min(line) OVER (PARTITION BY key) AS first FROM r)
SELECT line, 'not_an_object' AS tag, 'ERROR' AS severity FROM n WHERE broken UNION ALL SELECT line, 'unknown_key', 'WARN' FROM n WHERE misspelt AND NOT broken
UNION ALL SELECT line, 'authors_type', 'WARN' FROM n WHERE text_authors AND NOT broken UNION ALL SELECT line, 'no_title', 'WARN' FROM n WHERE untitled AND NOT broken
UNION ALL SELECT line, 'duplicate_key', 'WARN' FROM n WHERE NOT broken AND line > first""")
def lint_claims(spark: SparkSession, d: str) -> DataFrame:
    o = c("o_orderkey")
    keys = F.when(o % 9 != 0, F.when(o % 4 == 0, F.array(F.lit("pmid"), F.lit("titel"))).otherwise(F.array(F.lit("pmid"), F.lit("title"))))
    rows = synth.table(spark, d, "orders").select(o.alias("line"), F.when(o % 9 != 0, c("o_custkey").cast("string")).alias("pmid"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.when(o % 7 != 0, "a title").alias("title"), F.when(o % 3 == 0, "Smith J").otherwise('["Smith"]').alias("authors"), keys.alias("keys"))
    return lint.claims(rows).drop("message")


#: Claims as JSON texts, one a customer, in eight shapes: no array, no JSON, items that are no objects, keys misspelt, ids of other types.
_ITEM_SHAPES = (
    "concat('{\"pmid\": \"', k, '\", \"title\": \"a\"}')",
    "concat('{\"pmid\": ', k, ', \"titel\": \"a\"}')",
    "'[5]'",
    "'null'",
    "concat('{\"pmid\": \"x', k, '\", \"doi\": \"10.1000/a.', k, '\", \"title\": \"a\", \"authors\": \"Smith J\"}')",
    "concat('{\"pmid\": \"x', k, '\", \"title\": \" \"}')",
    "'{\"authors\": [\"Smith\"], \"title\": \"a\"}'",
    "concat('{\"arxiv_id\": \"2113.', lpad(CAST(k AS STRING), 5, '0'), '\", \"title\": \"a\", \"authors\": null}')",
)


@query("""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey % 10 AS whole, c_custkey AS k, i AS line, (c_custkey + i) % 8 AS shape FROM customer, range(1, 10) r(i)),
x AS (SELECT * FROM t WHERE whole > 1), said(shape, tag, severity) AS (VALUES (1, 'unknown_key', 'WARN'), (1, 'no_title', 'WARN'), (2, 'not_an_object', 'ERROR'), (3, 'not_an_object', 'ERROR'),
  (4, 'pmid_not_digits', 'WARN'), (4, 'authors_type', 'WARN'), (5, 'pmid_not_digits', 'ERROR'), (5, 'no_title', 'WARN'), (6, 'missing_id', 'ERROR'), (7, 'arxiv_shape', 'ERROR')),
keyed AS (SELECT *, CASE WHEN shape IN (0, 1) THEN 0 WHEN shape IN (4, 7) THEN shape END AS key FROM x), firsts AS (SELECT *, min(line) OVER (PARTITION BY path, key) AS first FROM keyed)
SELECT path, CAST(0 AS BIGINT) AS line, CASE whole WHEN 0 THEN 'unreadable' ELSE 'not_an_array' END AS tag, 'ERROR' AS severity FROM t WHERE whole < 2 AND line = 1
UNION ALL SELECT path, line, tag, severity FROM x JOIN said USING (shape) UNION ALL SELECT path, line, 'duplicate_key', 'WARN' FROM firsts WHERE key IS NOT NULL AND line > first""")
def lint_json(spark: SparkSession, d: str) -> DataFrame:
    """Claims arrays of unknown shape, from JSON texts to issues."""
    shape = "CASE (k + i) % 8 " + " ".join(f"WHEN {n} THEN {text}" for n, text in enumerate(_ITEM_SHAPES)) + " END"
    texts = synth.table(spark, d, "customer").withColumn("k", c("c_custkey")).withColumn("items", F.expr(f"array_join(transform(sequence(1, 9), i -> {shape}), ', ')"))
    text = F.when(c("k") % 10 == 0, F.concat(F.lit("["), c("items"))).when(c("k") % 10 == 1, '{"pmid": "1"}').otherwise(F.concat(F.lit("["), c("items"), F.lit("]")))
    return lint.claims(sheets.claim_items(texts.select(c("k").cast("string").alias("path"), text.alias("text")))).drop("message")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 20 AS path, CAST(floor(o_orderkey / 500.0) AS BIGINT) AS block, 1 + CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n FROM orders),
placed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY path ORDER BY k) AS BIGINT) AS line FROM o)
SELECT CAST(path AS VARCHAR) AS path, line - n + 1 AS first_line, line, CASE n WHEN 3 THEN concat('a, ', chr(10), chr(10), '"b" ', k) WHEN 2 THEN concat('c', chr(10), k) ELSE concat('t', k) END AS title, CAST(k AS VARCHAR) AS pmid FROM placed""")
def sheet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of quoted sheets with line breaks in cells, and their physical lines."""
    k = c("o_orderkey")
    title = F.when(k % 3 == 0, F.concat(F.lit('"a, \n\n""b"" '), k, F.lit('"'))).when(k % 7 == 0, F.concat(F.lit('"c\n'), k, F.lit('"'))).otherwise(F.concat(F.lit("t"), k))
    rows = synth.table(spark, d, "orders").select((c("o_custkey") % 20).cast("string").alias("path"), F.floor(k / 500).alias("block"), k.alias("k"), F.concat(k, F.lit(","), title).alias("record"))
    raw = rows.select("path", "block", "k", F.posexplode(F.split("record", "\n")).alias("nth", "text")).select("path", "block", (c("k") * 4 + c("nth")).alias("at"), "text")
    cell = sheets.cells(c("text"), 2)
    return sheets.records(raw).select("path", "first_line", "line", cell[0].alias("pmid"), cell[1].alias("title"))


def _bib_text(spark: SparkSession, d: str) -> DataFrame:
    """BibTeX texts of 20 entries each: with a PMID, a DOI, a PMID in the note, and nothing to go by; some repeat, some lack a title."""
    k = c("p_partkey")
    key = (k - k % 2).cast("string")
    fields = F.when(k % 4 < 2, F.concat(F.lit("pmid = {"), key, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit("doi = {10.1000/P."), k.cast("string"), F.lit("}"))).otherwise("note = {none}")
    title = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(", title = {A {T}itle of "), k.cast("string"), F.lit("}")))
    entry = F.concat(F.lit("@article{k:"), k.cast("string"), F.lit(",\n "), fields, title, F.lit("}"))
    rows = synth.table(spark, d, "part").select(F.floor(k / 20).alias("book"), F.struct(k.alias("k"), entry.alias("e")).alias("x"))
    return rows.groupBy("book").agg(F.sort_array(F.collect_list("x")).alias("x")).select(c("book").cast("string").alias("path"), F.array_join(F.transform("x", lambda x: x["e"]), "\n\n").alias("text"))


_BIB = "b AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 20.0) AS BIGINT) AS book, CASE WHEN p_partkey % 4 < 2 THEN 'pmid' WHEN p_partkey % 4 = 2 THEN 'doi' ELSE 'none' END AS route, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_partkey - p_partkey % 2 AS VARCHAR) WHEN p_partkey % 4 = 2 THEN '10.1000/P.' || p_partkey END AS id FROM part)"


@query(f"WITH {_BIB} SELECT CAST(book AS VARCHAR) AS path, 'k:' || k AS citekey, route, id, CASE WHEN k % 10 <> 0 THEN 'A Title of ' || k END AS title FROM b")
def bib_entries(spark: SparkSession, d: str) -> DataFrame:
    found = bibliography.routed(bibliography.entries(_bib_text(spark, d), "bib"))
    return found.select("path", "citekey", "route", "id", F.try_element_at("fields", F.lit("title")).alias("title"))


@query(f"""WITH {_BIB}, n AS (SELECT *, min(k) OVER (PARTITION BY route, id) AS first FROM b)
SELECT tag, severity, count(*) AS n FROM (SELECT 'unroutable' AS tag, 'ERROR' AS severity FROM n WHERE route = 'none' UNION ALL SELECT 'duplicate_key', 'WARN' FROM n WHERE route <> 'none' AND k > first UNION ALL SELECT 'no_title', 'WARN' FROM n WHERE k % 10 = 0) GROUP BY tag, severity""")
def lint_bib(spark: SparkSession, d: str) -> DataFrame:
    found = bibliography.routed(bibliography.entries(_bib_text(spark, d), "bib"))
    return lint.entries(found.withColumn("line", c("path").cast("long") * 100_000 + c("line"))).groupBy("tag", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {_BIB}, n AS (SELECT *, k % 4 AS path, k % 10 = 0 AS bare, row_number() OVER (PARTITION BY k % 4 ORDER BY k) AS place, sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k % 4 ORDER BY k) AS made FROM b)
SELECT CAST(path AS VARCHAR) AS path, CASE WHEN bare THEN 'anon' || CAST(made AS BIGINT) ELSE 'k:' || k END AS citekey, CAST(3 * place - 2 AS INTEGER) AS line, route, id FROM n""")
def bib_blocks(spark: SparkSession, d: str) -> DataFrame:
    """BibTeX files read by blocks of 70 lines, whose ends cut entries: keys, those made up included, and lines within the file."""
    k = c("p_partkey")
    key = (k - k % 2).cast("string")
    fields = F.when(k % 4 < 2, F.concat(F.lit(" pmid = {"), key, F.lit("}}"))).when(k % 4 == 2, F.concat(F.lit(" doi = {10.1000/P."), k.cast("string"), F.lit("}}"))).otherwise(" note = {none}}")
    head = F.concat(F.lit("@article{"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("k:"), k.cast("string"))), F.lit(","))
    raw = synth.table(spark, d, "part").select((k % 4).cast("string").alias("path"), k.alias("k"), F.posexplode(F.array(head, fields, F.lit(""))).alias("nth", "text"))
    at = c("k") * 3 + c("nth")
    raw = raw.select("path", F.floor(at / 70).alias("block"), at.alias("at"), "text")
    return bibliography.routed(blocks.entries_of(raw, "bib")).select("path", "citekey", "line", "route", "id")


def _ris_text(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    ident = F.when(k % 3 == 0, F.concat(F.lit("AN  - "), (k + 10_000_000).cast("string"))).when(k % 3 == 1, F.concat(F.lit("DO  - 10.1000/P."), k.cast("string"))).otherwise(F.concat(F.lit("UR  - https://arxiv.org/abs/2101."), F.lpad((k % 100_000).cast("string"), 5, "0")))
    return synth.table(spark, d, "part").select(k.cast("string").alias("path"), F.concat(F.lit("TY  - JOUR\nTI  - A title of\n  "), k.cast("string"), F.lit("\nAU  - Smith J\nAU  - Doe A\nPY  - 2001/05\n"), ident, F.lit("\nER  - \n")).alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 3 WHEN 0 THEN 'pmid' WHEN 1 THEN 'doi' ELSE 'arxiv' END AS route, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey + 10000000 AS VARCHAR) WHEN 1 THEN '10.1000/P.' || p_partkey ELSE '2101.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END AS id, 'A title of ' || p_partkey AS title, 'Smith J; Doe A' AS author, '2001' AS year FROM part")
def ris_entries(spark: SparkSession, d: str) -> DataFrame:
    found = bibliography.routed(bibliography.bib_view(bibliography.entries(_ris_text(spark, d), "ris")))
    return found.select("path", "route", "id", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("title", "author", "year")])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'L' || n AS entry, CASE WHEN n = 1 THEN CAST(p_partkey + 10000000 AS VARCHAR) END AS pmid, CASE WHEN n = 2 THEN '10.1000/p.' || p_partkey END AS doi, CASE WHEN n = 3 THEN '2101.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END AS arxiv_id, n < 4 AS routable
FROM part, (SELECT unnest([1, 2, 3, 4]) AS n)""")
def list_entries(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey").cast("string")
    text = F.concat(F.lit("1. Smith J. A title. BMJ. 2001. PMID: "), (c("p_partkey") + 10_000_000).cast("string"), F.lit("\n2. Doe A. Another title. doi:10.1000/P."), k, F.lit(".\n3. On things. arXiv:2101."), F.lpad((c("p_partkey") % 100_000).cast("string"), 5, "0"), F.lit("\n[4] no id"))
    return bibliography.text_entries(synth.table(spark, d, "part").select(k.alias("path"), text.alias("text"))).select("path", "entry", "pmid", "doi", "arxiv_id", "routable")


# Joins of inputs

_CLAIMED = ("claimed_title", "claimed_authors", "claimed_journal", "claimed_year", "claimed_doi")


@query(f"{_SYNTH} SELECT input_ord, CASE WHEN CAST(id AS BIGINT) % 3 = 0 AND CAST(id AS BIGINT) - 10000000 <= 500 THEN r.title ELSE 'context of ' || input_ord END AS claimed_title, CAST(id AS BIGINT) % 3 = 0 AND CAST(id AS BIGINT) - 10000000 <= 500 AS explicit FROM claims JOIN registry r ON r.pmid = id")
def hits_with_claims(spark: SparkSession, d: str) -> DataFrame:
    """Scanned hits with the claim given for their id, else their context's."""
    hits = synth.claims(spark, d).select("id", "input_ord")
    null = F.lit(None)
    given = synth.registry(spark, d).where((c("pmid").cast("long") % 3 == 0) & (_key() <= 500)).select(c("pmid").alias("id"), c("title").alias("claimed_title"), c("authors").alias("claimed_authors"), c("journal").alias("claimed_journal"), null.cast("string").alias("claimed_year"), c("doi").alias("claimed_doi"))
    parsed = F.struct(F.concat(F.lit("context of "), c("input_ord").cast("string")).alias("claimed_title"), null.cast("array<string>").alias("claimed_authors"), *[null.cast("string").alias(k) for k in _CLAIMED[2:]])
    return flow.with_claims(hits, given, parsed).select("input_ord", "claimed_title", "explicit")


_NOW = "2001-07-15"


def _one_cache(spark: SparkSession, d: str) -> DataFrame:
    return rollup.upserted(_cache(spark, d), _cache(spark, d).limit(0).withColumn("network_error", F.lit(False)))


_KNOWN = f"one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY cached_at DESC, valid, version) AS n FROM ({_CACHE})) WHERE n = 1), held AS (SELECT * FROM one WHERE cached_at > TIMESTAMP '{_NOW}' - CASE WHEN valid THEN INTERVAL 30 DAY ELSE INTERVAL 3 DAY END)"


@query(f"{_SYNTH}, {_KNOWN} SELECT input_ord, id IN (SELECT pmid FROM held) AS held FROM claims")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    held, missing = flow.split_by_cache(synth.claims(spark, d), _one_cache(spark, d), F.expr(f"timestamp_ntz '{_NOW}'"))
    return held.select("input_ord", F.lit(True).alias("held")).union(missing.select("input_ord", F.lit(False)))


@query(f"{_SYNTH}, {_KNOWN} SELECT c.input_ord, CASE WHEN h.pmid IS NOT NULL THEN 'cache' WHEN r.pmid IS NOT NULL THEN 'fresh' ELSE 'missing' END AS \"from\", coalesce(h.valid, r.valid) AS valid FROM claims c LEFT JOIN held h ON h.pmid = c.id LEFT JOIN (SELECT * FROM registry WHERE CAST(pmid AS BIGINT) % 2 = 0) r ON r.pmid = c.id")
def cache_three_way(spark: SparkSession, d: str) -> DataFrame:
    cached = rollup.fresh(_one_cache(spark, d), F.expr(f"timestamp_ntz '{_NOW}'")).select("pmid", "valid")
    fresh = synth.registry(spark, d).where(c("pmid").cast("long") % 2 == 0).select("pmid", "valid")
    return flow.records_of(synth.claims(spark, d), cached, fresh).select("input_ord", "from", c("record.valid").alias("valid"))


_LEGACY = "SELECT CAST(o_custkey + 10000000 AS VARCHAR) AS pmid, concat('t', o_orderkey) AS title, o_orderkey % 7 <> 0 AS valid, o_orderdate AS cached_at FROM orders"


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    """Cached records of the first version: authors as JSON text, validity as a number, ages as seconds."""
    o = c("o_orderkey")
    return synth.table(spark, d, "orders").select(
        (c("o_custkey") + 10_000_000).cast("string").alias("pmid"), F.concat(F.lit("t"), o).alias("title"), F.concat(F.lit('["A", "'), o, F.lit('"]')).alias("authors"),
        (o % 7 != 0).cast("int").alias("valid"), F.unix_timestamp(c("o_orderdate").cast("timestamp")).cast("double").alias("cached_at"),
    )


@query("SELECT CAST(o_custkey + 10000000 AS VARCHAR) AS pmid, concat('t', o_orderkey) AS title, concat('A|', o_orderkey) AS authors, strftime(o_orderdate, '%Y-%m-%d') AS day, false AS retracted FROM orders WHERE o_orderkey % 7 <> 0")
def cache_migrated(spark: SparkSession, d: str) -> DataFrame:
    """A cache of the first version in today's columns."""
    rows = cache.migrated(_legacy(spark, d), 1)
    return rows.select("pmid", "title", F.array_join("authors", "|").alias("authors"), F.date_format("cached_at", "yyyy-MM-dd").alias("day"), "retracted")


@query(f"SELECT pmid, title, valid FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY cached_at DESC, title) AS n FROM ({_LEGACY}) WHERE valid) WHERE n = 1")
def cache_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A bucketed cache of an older version, migrated and upserted with later records, of which the latest of each id stays."""
    rows = _legacy(spark, d)
    later = c("cached_at") % (2 * 86400) >= 86400
    at = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    first = cache.migrated(rows.where(~later), 1)
    cache.create(first.groupBy("pmid").agg(F.min_by(F.struct(*[x for x in cache.COLUMNS if x != "pmid"]), F.struct((-c("cached_at").cast("long")).alias("a"), "title")).alias("r")).select("pmid", "r.*"), at, version=2)
    cache.upsert(spark, at, cache.migrated(rows.where(later), 1))
    return cache.load(spark, at).select("pmid", "title", "valid")


@query(f"""{_PMID}, n AS (SELECT *, row_number() OVER (PARTITION BY id, explicit ORDER BY input_ord) AS n FROM pmid_rows),
state AS (SELECT 'pmid ' || id AS key, verdict, valid FROM n WHERE explicit AND n = 1 AND NOT network_error), batch AS (SELECT 'pmid ' || id AS key, * FROM n WHERE NOT explicit AND n = 1)
SELECT b.key, b.verdict, b.valid, b.retracted, s.verdict AS was, CASE WHEN b.network_error THEN 'unanswered' WHEN s.key IS NULL THEN 'first' ELSE 'again' END AS change FROM batch b LEFT JOIN state s ON s.key = b.key
UNION ALL SELECT s.key, CASE WHEN s.verdict IN ('correct', 'partial') THEN 'partial' ELSE s.verdict END, s.valid, true, s.verdict, 'retracted' FROM state s JOIN registry r ON s.key = 'pmid ' || r.pmid WHERE s.valid AND r.valid AND r.retracted AND s.key NOT IN (SELECT key FROM batch)""")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of scanned citations changes where the explicit ones were graded before, when no record was known as retracted."""
    rows = _rows(spark, d)
    before = verify.keep_first(rows.where("explicit and not network_error"))
    state = before.select(F.concat(F.lit("pmid "), "id").alias("key"), F.lit("pmid").alias("kind"), "label", "verdict", "valid", F.lit(False).alias("retracted"), F.lit(0).cast("timestamp").alias("graded_at"))
    told = citations.changes(state, verify.keep_first(rows.where("not explicit")), synth.registry(spark, d), F.lit(0).cast("timestamp"), 1)
    return told.select("key", "verdict", "valid", "retracted", "was", "change")


@query(f"{_SYNTH} SELECT id, count(*) AS n_contexts, min(input_ord) AS first_ord, arg_min(claimed_journal, input_ord) AS first_context FROM (SELECT id, input_ord, coalesce(claimed_journal, '-') AS claimed_journal FROM claims) GROUP BY id")
def contexts_by_id(spark: SparkSession, d: str) -> DataFrame:
    return flow.contexts(synth.claims(spark, d).withColumn("context", F.coalesce("claimed_journal", F.lit("-"))))


@query(f"{_SYNTH} SELECT count(DISTINCT id) AS n_items, count(DISTINCT id) > 2000 AS warn FROM claims")
def input_guard(spark: SparkSession, d: str) -> DataFrame:
    return flow.guard(synth.claims(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """What a DOI is said to link to: mostly its own record, sometimes the next one."""
    return synth.registry(spark, d).select(F.upper("doi").alias("doi"), (c("pmid").cast("long") + F.when(_key() % 6 == 0, 1).otherwise(0)).cast("string").alias("pmid"))


_LINKS = "links AS (SELECT doi, CAST(CAST(pmid AS BIGINT) + CASE WHEN (CAST(pmid AS BIGINT) - 10000000) % 6 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS pmid FROM registry)"


@query(f"{_SYNTH}, {_LINKS} SELECT r.doi AS id, CASE WHEN p.doi = r.doi THEN p.pmid END AS pmid, CASE WHEN p.doi = r.doi THEN p.title END AS title, coalesce(p.doi <> r.doi, false) AS ambiguous FROM registry r LEFT JOIN links l ON l.doi = r.doi LEFT JOIN (SELECT * FROM registry WHERE valid) p ON p.pmid = l.pmid")
def link_guard(spark: SparkSession, d: str) -> DataFrame:
    registry = synth.registry(spark, d)
    rows = verify.with_links(registry.select(c("doi").alias("id")), _links(spark, d), registry)
    return rows.select("id", "pmid", c("linked.title").alias("title"), c("link_note").isNotNull().alias("ambiguous"))


@query(f"{_PMID}, {_LINKS}, items AS (SELECT doi AS id, CAST(pmid AS BIGINT) % 5 = 0 AS explicit FROM registry), seen AS (SELECT DISTINCT id AS pmid FROM pmid_rows WHERE valid) SELECT i.id, CASE WHEN NOT explicit AND s.pmid IS NOT NULL THEN s.pmid END AS merged_into FROM items i JOIN links l ON l.doi = i.id LEFT JOIN seen s ON s.pmid = l.pmid")
def doi_merged_scanned(spark: SparkSession, d: str) -> DataFrame:
    items = synth.registry(spark, d).select(c("doi").alias("id"), (c("pmid").cast("long") % 5 == 0).alias("explicit"))
    kept, merged = verify.merged_scanned(items, _links(spark, d), _rows(spark, d))
    return kept.select("id", F.lit(None).cast("string").alias("merged_into")).union(merged.select("id", "merged_into"))


_WORKS = "works AS (SELECT doi, CASE WHEN k % 13 = 0 THEN 'error' ELSE 'resolved' END AS status, CASE WHEN k % 7 = 0 THEN 'another title' WHEN k % 5 = 0 THEN 'RETRACTED ARTICLE: ' || title ELSE title END AS title, k % 5 = 0 AS retracted FROM (SELECT *, CAST(pmid AS BIGINT) - 10000000 AS k FROM registry) WHERE k % 11 <> 0)"


def _works(spark: SparkSession, d: str) -> DataFrame:
    k = _key()
    title = F.when(k % 7 == 0, "another title").when(k % 5 == 0, F.concat(F.lit("RETRACTED ARTICLE: "), c("title"))).otherwise(c("title"))
    return synth.registry(spark, d).where(k % 11 != 0).select("doi", F.when(k % 13 == 0, "error").otherwise("resolved").alias("status"), title.alias("title"), (k % 5 == 0).alias("retracted"), F.lit("retracted by DOI ?").alias("retraction_note"))


@query(f"""{_PMID}, {_WORKS} SELECT p.input_ord, CASE WHEN p.valid THEN coalesce(w.status = 'resolved', false) END AS doi_verified,
  CASE WHEN p.valid AND w.status = 'resolved' THEN regexp_replace(w.title, '^RETRACTED ARTICLE: ', '') = p.title END AS doi_title_match,
  CASE WHEN p.valid AND coalesce(w.retracted, false) THEN 'doi registry' WHEN p.retracted THEN 'publication type' END AS retraction_source
FROM pmid_rows p LEFT JOIN works w ON w.doi = p.doi""")
def crossref_check(spark: SparkSession, d: str) -> DataFrame:
    rows = verify.crossref_check(_rows(spark, d), _works(spark, d), False)
    return rows.select("input_ord", "doi_verified", "doi_title_match", "retraction_source")


@query(f"""{_SYNTH}, t AS (SELECT input_ord, claimed_authors, claimed_journal, claimed_year, list_filter(string_split(coalesce(claimed_title, ''), ' '), lambda w: length(w) > 3 AND NOT list_contains(['the', 'and', 'for', 'with', 'from', 'that', 'this'], lower(w)))[1:4] AS w FROM claims)
SELECT input_ord, concat_ws(' AND ', claimed_authors[1] || '[au]', CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END, claimed_journal || '[jour]', claimed_year || '[dp]') AS q FROM t""")
def suggestion_query(spark: SparkSession, d: str) -> DataFrame:
    return synth.claims(spark, d).select("input_ord", verify.suggestion_query(c("claimed_authors"), c("claimed_title"), c("claimed_journal"), c("claimed_year")).alias("q"))


@query(f"{_SYNTH}, {_WORKS} SELECT doi, regexp_replace(title, '^RETRACTED ARTICLE: ', '') AS title FROM works")
def retraction_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _works(spark, d).select("doi", verify.plain_title(c("title")).alias("title"))


@query(f"""{_PMID}, asked AS (SELECT id, input_ord, array_to_string(list_filter(string_split(title, ' '), lambda w: length(w) > 3 AND NOT list_contains(['the', 'and', 'for', 'with', 'from', 'that', 'this', 'effect', 'study', 'using', 'based'], lower(w)))[1:6], ' ') AS claimed_title FROM pmid_rows WHERE retracted AND length(title) >= 15
), {_candidates('valid AND NOT retracted', 4)}, kept AS (SELECT *, row_number() OVER (PARTITION BY id, input_ord ORDER BY rank) AS n FROM cand WHERE found <> id)
SELECT input_ord, string_agg(found, ',' ORDER BY n) AS found FROM kept WHERE n <= 3 GROUP BY input_ord""")
def retraction_replacements(spark: SparkSession, d: str) -> DataFrame:
    rows = verify.replacements(_rows(spark, d), synth.registry(spark, d))
    return rows.where("replacement_pmids is not null").select("input_ord", F.array_join("replacement_pmids", ",").alias("found"))


@query(f"{_PMID} SELECT input_ord, valid AND NOT contains(lower(title), 'trial') AS unmatched FROM (SELECT * REPLACE (CASE WHEN input_ord % 2 = 0 THEN title ELSE replace(title, ' trial ', ' ') END AS title) FROM pmid_rows)")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    """Titles against the words of the source's file name."""
    rows = _rows(spark, d).withColumns({"label": F.lit("out/ev_trial.txt"), "title": F.when(c("input_ord") % 2 == 0, c("title")).otherwise(F.replace("title", F.lit(" trial "), F.lit(" ")))})
    return verify.with_relevance(rows).select("input_ord", "unmatched")


#: Entries in Chinese characters with a registered title in them, or not, or of another year.
_CJK_ITEMS = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS input_ord, '[' || p_partkey || '] 张三, 李四. ' || CASE WHEN p_partkey % 4 = 0 THEN '别的题目' ELSE '儿童风湿病的研究' || p_partkey || '号' END || '[J]. 中华儿科杂志, ' || (CASE WHEN p_partkey % 5 = 0 THEN '1999' ELSE '2020' END) || '.' AS raw, CASE WHEN p_partkey % 5 = 0 THEN '1999' ELSE '2020' END AS claimed_year FROM part"


@query(f"""WITH items AS ({_CJK_ITEMS}), works AS (SELECT 'W' || p_partkey AS work_id, '儿童风湿病的研究' || p_partkey || '号' AS title, p_partkey % 7 = 0 AS retracted FROM part)
SELECT input_ord, work_id, CASE WHEN work_id IS NULL THEN 'unknown' WHEN retracted THEN 'partial' ELSE 'correct' END AS verdict
FROM items LEFT JOIN works ON contains(raw, title) AND claimed_year = '2020'""")
def cjk_title_search(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    parts = synth.table(spark, d, "part")
    title, year = F.concat(F.lit("儿童风湿病的研究"), k.cast("string"), F.lit("号")), F.when(k % 5 == 0, "1999").otherwise("2020")
    raw = F.concat(F.lit("["), k.cast("string"), F.lit("] 张三, 李四. "), F.when(k % 4 == 0, "别的题目").otherwise(title), F.lit("[J]. 中华儿科杂志, "), year, F.lit("."))
    items = parts.select(k.cast("string").alias("id"), k.alias("input_ord"), raw.alias("raw"), F.array(F.lit("张三"), F.lit("李四")).alias("claimed_authors"), F.lit("中华儿科杂志").alias("claimed_journal"), year.alias("claimed_year"))
    works = parts.select(F.concat(F.lit("W"), k.cast("string")).alias("work_id"), title.alias("title"), F.array(F.lit("张三"), F.lit("王五")).alias("authors"), F.lit("中华儿科杂志").alias("journal"), F.lit("2020").alias("year"), (k % 7 == 0).alias("retracted"))
    return verify.cjk_search(items, works, False).select("input_ord", "work_id", "verdict")


# Registry answers: bodies are written from the registry, and must decode to it

_DECODED = "SELECT pmid, valid, network_error, CASE WHEN valid THEN title END AS title, CASE WHEN valid THEN array_to_string(authors, '|') END AS authors, CASE WHEN valid THEN journal END AS journal, CASE WHEN valid THEN pubdate END AS pubdate, CASE WHEN valid THEN doi END AS doi, CASE WHEN valid THEN retracted END AS retracted FROM registry"
_REGISTRY_FIELDS = ("pmid", "valid", "network_error", "title", "journal", "pubdate", "doi", "retracted")


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select(*_REGISTRY_FIELDS, F.array_join("authors", "|").alias("authors"))


@query(f"{_SYNTH} {_DECODED}")
def decode_ncbi(spark: SparkSession, d: str) -> DataFrame:
    """One answer for each id: a record, a result without it, or no answer."""
    found = F.struct("title", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), c("journal").alias("source"), "pubdate", F.when(c("retracted"), F.array(F.lit("Journal Article"), F.lit("Retracted  Publication"))).otherwise(F.array(F.lit("Journal Article"))).alias("pubtype"), F.when(_key() % 2 == 0, F.array(F.struct(F.lit("doi").alias("idtype"), c("doi").alias("value")))).alias("articleids"), F.concat(F.lit("pii: x. doi: "), c("doi")).alias("elocationid"))
    body = F.when(c("valid"), F.concat(F.lit('{"result": {"uids": ["1"], "'), c("pmid"), F.lit('": '), F.to_json(found), F.lit("}}"))).when(c("network_error"), '{"header": {}}').otherwise('{"result": {"uids": []}}')
    return _decoded(records.ncbi_summaries(synth.registry(spark, d).select(F.array("pmid").alias("pmids"), body.alias("body"))))


@query(f"{_SYNTH} {_DECODED}")
def decode_europe_pmc(spark: SparkSession, d: str) -> DataFrame:
    found = F.struct(c("pmid").alias("id"), "title", F.array_join("authors", ", ").alias("authorString"), c("journal").alias("journalTitle"), c("pubdate").alias("pubYear"), "doi", F.when(c("retracted"), "Retracted Publication; article").otherwise("article").alias("pubType"))
    body = F.when(c("valid"), F.concat(F.lit('{"resultList": {"result": ['), F.to_json(found), F.lit("]}}"))).when(c("network_error"), "<html>busy</html>").otherwise('{"resultList": {"result": []}}')
    return _decoded(records.europe_pmc(synth.registry(spark, d).select(F.array("pmid").alias("pmids"), body.alias("body"))))


@query(f"""{_SYNTH}, k AS (SELECT *, CAST(pmid AS BIGINT) - 10000000 AS k FROM registry), s AS (SELECT *, CASE WHEN valid THEN 'resolved' WHEN network_error THEN 'error' ELSE 'not_found' END AS status FROM k)
SELECT doi, status, CASE WHEN valid THEN title END AS title, CASE WHEN valid THEN pubdate[1:4] END AS year, CASE WHEN valid THEN array_to_string(authors, '|') END AS authors, CASE WHEN valid THEN retracted END AS retracted, CASE WHEN valid AND retracted THEN CASE WHEN k % 2 = 0 THEN 'removed' ELSE 'retracted' END || ' by DOI 10.1000/n.' || k END AS retraction_note FROM s""")
def decode_crossref(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform("authors", lambda a: F.struct(F.regexp_extract(a, r"^(\S+)", 1).alias("family"), F.regexp_extract(a, r"(\S+)$", 1).alias("given")))
    notice = F.array(F.struct(F.lit("10.1/c").alias("DOI"), F.lit("correction").alias("type")), F.struct(F.concat(F.lit("10.1000/n."), _key().cast("string")).alias("DOI"), F.when(_key() % 2 == 0, "removal").otherwise("Retraction").alias("type")))
    date = F.struct(F.array(F.array(F.substring("pubdate", 1, 4).cast("int"))).alias("date-parts"))
    message = F.struct(F.array("title").alias("title"), names.alias("author"), F.array("journal").alias("container-title"), F.when(_key() % 2 == 0, date).alias("published-online"), date.alias("created"), F.when(c("retracted"), notice).alias("updated-by"))
    body = F.when(c("valid"), F.concat(F.lit('{"message": '), F.to_json(message), F.lit("}"))).otherwise("busy")
    rows = synth.registry(spark, d).select(F.upper("doi").alias("doi"), F.when(c("valid"), 200).when(c("network_error"), 503).otherwise(404).alias("http_status"), body.alias("body"))
    return records.crossref_works(rows).select("doi", "status", "title", "year", F.array_join("authors", "|").alias("authors"), "retracted", "retraction_note")


@query(f"{_SYNTH} SELECT pmid AS key, 'W' || pmid AS work_id, title, pubdate[1:4] AS year, doi, retracted, journal, array_to_string(authors, '|') AS authors FROM registry WHERE valid")
def decode_openalex(spark: SparkSession, d: str) -> DataFrame:
    work = F.struct(F.concat(F.lit("W"), c("pmid")).alias("id"), F.concat(F.lit("https://doi.org/"), c("doi")).alias("doi"), c("title").alias("display_name"), F.substring("pubdate", 1, 4).cast("int").alias("publication_year"), c("retracted").alias("is_retracted"), F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.struct(c("journal").alias("display_name")).alias("source")).alias("primary_location"))
    body = F.when(~c("valid"), '{"results": []}').when(_key() % 2 == 0, F.to_json(work)).otherwise(F.concat(F.lit('{"results": ['), F.to_json(work), F.lit("]}")))
    rows = records.openalex_works(synth.registry(spark, d).select(c("pmid").alias("key"), body.alias("body")))
    return rows.select("key", "work_id", "title", "year", "doi", "retracted", "journal", F.array_join("authors", "|").alias("authors"))


@query(f"{_SYNTH} SELECT pmid AS arxiv_id, CASE WHEN valid THEN 'found' WHEN network_error THEN 'error' ELSE 'not_found' END AS status, CASE WHEN valid THEN title END AS title, CASE WHEN valid THEN pubdate[1:4] END AS year, CASE WHEN valid THEN array_to_string(authors, '|') END AS authors, CASE WHEN valid AND CAST(pmid AS BIGINT) % 2 = 0 THEN doi END AS registered_doi FROM registry")
def decode_arxiv(spark: SparkSession, d: str) -> DataFrame:
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name> "), a, F.lit("</name></author>"))), "")
    entry = F.concat(F.lit("<entry><title>"), F.replace("title", F.lit(" trial "), F.lit("\n  trial ")), F.lit("</title><published>"), F.substring("pubdate", 1, 4), F.lit("-01-02T00:00:00Z</published>"), people, F.when(c("pmid").cast("long") % 2 == 0, F.concat(F.lit("<arxiv:doi>"), c("doi"), F.lit("</arxiv:doi>"))).otherwise(""), F.lit("</entry>"))
    feed = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'), F.when(c("valid"), entry).otherwise(""), F.lit("</feed>"))
    body = F.when(c("network_error"), F.when(_key() % 2 == 0, "<html><body>busy</body></html>").otherwise(F.concat(F.lit("<feed>"), F.lit("<entry><title>Error</title></entry></feed>")))).otherwise(feed)
    rows = records.arxiv_feed(synth.registry(spark, d).select(c("pmid").alias("arxiv_id"), body.alias("body")))
    return rows.select("arxiv_id", "status", "title", "year", F.array_join("authors", "|").alias("authors"), "registered_doi")


# Counts, changes, reports


@query(f"{_PMID} SELECT source AS meta_source, count(*) AS n, count_if(verdict = 'correct') AS correct, round(100.0 * count_if(verdict = 'correct') / count(*), 2) AS percent FROM (SELECT *, CASE WHEN input_ord % 4 = 0 THEN 'europepmc' ELSE 'ncbi' END AS source FROM pmid_rows) GROUP BY source")
def source_mix(spark: SparkSession, d: str) -> DataFrame:
    return rollup.source_mix(_rows(spark, d).withColumn("meta_source", F.when(c("input_ord") % 4 == 0, "europepmc").otherwise("ncbi")))


@query("SELECT regexp_extract(url, '^https?://([^/?:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY host")
def breaker_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rollup.breaker_rejects(synth.table(spark, d, "pages").select("url"))


@query(f"{_PMID} SELECT input_ord, verdict FROM pmid_rows WHERE verdict IN ('mismatch', 'invalid') OR doi_splice")
def subset(spark: SparkSession, d: str) -> DataFrame:
    return rollup.subset(_rows(spark, d), ("mismatch", "invalid"), ("doi_splice",)).select("input_ord", "verdict")


_SIGNS = {name: (at, sign) for at, (name, sign) in enumerate(zip(export.LISTED, "⚠↓↑+−", strict=True), 1)}


def _for(column: str, values: dict[str, object]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query(f"""{_CHANGES}, sizes AS (SELECT category, count(*) AS n FROM changes GROUP BY category), nth AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key) AS n FROM changes)
SELECT 0 AS at, 0 AS n, {" || ' · ' || ".join(f"'{k.replace('_', ' ')}: ' || coalesce((SELECT n FROM sizes WHERE category = '{k}'), 0)" for k in _SIGNS)} AS line
UNION ALL SELECT {_for('category', {k: at for k, (at, _) in _SIGNS.items()})}, CAST(n AS INT), '- ' || {_for('category', {k: f"'{sign}'" for k, (_, sign) in _SIGNS.items()})} || ' ' || key || CASE WHEN category IN ('degraded', 'improved') THEN ': ' || was || ' → ' || now ELSE '' END
FROM nth WHERE n <= {_for('category', export.LISTED)}""")
def delta_report(spark: SparkSession, d: str) -> DataFrame:
    """The readable change report; its counts cover all rows, its lists the first of each category."""
    return export.delta_lines(_delta(spark, d))


@query(f"{_PMID}, s AS (SELECT CASE WHEN retracted THEN 'retracted' WHEN NOT valid THEN 'excluded' WHEN verdict = 'correct' THEN 'included' WHEN verdict = 'partial' THEN 'partial' ELSE 'excluded' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY input_ord) AS n FROM pmid_rows) WHERE n = 1) SELECT '% total: ' || count_if(status = 'included') || ' included, ' || count_if(status = 'partial') || ' partial (commented), ' || count_if(status IN ('excluded', 'retracted')) || ' excluded' AS entry FROM s")
def bib_total(spark: SparkSession, d: str) -> DataFrame:
    return export.bib_total(export.display(_rows(spark, d).withColumn("pmid", c("id"))))


def _mark(name: str) -> str:
    return f"CASE WHEN {name} THEN '✓' WHEN NOT {name} THEN '✗' ELSE '—' END"


@query(f"""{_PMID} SELECT input_ord, CASE verdict WHEN 'correct' THEN '✅' WHEN 'mismatch' THEN '⚠️' WHEN 'partial' THEN '🔶' WHEN 'invalid' THEN '❌' ELSE '❓' END || ' PMID ' || id || ' (' || label || ') [' || verdict || ']' AS head,
  CASE WHEN valid THEN title[1:90] END AS actual FROM pmid_rows""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    lines = export.text_rows(_rows(spark, d))
    return lines.select("input_ord", F.regexp_extract("line", r"^([^\n]*)", 1).alias("head"), F.nullif(F.regexp_extract("line", r"\n   Actual: ([^\n]*)", 1), F.lit("")).alias("actual"))


_ALL_VERDICTS = ", ".join(f"count_if(verdict = '{v}') AS {v}" for v in rollup.VERDICTS)


@query(f"{_PMID} SELECT count(*) AS total, {_ALL_VERDICTS}, count_if(NOT contains(lower(coalesce(title, 'trial')), 'k1') AND valid) AS unmatched, count_if(valid AND input_ord % 3 = 0) AS doi_resolved, count_if(verdict = 'invalid' AND input_ord % 3 = 1) AS arxiv_invalid, count_if(input_ord % 10 = 0) AS doi_merged_into_pmid FROM pmid_rows")
def stats_all(spark: SparkSession, d: str) -> DataFrame:
    """The counters that the other legs feed, over rows dealt to kinds."""
    o = c("input_ord")
    rows = _rows(spark, d).withColumns({"kind": F.when(o % 3 == 0, "doi").when(o % 3 == 1, "arxiv").otherwise("pmid"), "unmatched": c("valid") & ~F.contains(F.lower(F.coalesce("title", F.lit("trial"))), F.lit("k1")), "merged_into": F.when(o % 10 == 0, c("id"))})
    return rollup.stats(rows).select("total", *rollup.VERDICTS, "unmatched", "doi_resolved", "arxiv_invalid", "doi_merged_into_pmid")


# The ladder across scripts: a title, then only authors, in Chinese characters


@query(f"""{_SYNTH} SELECT pmid, CASE k % 4 WHEN 3 THEN 'correct' ELSE 'partial' END AS verdict,
  CASE k % 4 WHEN 0 THEN 'title skipped (cross-language); comparable fields match' WHEN 1 THEN 'title not claimed (author skipped cross-language); all comparable fields match' WHEN 2 THEN 'title not claimed; journal differs' ELSE 'author skipped (cross-language)' END AS details
FROM (SELECT *, CAST(pmid AS BIGINT) - 10000000 AS k FROM registry)""")
def cross_language(spark: SparkSession, d: str) -> DataFrame:
    from refsieve.functions.match import cross_check

    k, null = _key(), F.lit(None)
    foreign = F.array(F.lit("张三"), F.lit("李四"))
    title = F.when(k % 4 == 0, "儿童风湿病的治疗研究").when(k % 4 == 3, c("title"))
    rows = synth.registry(spark, d).withColumns({"claimed_title": title, "claimed_authors": F.when(k % 4 == 0, c("authors")).otherwise(foreign), "claimed_journal": F.when(k % 4 == 2, "Acta Botanica").otherwise(c("journal")), "claimed_year": F.substring("pubdate", 1, 4), "claimed_doi": null.cast("string")})
    return cross_check(rows, False).select("pmid", "verdict", "details")


# The whole audit: items of four kinds, each id once, through their legs

_DOI_ID = "'10.1000/' || CASE WHEN (CAST(id AS BIGINT) - 10000000) % 11 = 0 THEN 'lost.' ELSE 'part.' END || (CAST(id AS BIGINT) - 10000000)"


def _of_kind(kind: int) -> str:
    """The claims of one kind, the first of each id; ids of every kind tell records apart just as those of the claims do."""
    return f"SELECT * FROM claims WHERE input_ord % 4 = {kind} QUALIFY row_number() OVER (PARTITION BY id ORDER BY explicit DESC, input_ord) = 1"


_AUDIT_PMID = _PMID.replace("FROM claims c LEFT JOIN", f"FROM ({_of_kind(0)}) c LEFT JOIN")
_AUDIT = f"""
WITH pmids AS ({_AUDIT_PMID} SELECT 'pmid' AS kind, input_ord, id, verdict, valid, doi FROM pmid_rows
), dois AS ({_DOI.replace("FROM claims", f"FROM ({_of_kind(1)}) claims")}
), arxiv AS ({_ARXIV_LEG.replace("AS aid FROM claims", f"AS aid FROM ({_of_kind(2)}) claims")}
), titles AS ({_title_leg(_of_kind(3))}
)
SELECT kind, input_ord, id, verdict FROM pmids
UNION ALL SELECT 'doi', input_ord, doi, verdict FROM dois WHERE doi NOT IN (SELECT doi FROM pmids WHERE valid)
UNION ALL SELECT 'arxiv', input_ord, id, verdict FROM arxiv
UNION ALL SELECT 'title', input_ord, id, verdict FROM titles"""


def audited(spark: SparkSession, d: str) -> DataFrame:
    """All legs over the claims, dealt to four kinds."""
    o, key = c("input_ord"), c("id").cast("long") - 10_000_000
    arxiv, records_of_arxiv = _arxiv(spark, d)
    doi = F.concat(F.lit("10.1000/"), F.when(key % 11 == 0, "lost.").otherwise("part."), key.cast("string"))
    of = lambda rows, kind, name: rows.where(o % 4 == kind).withColumn("kind", F.lit(name))
    # arXiv ids repeat beyond 100,000 papers; the cited paper is what tells claims apart.
    claims = synth.claims(spark, d).withColumn("cited", c("id"))
    items = of(claims, 0, "pmid").union(of(claims.withColumn("id", doi), 1, "doi")).union(of(arxiv, 2, "arxiv")).union(of(claims, 3, "title"))
    return flow.audit(items, synth.registry(spark, d), _doi_records(spark, d), records_of_arxiv, False, "cited")


@query(_AUDIT)
def audit(spark: SparkSession, d: str) -> DataFrame:
    """Every graded row of the four legs."""
    return audited(spark, d).select("kind", "input_ord", "id", "verdict")


@query(f"SELECT kind, count(*) AS total, {_ALL_VERDICTS} FROM ({_AUDIT}) GROUP BY kind")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of the whole audit, by kind."""
    return audited(spark, d).groupBy("kind").agg(F.count("*").alias("total"), *[F.count_if(c("verdict") == v).alias(v) for v in rollup.VERDICTS])
