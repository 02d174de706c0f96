"""Named queries over the driver's tables, and their DuckDB SQL.

Queries that SQL cannot express (character similarity, context parsing) have no
SQL; their results are tested in ``tests``. Where SQL checks the ladder, titles
are compared by words alone (``sequence`` off).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.functions import match, styles, text
from refsieve.operators import export, rollup, verify
from refsieve.plans import oracles, synth
from refsieve.sources import bibliography, context, extract
from refsieve.sources.files import html_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(oracle: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _rows(spark: SparkSession, d: str, sequence: bool = False) -> DataFrame:
    return verify.verify_pmid(synth.claims(spark, d), synth.registry(spark, d), sequence)


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return verify.with_registry(synth.claims(spark, d), synth.registry(spark, d))


_BASE = f"WITH {synth.sql()}, base AS (SELECT c.*, r.title, r.authors, r.journal, r.pubdate, r.doi FROM claims c LEFT JOIN registry r ON r.pmid = c.id)"
_CMP = f"{_BASE}, {oracles.compared('base')}"
_PMID = f"WITH {oracles.pmid_rows()}"
#: DOIs as they are met: with prefixes, capitals, queries and trailing marks.
_RAW_DOI = "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'https://doi.org/10.1000/Part.' || p_partkey || '?utm=x' WHEN 1 THEN 'doi: 10.1000/PART.' || p_partkey || '.' WHEN 2 THEN 'http://dx.doi.org/doi:10.1000/part.' || p_partkey || ').' WHEN 3 THEN ' 10.1000/part.' || p_partkey || ' ;' WHEN 4 THEN '' ELSE 'doi.org/10.1000/other.' || p_partkey END"


@query(f"SELECT p_partkey, {oracles.clean_doi(_RAW_DOI)} AS doi FROM part")
def doi_clean(spark: SparkSession, d: str) -> DataFrame:
    return synth.table(spark, d, "part").select("p_partkey", text.clean_doi(F.expr(_RAW_DOI)).alias("doi"))


@query(f"SELECT p_partkey, {oracles.clean_doi(_RAW_DOI)} = '10.1000/part.' || p_partkey AS same FROM part")
def doi_match(spark: SparkSession, d: str) -> DataFrame:
    return synth.table(spark, d, "part").select("p_partkey", text.doi_match(F.expr(_RAW_DOI), F.concat(F.lit("10.1000/part."), c("p_partkey").cast("string"))).alias("same"))


_ARXIV = "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '2101.' || lpad(CAST(p_partkey % 99999 AS VARCHAR(9)), 5, '0') WHEN 1 THEN '2113.00001' WHEN 2 THEN 'arXiv:1905.' || lpad(CAST(p_partkey % 9999 AS VARCHAR(9)), 4, '0') || 'v2' WHEN 3 THEN 'math.GT/0309136' ELSE 'hep-th/99' END"


@query(rf"SELECT p_partkey, regexp_matches(regexp_replace(trim({_ARXIV}), '(?i)arxiv:', '', 'g'), '(?i)^[0-9]{{2}}(0[1-9]|1[0-2])\.[0-9]{{4,5}}(v[0-9]+)?$') OR regexp_matches({_ARXIV}, '(?i)^[a-z-]+(\.[A-Z]{{2}})?/[0-9]{{7}}(v[0-9]+)?$') AS valid FROM part")
def arxiv_shape(spark: SparkSession, d: str) -> DataFrame:
    return synth.table(spark, d, "part").select("p_partkey", text.arxiv_valid(F.expr(_ARXIV)).alias("valid"))


@query(f"{_CMP} SELECT input_ord, round(word_ratio, 6) AS word_ratio, title_match FROM cmp")
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return match.compared(_joined(spark, d), False).select("input_ord", F.round("word_ratio", 6).alias("word_ratio"), "title_match")


@query(f"{_CMP} SELECT input_ord, author_ran, CAST(author_hits AS INT) AS author_hits, author_match FROM cmp")
def author_match(spark: SparkSession, d: str) -> DataFrame:
    return match.compared(_joined(spark, d), False).select("input_ord", "author_ran", "author_hits", "author_match")


@query(f"{_CMP} SELECT input_ord, journal_match FROM cmp")
def journal_match(spark: SparkSession, d: str) -> DataFrame:
    return match.compared(_joined(spark, d), False).select("input_ord", "journal_match")


@query(f"{_CMP} SELECT input_ord, coalesce({oracles.abbreviates('ca_j', 'ra_j')}, false) AS abbreviates FROM pre")
def journal_abbrev(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("input_ord", match.journal_abbreviates(c("claimed_journal"), c("journal")).alias("abbreviates"))


@query(f"{_CMP} SELECT input_ord, year_match FROM cmp")
def year_match(spark: SparkSession, d: str) -> DataFrame:
    return match.compared(_joined(spark, d), False).select("input_ord", "year_match")


@query(f"{_CMP} SELECT input_ord, ladder AS verdict, round(CASE WHEN checks > 0 THEN CAST(wins AS DOUBLE) / checks ELSE 0 END, 6) AS confidence, CASE WHEN title_ran AND NOT title_skipped THEN title_match END AS field_title, CASE WHEN has_authors AND len(authors) > 0 THEN author_match END AS field_author, CASE WHEN journal_ran THEN journal_match END AS field_journal, CASE WHEN year_ran THEN year_match END AS field_year FROM graded")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    return match.cross_check(_joined(spark, d), False).select("input_ord", "verdict", F.round("confidence", 6).alias("confidence"), "field_title", "field_author", "field_journal", "field_year")


@query()
def cross_check_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The ladder with character similarity, which SQL lacks."""
    return match.cross_check(_joined(spark, d)).select("input_ord", "verdict", "details", F.round("seq_ratio", 6).alias("seq_ratio"))


@query(f"{_PMID} SELECT id, input_ord, verdict, route, confidence, doi_splice, retracted FROM pmid_rows")
def verify_pmid(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("id", "input_ord", "verdict", "route", "confidence", "doi_splice", "retracted")


#: A title alone, scanned: only then may the upgrade apply.
_BARE = "SELECT * REPLACE ('scan.txt' AS label, false AS explicit, CAST(NULL AS VARCHAR[]) AS claimed_authors, CAST(NULL AS VARCHAR) AS claimed_journal, CAST(NULL AS VARCHAR) AS claimed_year, CAST(NULL AS VARCHAR) AS claimed_doi) FROM claims"


@query(f"{_PMID.replace('FROM claims c LEFT JOIN', f'FROM ({_BARE}) c LEFT JOIN')} SELECT input_ord, verdict, route, confidence FROM pmid_rows")
def monotonic_upgrade(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None)
    bare = synth.claims(spark, d).withColumns({"label": F.lit("scan.txt"), "explicit": F.lit(False), "claimed_authors": null.cast("array<string>"), "claimed_journal": null.cast("string"), "claimed_year": null.cast("string"), "claimed_doi": null.cast("string")})
    return verify.verify_pmid(bare, synth.registry(spark, d), False).select("input_ord", "verdict", "route", "confidence")


@query(f"{_PMID} SELECT input_ord, verdict FROM pmid_rows WHERE doi_splice")
def splice_cap(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where("doi_splice").select("input_ord", "verdict")


@query(f"{_PMID} SELECT input_ord, verdict FROM pmid_rows WHERE retracted")
def retraction_cap(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where("retracted").select("input_ord", "verdict")


def _doi_items(spark: SparkSession, d: str) -> DataFrame:
    """Claims by DOI: of the cited part, or of none."""
    key = c("id").cast("long") - 10_000_000
    return synth.claims(spark, d).withColumn("id", F.concat(F.lit("10.1000/"), F.when(key % 11 == 0, "lost.").otherwise("part."), key.cast("string")))


def _doi_records(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    rows = synth.table(spark, d, "part").join(synth.registry(spark, d), F.concat(F.lit("10.1000/part."), k.cast("string")) == c("doi"))
    found = rows.select("doi", F.when(k % 59 == 0, "error").otherwise("resolved").alias("status"), "title", "journal", F.substring("pubdate", 1, 4).alias("year"), "authors", (k % 89 == 0).alias("retracted"))
    lost = synth.table(spark, d, "part").where(k % 11 == 0).select(F.concat(F.lit("10.1000/lost."), k.cast("string")).alias("doi"), F.lit("not_found").alias("status"))
    return found.unionByName(lost, allowMissingColumns=True)


_DOI = f"""WITH {synth.sql()}, items AS (
  SELECT * REPLACE ('10.1000/' || CASE WHEN (CAST(id AS BIGINT) - 10000000) % 11 = 0 THEN 'lost.' ELSE 'part.' END || (CAST(id AS BIGINT) - 10000000) AS id) FROM claims
), records AS (
  SELECT doi, CASE WHEN p_partkey % 59 = 0 THEN 'error' ELSE 'resolved' END AS status, title, journal, pubdate[1:4] AS year, authors, p_partkey % 89 = 0 AS retracted
  FROM registry JOIN part ON doi = '10.1000/part.' || p_partkey
  UNION ALL SELECT '10.1000/lost.' || p_partkey, 'not_found', NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 11 = 0
), base AS (
  SELECT i.*, r.status, CASE WHEN r.status = 'resolved' THEN p.pmid END AS pmid,
         CASE WHEN r.status = 'resolved' AND p.pmid IS NOT NULL THEN p.title ELSE r.title END AS title, CASE WHEN r.status = 'resolved' AND p.pmid IS NOT NULL THEN p.journal ELSE r.journal END AS journal,
         CASE WHEN r.status = 'resolved' AND p.pmid IS NOT NULL THEN p.pubdate ELSE r.year END AS pubdate, CASE WHEN r.status = 'resolved' AND p.pmid IS NOT NULL THEN p.authors ELSE r.authors END AS authors,
         coalesce(r.status = 'resolved', false) AND (coalesce(r.retracted, false) OR coalesce(p.retracted, false)) AS retracted
  FROM items i LEFT JOIN records r ON r.doi = i.id LEFT JOIN (SELECT * FROM registry WHERE valid) p ON p.doi = i.id
), {oracles.compared('base')}
SELECT input_ord, id AS doi, pmid, retracted,
       CASE WHEN status = 'resolved' AND has_title THEN CASE WHEN retracted AND ladder IN ('correct', 'partial') THEN 'partial' ELSE ladder END
            WHEN status = 'not_found' AND label IN ('cli', 'claims') THEN 'invalid' ELSE 'unknown' END AS verdict
FROM graded"""


@query(_DOI)
def verify_doi(spark: SparkSession, d: str) -> DataFrame:
    rows = verify.verify_doi(_doi_items(spark, d), _doi_records(spark, d), synth.registry(spark, d), False)
    return rows.select("input_ord", "doi", "pmid", "retracted", "verdict")


def _arxiv(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = c("id").cast("long") - 10_000_000
    made = lambda k: F.concat(F.when(k % 13 == 0, "2113.").otherwise("2101."), F.lpad((k % 100000).cast("string"), 5, "0"))
    items = synth.claims(spark, d).withColumns({"cited": c("id"), "id": made(key)})
    k = c("pmid").cast("long") - 10_000_000
    records = synth.registry(spark, d).where(k % 17 != 0).select(made(k).alias("arxiv_id"), F.lit("found").alias("status"), "title", F.substring("pubdate", 1, 4).alias("year"), F.when(k % 2 == 0, c("doi")).alias("registered_doi"))
    lost = synth.registry(spark, d).where(k % 17 == 0).select(made(k).alias("arxiv_id"), F.lit("not_found").alias("status"))
    return items, records.unionByName(lost, allowMissingColumns=True)


_ARXIV_LEG = f"""WITH {synth.sql()}, a AS (
  SELECT *, CAST(pmid AS BIGINT) - 10000000 AS k FROM registry
), records AS (
  SELECT CASE WHEN k % 13 = 0 THEN '2113.' ELSE '2101.' END || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS arxiv_id, CASE WHEN k % 17 = 0 THEN 'not_found' ELSE 'found' END AS status,
         CASE WHEN k % 17 <> 0 THEN title END AS title, CASE WHEN k % 17 <> 0 AND k % 2 = 0 THEN doi END AS registered_doi FROM a
), items AS (
  SELECT *, CASE WHEN (CAST(id AS BIGINT) - 10000000) % 13 = 0 THEN '2113.' ELSE '2101.' END || lpad(CAST((CAST(id AS BIGINT) - 10000000) % 100000 AS VARCHAR), 5, '0') AS aid FROM claims
), j AS (
  SELECT i.*, r.status, r.title, r.registered_doi, {oracles.word_set('claimed_title')} AS cw, {oracles.word_set('title')} AS rw, starts_with(aid, '2101.') AS shaped FROM items i LEFT JOIN records r ON r.arxiv_id = i.aid
), g AS (
  SELECT *, CASE WHEN NOT shaped OR status = 'not_found' THEN 'invalid' WHEN status IS NULL OR coalesce(claimed_title, '') = '' THEN 'unknown' WHEN {oracles.jaccard('cw', 'rw')} >= 0.5 THEN 'correct' ELSE 'mismatch' END AS v,
         coalesce(status = 'found' AND {oracles.clean_doi('claimed_doi')} <> '' AND {oracles.clean_doi('registered_doi')} <> '' AND {oracles.clean_doi('claimed_doi')} <> {oracles.clean_doi('registered_doi')}, false) AS bad FROM j
)
SELECT input_ord, aid AS id, CASE WHEN bad AND v = 'correct' THEN 'partial' ELSE v END AS verdict, bad AS arxiv_doi_mismatch FROM g"""


@query(_ARXIV_LEG)
def verify_arxiv(spark: SparkSession, d: str) -> DataFrame:
    items, records = _arxiv(spark, d)
    rows = verify.verify_arxiv(items, records, synth.registry(spark, d), False)
    return rows.select("input_ord", "id", "verdict", F.coalesce("arxiv_doi_mismatch", F.lit(False)).alias("arxiv_doi_mismatch"))


def _candidates(records: str = "valid", most: int = 3) -> str:
    """CTEs up to cand: the best records of each distinct set of words, by all words that any record shares with it."""
    return f"""idx AS (SELECT pmid AS found, {oracles.word_set('title')} AS words FROM registry WHERE {records}
), held AS (SELECT found, len(words) AS s, unnest(words) AS w FROM idx
), q AS (SELECT id, input_ord, list_sort({oracles.word_set('claimed_title')}) AS q FROM asked WHERE coalesce(claimed_title, '') <> ''
), sets AS (SELECT DISTINCT q FROM q
), shared AS (SELECT q, found, CAST(count(*) AS DOUBLE) / (len(q) + s - count(*)) AS score FROM (SELECT q, unnest(q) AS w FROM sets) JOIN held USING (w) GROUP BY q, found, s
), best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, found) AS rank FROM shared QUALIFY rank <= {most}
), cand AS (SELECT id, input_ord, found, score, rank FROM q JOIN best USING (q))"""


@query(f"WITH {synth.sql()}, asked AS (SELECT * FROM claims), {_candidates()} SELECT input_ord, found, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM cand")
def suggest_topk(spark: SparkSession, d: str) -> DataFrame:
    return verify.title_candidates(synth.claims(spark, d), synth.registry(spark, d)).select("input_ord", "found", "rank", F.round("score", 6).alias("score"))


def _title_leg(items: str) -> str:
    return f"""WITH {synth.sql()}, asked AS ({items}), {_candidates()}, base AS (
  SELECT c.*, k.found, k.rank, r.title, r.authors, r.journal, r.pubdate, r.doi, r.retracted FROM asked c JOIN cand k USING (id, input_ord) JOIN registry r ON r.pmid = k.found
), {oracles.compared('base')}, won AS (
  SELECT input_ord, arg_min(found, rank) AS pmid, arg_min(retracted, rank) AS retracted FROM graded WHERE ladder = 'correct' GROUP BY input_ord
)
SELECT c.input_ord, c.id, b.pmid, CASE WHEN b.pmid IS NULL THEN 'unknown' WHEN b.retracted THEN 'partial' ELSE 'correct' END AS verdict FROM asked c LEFT JOIN won b USING (input_ord)"""


@query(f"SELECT input_ord, pmid, verdict FROM ({_title_leg('SELECT * FROM claims')})")
def title_search(spark: SparkSession, d: str) -> DataFrame:
    return verify.title_search(synth.claims(spark, d), synth.registry(spark, d), False).select("input_ord", "pmid", "verdict")


#: Scanned titles without authors, cited under a wrong record's id or their own.
_SHIFTED = "SELECT * REPLACE ('scan.txt' AS label, false AS explicit, CAST(NULL AS VARCHAR[]) AS claimed_authors, CAST(10000000 + (CAST(id AS BIGINT) - 10000000) % 60 + 1 AS VARCHAR) AS id) FROM claims"


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    key = c("id").cast("long") - 10_000_000
    return synth.claims(spark, d).withColumns({"label": F.lit("scan.txt"), "explicit": F.lit(False), "claimed_authors": F.lit(None).cast("array<string>"), "id": (key % 60 + 10_000_001).cast("string")})


@query(f"{_PMID.replace('FROM claims c LEFT JOIN', f'FROM ({_SHIFTED}) c LEFT JOIN')} SELECT input_ord, verdict, route FROM pmid_rows WHERE route = 'mismatch_gated'")
def mismatch_gate(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify_pmid(_shifted(spark, d), synth.registry(spark, d), False).where("route = 'mismatch_gated'").select("input_ord", "verdict", "route")


#: Of these, every second title is cut inside its first and last words.
_CUT = f"SELECT * REPLACE (CASE WHEN input_ord % 2 = 0 THEN substring(claimed_title, 3, greatest(length(claimed_title) - 3, 0)) ELSE claimed_title END AS claimed_title) FROM ({_SHIFTED})"


def _cut(spark: SparkSession, d: str) -> DataFrame:
    inner = F.substr("claimed_title", F.lit(3), F.greatest(F.length("claimed_title") - 3, F.lit(0)))
    return _shifted(spark, d).withColumn("claimed_title", F.when(c("input_ord") % 2 == 0, inner).otherwise(c("claimed_title")))


@query(f"""{_PMID.replace('FROM claims c LEFT JOIN', f'FROM ({_CUT}) c LEFT JOIN')}, gated AS (
  SELECT *, {oracles.folded('claimed_title')} AS q FROM pmid_rows WHERE route = 'mismatch_gated' AND len(cw) >= 4
), titles AS (SELECT pmid, {oracles.folded('title')} AS t FROM registry WHERE valid
), held AS (SELECT q, pmid FROM (SELECT DISTINCT q FROM gated) JOIN titles ON contains(t, q)
), found AS (
  SELECT g.input_ord, bool_or(h.pmid = g.id) AS same, min(h.pmid) AS other FROM gated g JOIN held h USING (q) GROUP BY g.input_ord
)
SELECT p.input_ord, CASE WHEN same THEN 'correct' ELSE verdict END AS verdict, coalesce(NOT same, false) AS wrong_pmid_signal, CASE WHEN NOT same THEN other END AS suggested FROM pmid_rows p LEFT JOIN found f USING (input_ord)""")
def second_opinion(spark: SparkSession, d: str) -> DataFrame:
    registry = synth.registry(spark, d)
    graded = verify.verify_pmid(_cut(spark, d), registry, False).select("id", "input_ord", "claimed_title", "verdict", "route")
    rows = verify.second_opinion(graded, registry)
    return rows.select("input_ord", "verdict", "wrong_pmid_signal", "suggested")


_CACHE = "SELECT CAST(o_custkey + 10000000 AS VARCHAR) AS pmid, o_orderkey % 7 <> 0 AS valid, o_orderdate AS cached_at, o_orderkey AS version FROM orders"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return synth.table(spark, d, "orders").select((c("o_custkey") + 10_000_000).cast("string").alias("pmid"), (c("o_orderkey") % 7 != 0).alias("valid"), c("o_orderdate").alias("cached_at"), c("o_orderkey").alias("version"))


@query(f"SELECT pmid, valid, version FROM ({_CACHE}) WHERE cached_at > TIMESTAMP '2001-07-15' - CASE WHEN valid THEN INTERVAL 30 DAY ELSE INTERVAL 3 DAY END")
def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    return rollup.fresh(_cache(spark, d), F.expr("timestamp_ntz '2001-07-15'")).select("pmid", "valid", "version")


@query(f"SELECT pmid, valid, version FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY cached_at DESC, valid, version) AS n FROM ({_CACHE}) WHERE NOT (version % 2 = 1 AND version % 5 = 0)) WHERE n = 1")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _cache(spark, d)
    new = rows.where("version % 2 = 1").withColumn("network_error", c("version") % 5 == 0)
    return rollup.upserted(rows.where("version % 2 = 0"), new).select("pmid", "valid", "version")


@query(f"WITH {synth.sql()} SELECT r.pmid, CASE WHEN network_error AND s_suppkey IS NOT NULL THEN s_name ELSE title END AS title, CASE WHEN network_error AND s_suppkey IS NOT NULL THEN true ELSE valid END AS valid FROM registry r LEFT JOIN supplier ON r.pmid = CAST(s_suppkey + 10000000 AS VARCHAR)")
def coalesce_sources(spark: SparkSession, d: str) -> DataFrame:
    second = synth.table(spark, d, "supplier").select((c("s_suppkey") + 10_000_000).cast("string").alias("pmid"), c("s_name").alias("title"), F.lit(True).alias("valid"))
    return verify.coalesce_sources(synth.registry(spark, d), second).select("pmid", "title", "valid")


@query(f"WITH {synth.sql()} SELECT id, input_ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY explicit DESC, input_ord) AS n FROM claims) WHERE n = 1")
def dedup_explicit_first(spark: SparkSession, d: str) -> DataFrame:
    return verify.keep_first(synth.claims(spark, d)).select("id", "input_ord")


@query(f"WITH {synth.sql()} SELECT c.input_ord FROM claims c WHERE {oracles.clean_doi('claimed_doi')} NOT IN (SELECT {oracles.clean_doi('doi')} FROM registry WHERE valid) AND claimed_doi IS NOT NULL")
def doi_merge_anti(spark: SparkSession, d: str) -> DataFrame:
    items = synth.claims(spark, d).where("claimed_doi is not null").withColumn("id", c("claimed_doi"))
    return verify.doi_merged(items, synth.registry(spark, d)).select("input_ord")


_STATS = "count(*) AS total, " + ", ".join(f"count_if(verdict = '{v}') AS {v}" for v in rollup.VERDICTS) + ", count_if(retracted) AS retracted, count_if(doi_splice) AS doi_splice, count_if(network_error) AS network_errors, " + ", ".join(f"count_if(route = '{r}') AS {r}" for r in ("existence_only", "mismatch_gated", "existence_title_match"))


@query(f"{_PMID} SELECT {_STATS} FROM pmid_rows")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return rollup.stats(_rows(spark, d)).select("total", *rollup.VERDICTS, "retracted", "doi_splice", "network_errors", "existence_only", "mismatch_gated", "existence_title_match")


@query(f"{_PMID}, s AS (SELECT {_STATS} FROM pmid_rows) SELECT invalid + mismatch + retracted + doi_splice AS problems, invalid + mismatch + retracted + doi_splice = 0 AND network_errors = 0 AS ready, CAST(CASE WHEN network_errors > 0 THEN 2 WHEN invalid + mismatch + retracted + doi_splice > 0 THEN 1 ELSE 0 END AS INT) AS exit_code FROM s")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return rollup.readiness(rollup.stats(_rows(spark, d))).select("problems", "ready", "exit_code")


@query(f"{_PMID} SELECT verdict, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM pmid_rows GROUP BY verdict")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"{_PMID} SELECT id AS key, input_ord, CASE WHEN verdict IN ('correct', 'mismatch', 'invalid') THEN 'answered' WHEN verdict = 'partial' THEN 'partially' ELSE 'unresolved' END AS bucket FROM pmid_rows")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    return rollup.ledger(_rows(spark, d)).select("key", "input_ord", "bucket")


#: The earlier run: some rows missing, some with another verdict.
_OLD = "SELECT CAST(input_ord AS VARCHAR) AS key, CASE WHEN input_ord % 6 = 0 THEN 'mismatch' WHEN input_ord % 10 = 0 THEN 'correct' ELSE verdict END AS was, retracted AND input_ord % 4 = 0 AS was_retracted FROM pmid_rows WHERE input_ord % 9 <> 0"
_NEW = "SELECT CAST(input_ord AS VARCHAR) AS key, verdict AS now, retracted, network_error FROM pmid_rows WHERE input_ord % 14 <> 0"


#: The changes: key, category, was, now.
_CHANGES = f"""{_PMID}, j AS (SELECT coalesce(o.key, n.key) AS key, o.key IS NOT NULL AS old, n.key IS NOT NULL AS new, was, now, coalesce(was_retracted, false) AS wr, coalesce(retracted, false) AS nr, coalesce(network_error, false) AS down FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n ON o.key = n.key),
changes AS (SELECT key, 'newly_retracted' AS category, was, now FROM j WHERE new AND nr AND NOT wr
UNION ALL SELECT key, CASE WHEN NOT old THEN 'new' WHEN NOT new THEN 'dropped' WHEN was = 'correct' THEN 'degraded' ELSE 'improved' END, was, now FROM j
WHERE NOT old OR NOT new OR (was = 'correct' AND now IN ('mismatch', 'invalid', 'unknown') AND NOT nr AND NOT down) OR (was IN ('mismatch', 'invalid', 'unknown') AND now = 'correct'))"""


@query(f"{_CHANGES} SELECT key, category FROM changes")
def delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).select("key", "category")


def _delta(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("key", c("input_ord").cast("string"))
    old = rows.where("input_ord % 9 <> 0").select("key", F.when(c("input_ord") % 6 == 0, "mismatch").when(c("input_ord") % 10 == 0, "correct").otherwise(c("verdict")).alias("verdict"), (c("retracted") & (c("input_ord") % 4 == 0)).alias("retracted"))
    return rollup.delta(old, rows.where("input_ord % 14 <> 0"))


@query(f"{_PMID} SELECT input_ord, CAST(CASE WHEN retracted OR doi_splice THEN 0 ELSE CASE verdict WHEN 'mismatch' THEN 1 WHEN 'invalid' THEN 2 WHEN 'partial' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END END AS INT) AS severity FROM pmid_rows ORDER BY severity, input_ord")
def sort_severity(spark: SparkSession, d: str) -> DataFrame:
    return rollup.by_severity(_rows(spark, d)).select("input_ord", "severity")


@query(f"{_PMID} SELECT input_ord, cited_by_count FROM pmid_rows ORDER BY cited_by_count IS NULL, coalesce(cited_by_count, 0) DESC, input_ord")
def sort_cited(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).orderBy(*rollup.cited_rank()).select("input_ord", "cited_by_count")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an identifier of each kind planted after them."""
    k = c("doc_id")
    tail = F.concat(F.lit(" PMID: "), (k + 20_000_000).cast("string"), F.lit(". doi:10.1000/Doc."), k.cast("string"), F.lit(". see arXiv:2101."), F.lpad((k % 100_000).cast("string"), 5, "0"), F.lit("."))
    return synth.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


@query("SELECT doc_id, CAST(doc_id + 20000000 AS VARCHAR) AS id FROM documents")
def extract_pmid(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_texts(spark, d), ("pmid",), "doc_id").select("doc_id", "id")


@query("SELECT doc_id, '10.1000/doc.' || doc_id AS id FROM documents")
def extract_doi(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_texts(spark, d), ("doi",), "doc_id").select("doc_id", "id")


@query("SELECT doc_id, '2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS id FROM documents")
def extract_arxiv(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_texts(spark, d), ("arxiv",), "doc_id").select("doc_id", "id")


@query()
def parse_context(spark: SparkSession, d: str) -> DataFrame:
    """Claims read back from citations written in one style."""
    rows = synth.registry(spark, d).withColumns({"authors_truncated": F.lit(False), "authors": F.array_join("authors", ", "), "doi": F.lit("")})
    line = F.concat(styles.reference("vancouver", F.lit(1)), F.lit(" PMID: "), c("pmid"))
    return rows.select("pmid", context.parse_context(line).alias("claim")).select("pmid", "claim.*")


@query()
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            frame["text"] = [html_text(h or "") for h in frame["html"]]
            yield frame[["page_id", "text"]]

    return synth.table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, text string")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS entry FROM conversations")
def entry_split(spark: SparkSession, d: str) -> DataFrame:
    return rollup.numbered_entries(synth.table(spark, d, "conversations"), "conv_id", "turn", c("role") == "user").select("conv_id", "turn", "entry")


@query("SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'pmid' WHEN 1 THEN 'pmid' WHEN 2 THEN 'doi' WHEN 3 THEN 'arxiv' ELSE 'none' END AS route, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN CAST(p_partkey + 10000000 AS VARCHAR) WHEN 1 THEN CAST(p_partkey + 10000000 AS VARCHAR) WHEN 2 THEN '10.1/' || p_partkey WHEN 3 THEN '2101.00001' END AS id FROM part")
def route(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    kind, pmid = k % 5, (k + 10_000_000).cast("string")
    fields = F.when(kind == 0, F.create_map(F.lit("pmid"), pmid, F.lit("doi"), F.lit("10.1/x"))).when(kind == 1, F.create_map(F.lit("note"), F.concat(F.lit("see PMID: "), pmid))).when(kind == 2, F.create_map(F.lit("doi"), F.concat(F.lit("10.1/"), k.cast("string")))).when(kind == 3, F.create_map(F.lit("journal"), F.lit("arXiv:2101.00001"))).otherwise(F.create_map(F.lit("title"), F.lit("x")))
    return bibliography.routed(synth.table(spark, d, "part").select("p_partkey", fields.alias("fields"))).select("p_partkey", "route", "id")


_LINT = "SELECT o_orderkey AS input_ord, CASE WHEN o_orderkey % 5 = 0 THEN 'x1' WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS pmid, CASE WHEN o_orderkey % 10 = 1 THEN '11.1/x' END AS doi, CASE WHEN o_orderkey % 20 = 6 THEN '2113.00001' END AS arxiv_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 't' END AS title FROM orders"


@query(f"""WITH r AS (SELECT *, coalesce(pmid, doi, arxiv_id) AS key FROM ({_LINT})), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY input_ord) AS nth FROM r)
SELECT input_ord, 'missing_id' AS tag, 'ERROR' AS severity FROM n WHERE key IS NULL UNION ALL SELECT input_ord, 'pmid_not_digits', 'ERROR' FROM n WHERE pmid = 'x1'
UNION ALL SELECT input_ord, 'arxiv_shape', 'ERROR' FROM n WHERE arxiv_id IS NOT NULL UNION ALL SELECT input_ord, 'doi_prefix', 'WARN' FROM n WHERE doi IS NOT NULL
UNION ALL SELECT input_ord, 'duplicate_key', 'WARN' FROM n WHERE key IS NOT NULL AND nth > 1 UNION ALL SELECT input_ord, 'no_title', 'WARN' FROM n WHERE title = ''""")
def lint(spark: SparkSession, d: str) -> DataFrame:
    o = c("o_orderkey")
    rows = synth.table(spark, d, "orders").select(o.alias("input_ord"), F.when(o % 5 == 0, "x1").when(o % 5 != 1, c("o_custkey").cast("string")).alias("pmid"), F.when(o % 10 == 1, "11.1/x").alias("doi"), F.when(o % 20 == 6, "2113.00001").alias("arxiv_id"), F.when(o % 3 == 0, "").otherwise("t").alias("title"))
    return rollup.lint(rows)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN '''@' || c_name ELSE c_name END AS cell FROM customer")
def csv_safe(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    return synth.table(spark, d, "customer").select(k, text.formula_safe(F.concat(F.when(k % 3 == 0, "=").when(k % 3 == 1, "@").otherwise(""), c("c_name"))).alias("cell"))


_KEYWORDS = "[CASE WHEN p_partkey % 2 = 0 THEN 'early' ELSE 'trial' END, 'SLE', 'k' || p_partkey]"


@query(f"WITH {synth.sql()} SELECT p_partkey, round({oracles.keyword_score('title', _KEYWORDS)}, 6) AS score FROM registry JOIN part ON pmid = CAST(p_partkey + 10000000 AS VARCHAR)")
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    k = c("pmid").cast("long") - 10_000_000
    keywords = F.array(F.when(k % 2 == 0, "early").otherwise("trial"), F.lit("SLE"), F.concat(F.lit("k"), k.cast("string")))
    return synth.registry(spark, d).select(k.alias("p_partkey"), F.round(text.keyword_score(c("title"), keywords), 6).alias("score"))


def _references(style: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = export.display(synth.registry(spark, d))
        return rows.select("pmid", styles.reference(style, c("pmid").cast("long") - 10_000_000).alias("entry"))

    run.__name__ = f"ref_{style}"
    return run


_PLACE = "volume || CASE WHEN issue IS NOT NULL THEN '(' || issue || ')' ELSE '' END"
_NAMES = {
    "gbt": "array_to_string(list_transform(authors, lambda a: upper(a)), ', ')",
    "vancouver": "array_to_string(authors, ', ')",
    "harvard": "array_to_string(list_transform(authors[1:2], lambda a: replace(a, ' ', ', ') || '.'), ', ') || ' and ' || replace(authors[3], ' ', ', ') || '.'",
    "chicago": "array_to_string(list_transform(authors[1:2], lambda a: replace(a, ' ', ', ')), ', ') || ', and ' || replace(authors[3], ' ', ', ')",
    "apa": "array_to_string(list_transform(authors[1:2], lambda a: replace(a, ' ', ', ') || '.'), ', ') || ', & ' || replace(authors[3], ' ', ', ') || '.'",
}
_LINES = {
    "gbt": f"'[' || (CAST(pmid AS BIGINT) - 10000000) || '] ' || {_NAMES['gbt']} || '. ' || title || '[J]. ' || journal || ', ' || pubdate[1:4] || ', ' || {_PLACE} || ': ' || pages || '. DOI:' || doi || '.'",
    "gbty": f"{_NAMES['gbt']} || '. ' || title || '. ' || journal || ', ' || pubdate[1:4] || ', ' || {_PLACE} || ': ' || pages || '. DOI:' || doi || '.'",
    "vancouver": f"(CAST(pmid AS BIGINT) - 10000000) || '. ' || {_NAMES['vancouver']} || '. ' || title || '. ' || journal || '. ' || pubdate[1:4] || ';' || {_PLACE} || ':' || pages || '. doi:' || doi",
    "apa": f"{_NAMES['apa']} || ' (' || pubdate[1:4] || '). ' || title || '. ' || journal || ', ' || {_PLACE} || ', ' || pages || '. https://doi.org/' || doi",
    "harvard": f"{_NAMES['harvard']} || ' (' || pubdate[1:4] || ') ''' || title || ''', ' || journal || ', ' || {_PLACE} || ', pp. ' || pages || '. doi: ' || doi || '.'",
    "chicago": f"{_NAMES['chicago']} || '. \"' || title || '.\" ' || journal || ' ' || volume || CASE WHEN issue IS NOT NULL THEN ', no. ' || issue ELSE '' END || ' (' || pubdate[1:4] || '): ' || pages || '. https://doi.org/' || doi || '.'",
}
_LINES["ama"] = _LINES["vancouver"]
for _style in styles.STYLES:
    query(f"WITH {synth.sql()} SELECT pmid, {_LINES[_style]} AS entry FROM registry")(_references(_style))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    return export.display(_rows(spark, d).withColumn("pmid", c("id")))


_STATUS = "CASE WHEN retracted THEN 'retracted' WHEN NOT valid THEN 'excluded' WHEN verdict = 'correct' THEN 'included' WHEN verdict = 'partial' THEN 'partial' ELSE 'excluded' END"
_FIRST = f"{_PMID}, firsts AS (SELECT *, {_STATUS} AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY input_ord) AS n FROM pmid_rows) WHERE n = 1)"


@query(f"{_FIRST} SELECT count_if(status = 'included') AS included, count_if(status = 'partial') AS partial, count_if(status IN ('excluded', 'retracted')) AS excluded FROM firsts")
def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.export_counts(_cited(spark, d))


_BIB_BODY = r"""'@article{' || lower(split_part(authors[1], ' ', 1)) || pubdate[1:4] || 'pmid' || id || ',' || chr(10) || '  pmid = {' || id || '},' || chr(10) || '  title = {' || replace(title, '#', '\#') || '},' || chr(10) || '  author = {' || array_to_string(list_transform(authors, lambda a: replace(a, ' ', ', ')), ' and ') || '},' || chr(10) || '  journal = {' || journal || '},' || chr(10) || '  year = {' || pubdate[1:4] || '},' || chr(10) || '  volume = {' || volume || '},' || chr(10) || '  pages = {' || pages || '},' || chr(10) || '  doi = {' || doi || '},' || chr(10) || '  note = {verified (' || verdict || '; PMID ' || id || ')}' || chr(10) || '}'"""
_GONE = "'% EXCLUDED (RETRACTED): PMID ' || id || ' — do not cite.'"


@query(f"{_FIRST}, b AS (SELECT *, {_BIB_BODY} AS body FROM firsts) SELECT input_ord, id AS pmid, status, CASE status WHEN 'included' THEN body WHEN 'partial' THEN '% PARTIAL MATCH — verify manually: …' || chr(10) || '% ' || replace(body, chr(10), chr(10) || '% ') WHEN 'retracted' THEN {_GONE} END AS entry FROM b")
def bib(spark: SparkSession, d: str) -> DataFrame:
    """All entries; the reason of a partial one, which is the ladder's text, is shown as an ellipsis."""
    return export.bibtex(_cited(spark, d)).withColumn("entry", F.regexp_replace("entry", r"^(% PARTIAL MATCH — verify manually: )[^\n]*", "$1…"))


@query(f"{_FIRST} SELECT input_ord, id AS pmid, status, CASE WHEN status IN ('included', 'partial') THEN 'TY  - ' || CASE verdict WHEN 'correct' THEN 'JOUR' ELSE 'DATA' END || chr(10) || 'TI  - ' || title || chr(10) || array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)) || chr(10) || 'JO  - ' || journal || chr(10) || 'PY  - ' || pubdate[1:4] || chr(10) || 'DO  - ' || doi || chr(10) || 'AN  - ' || id || chr(10) || 'N1  - verified (' || verdict || '; PMID ' || id || ')' || CASE verdict WHEN 'partial' THEN '; PARTIAL MATCH — verify manually: …' ELSE '' END || chr(10) || 'ER  - ' WHEN status = 'retracted' THEN {_GONE} END AS entry FROM firsts")
def ris(spark: SparkSession, d: str) -> DataFrame:
    """All records, with an ellipsis for the reason of a partial one."""
    return export.ris(_cited(spark, d)).withColumn("entry", F.regexp_replace("entry", r"(PARTIAL MATCH — verify manually: )[^\n]*", "$1…"))


@query(f"""{_FIRST} SELECT input_ord, id AS pmid, status, 'pmid:' || id AS cite, title, journal, CAST(pubdate[1:4] AS INT) AS year, list_transform(authors, lambda a: split_part(a, ' ', 1)) AS families, volume, pages, doi, 'verified (' || verdict || ')' AS note FROM firsts WHERE status IN ('included', 'partial')""")
def csl(spark: SparkSession, d: str) -> DataFrame:
    """Items read back from their JSON; the reason of a partial one is cut off."""
    schema = "id STRING, title STRING, `container-title` STRING, issued STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, author ARRAY<STRUCT<family: STRING, given: STRING, literal: STRING>>, volume STRING, page STRING, DOI STRING, note STRING"
    x = export.csl(_cited(spark, d)).withColumn("x", F.from_json("item", schema))
    return x.select("input_ord", "pmid", "status", c("x.id").alias("cite"), "x.title", c("x.container-title").alias("journal"), F.get(F.get("x.issued.date-parts", F.lit(0)), F.lit(0)).alias("year"), F.transform("x.author", lambda a: a["family"]).alias("families"), "x.volume", c("x.page").alias("pages"), c("x.DOI").alias("doi"), F.regexp_extract("x.note", r"^([^;]*)", 1).alias("note"))


@query(f"{_FIRST} SELECT CASE WHEN status = 'included' THEN 'verified' ELSE 'review' END AS section, row_number() OVER (PARTITION BY status ORDER BY input_ord) AS n, id AS pmid FROM firsts WHERE status IN ('included', 'partial')")
def reference_list(spark: SparkSession, d: str) -> DataFrame:
    return export.reference_list(_cited(spark, d), "gbt").select("section", "n", "pmid")


def _numbered(style: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return export.reference_list(_cited(spark, d), style)

    run.__name__ = f"reference_list_{style}"
    return run


for _style in styles.AUTHOR_DATE:
    query(f"{_FIRST}, placed AS (SELECT * EXCLUDE (n), id AS pmid, row_number() OVER (PARTITION BY status ORDER BY lower(authors[1]), input_ord) AS n FROM firsts WHERE status IN ('included', 'partial')) SELECT CASE WHEN status = 'included' THEN 'verified' ELSE 'review' END AS section, n, pmid, {_LINES[_style]} AS entry FROM placed")(_numbered(_style))


@query(f"{_PMID} SELECT input_ord, id AS pmid, label, claimed_title, title, doi, verdict FROM pmid_rows")
def audit_json(spark: SparkSession, d: str) -> DataFrame:
    """Audit records read back from their JSON."""
    x = F.from_json("item", "pmid STRING, source_file STRING, claimed STRUCT<claimed_title: STRING>, registered STRUCT<title: STRING, doi: STRING>, verdict STRUCT<final: STRING>")
    return export.audit_items(_rows(spark, d)).withColumn("x", x).select("input_ord", "x.pmid", c("x.source_file").alias("label"), "x.claimed.claimed_title", "x.registered.title", "x.registered.doi", c("x.verdict.final").alias("verdict"))


def _md(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')), '([\\\[\]|])', '\\\1', 'g')[1:120]"


@query(f"{_PMID} SELECT input_ord, '| ' || id || ' | ' || verdict || ' | …' || ' | ' || {_md('claimed_title')} || ' | ' || {_md('title')} || ' | …' AS line FROM pmid_rows")
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Table rows; the confidence and the reason are shown as an ellipsis."""
    rows = export.markdown_rows(export.display(_rows(spark, d)))
    cells = F.split("line", r" \| ")
    return rows.select("input_ord", F.concat_ws(" | ", F.get(cells, F.lit(0)), F.get(cells, F.lit(1)), F.lit("…"), F.get(cells, F.lit(3)), F.get(cells, F.lit(4)), F.lit("…")).alias("line"))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"{_PMID} SELECT input_ord, CAST(CASE WHEN retracted OR doi_splice THEN 0 ELSE CASE verdict WHEN 'mismatch' THEN 1 WHEN 'invalid' THEN 2 WHEN 'partial' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END END AS INT) AS severity, '<tr class=\"' || verdict || CASE WHEN retracted THEN ' retracted' ELSE '' END || CASE WHEN doi_splice THEN ' splice' ELSE '' END || '\"><td>' || id || '</td><td>' || verdict || '</td>' AS head, '<td>' || {_escaped('claimed_title')} || '</td><td>' || {_escaped('title')} || '</td><td>' || {_escaped('array_to_string(authors[1:3], chr(44) || chr(32))')} || '</td><td>' || {_escaped('journal')} || '</td><td>' || {_escaped('pubdate')} || '</td><td>' || {_escaped('doi')} || '</td>' AS cells FROM pmid_rows")
def report_html(spark: SparkSession, d: str) -> DataFrame:
    """Table rows without confidence, reason and label."""
    rows = export.html_rows(export.display(_rows(spark, d)))
    shape = r"^(<tr[^>]*>(?:<td>[^<]*</td>){2})<td>[^<]*</td>((?:<td>[^<]*</td>){6})"
    return rows.select("input_ord", "severity", F.regexp_extract("row", shape, 1).alias("head"), F.regexp_extract("row", shape, 2).alias("cells"))


@query(f"{_PMID} SELECT input_ord, id, verdict, coalesce(title, '') AS title, coalesce(array_to_string(authors[1:3], ', '), '') AS authors, coalesce(journal, '') AS journal, coalesce(pubdate, '') AS pubdate, coalesce(doi, '') AS doi, coalesce(claimed_title, '') AS claimed_title, coalesce(claimed_journal, '') AS claimed_journal, coalesce(claimed_year, '') AS claimed_year, label FROM pmid_rows")
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """The CSV report without confidence, reason and the flag's spelling."""
    return export.csv_rows(export.display(_rows(spark, d))).select("input_ord", "id", "verdict", "title", "authors", "journal", "pubdate", "doi", "claimed_title", "claimed_journal", "claimed_year", "label")


@query(f"WITH {synth.sql()} SELECT coalesce(id, '') AS pmid, coalesce(claimed_title, '') AS title, coalesce(array_to_string(claimed_authors, '; '), '') AS authors, coalesce(claimed_journal, '') AS journal, coalesce(claimed_year, '') AS year FROM claims")
def claims_template(spark: SparkSession, d: str) -> DataFrame:
    return export.claims_template(synth.claims(spark, d).withColumn("pmid", c("id"))).select("pmid", "title", "authors", "journal", "year")
