"""The queries of the operators in this subpackage, and DuckDB SQL where SQL can express one.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.llm import codes, decontam, html_blocks, langid, licenses, media, mixing, neardup, negatives, pii, quality, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarize(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def mined_label() -> Column:
    """The label of a row of embeddings; that of every seventh id is moved to the next of ten, as wrong labels are."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), mined_label())


def mixing_sql() -> str:
    """The raking as a chain of windows, a step for each dimension and round."""
    topics = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in mixing.TOPICS)
    steps = [
        rf"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topics} ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)
), c AS (
  SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY source, lang, topic
)"""
    ]
    for name in mixing.DIMENSIONS:
        steps.append(f"goal_{name} AS (SELECT {name}, sqrt(m) / sum(sqrt(m)) OVER () AS goal_{name} FROM (SELECT {name}, CAST(sum(tokens) AS DOUBLE) AS m FROM c GROUP BY {name}))")
    steps.append("r0 AS (SELECT c.*, goal_source, goal_lang, goal_topic, CAST(tokens AS DOUBLE) AS raked FROM c JOIN goal_source USING (source) JOIN goal_lang USING (lang) JOIN goal_topic USING (topic))")
    for at in range(mixing.ROUNDS * 3):
        name = mixing.DIMENSIONS[at % 3]
        steps.append(f"r{at + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN mass > 0 THEN raked * goal_{name} / mass ELSE 0 END AS raked) FROM (SELECT *, sum(raked) OVER (PARTITION BY {name}) AS mass FROM (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, raked FROM r{at})))")
    return (
        ", ".join(steps)
        + f""", w AS (SELECT source, lang, topic, round(least(1, ratio), 9) AS probability, round(greatest(1, ratio), 9) AS weight
  FROM (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN raked * CAST(sum(tokens) OVER () AS DOUBLE) / CAST(tokens AS DOUBLE) ELSE 0 END AS ratio FROM r{mixing.ROUNDS * 3}))
SELECT doc_id, source, lang, topic, n_tokens, probability, weight,
       CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{mixing.SEED}'), 1, 12)) AS BIGINT) AS DOUBLE) / {float(1 << 48)} < probability AS kept
FROM d JOIN w USING (source, lang, topic)"""
    )


def codes_sql() -> str:
    """Lloyd's rounds as a chain of assignments and codebooks, all parts of all vectors anew in each."""

    def assigned(at: int) -> str:
        far = "SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM part JOIN b{} USING (p)".format(at)
        return f"a{at} AS MATERIALIZED (SELECT r, p, min(far) AS far, arg_min(e, far * 256 + e) AS e FROM ({far}) GROUP BY r, p)"

    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))
), part AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {codes.PARTS}) + 1:(p + 1) * (len(v) // {codes.PARTS})] AS x FROM kept, (SELECT unnest(range({codes.PARTS})) AS p)
), b0 AS (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {codes.ENTRIES})"""
    ]
    for at in range(codes.ROUNDS):
        steps.append(assigned(at))
        sums = f"SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{at} JOIN part USING (r, p)) GROUP BY p, e, i"
        moved = f"SELECT p, e, list({floor} ORDER BY i) AS c FROM (SELECT p, e, i, CAST(s AS BIGINT) AS s, n FROM ({sums})) GROUP BY p, e"
        steps.append(f"b{at + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{at} b LEFT JOIN ({moved}) m USING (p, e))")
    last = codes.ROUNDS
    steps.append(assigned(last))
    return (
        ", ".join(steps)
        + f""", coded AS (
  SELECT r, string_agg(lower(format('{{:02x}}', e)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{last} GROUP BY r
), named AS (
  SELECT vec_id, label, code, error FROM coded JOIN kept USING (r)
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM named, digest"""
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_source_mixing, op4_quality, op5_html_text, op6_license_scan, op7_pii, op8_decontamination, op9_media, op10_toxicity, op11_simhash_neardup, op12_vector_codes, op13_hard_negatives)}

ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing_sql(),
    "op12_vector_codes": codes_sql(),
    "op13_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT a, b, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
""",
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id
""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN win ON dw.win = win.win AND dw.k = win.k
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
