"""DuckDB SQL of the comparisons and legs, built from the same fixed values as the column expressions."""

from __future__ import annotations

from refsieve.functions.match import ABBREV_STOP, JOURNAL_STOP
from refsieve.functions.text import KEYWORDS, STOP_WORDS
from refsieve.plans.synth import sql as synth_sql


def words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def folded(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def word_set(x: str) -> str:
    return f"list_filter(list_distinct(string_split({folded(f'coalesce({x}, {chr(39) * 2})')}, ' ')), lambda w: NOT list_contains({words([*STOP_WORDS, ''])}, w))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def surnames(x: str) -> str:
    parts = r"list_filter(string_split(regexp_replace(n, '\s+', ' ', 'g'), ' '), lambda p: p <> '')"
    one = f"regexp_replace(lower(coalesce(CASE WHEN len({parts}) > 1 AND (length({parts}[1]) = 1 OR contains({parts}[1], '.')) THEN {parts}[-1] ELSE {parts}[1] END, '')), '[.,]+$', '')"
    return f"list_filter(list_transform({x}, lambda n: {one}), lambda s: length(s) >= 2)"


def journal_words(x: str, stops: list[str], dots: bool) -> str:
    one = r"regexp_replace(w, '\.+$', '')" if dots else "w"
    return rf"list_filter(list_transform(string_split(regexp_replace(lower(trim({x})), '\s+', ' ', 'g'), ' '), lambda w: {one}), lambda w: w <> '' AND NOT list_contains({words(stops)}, w))"


def in_order(w: str, pool: str) -> str:
    """The greedy walk; its state, the next place or -1, is kept as text among the words."""
    step = f"CASE WHEN CAST(acc AS INT) < 0 OR CAST(acc AS INT) > len({pool}) - 1 THEN '-1' ELSE CAST(coalesce(nullif(list_position(list_transform({pool}[CAST(acc AS INT) + 1:], lambda x: starts_with(x, y)), true), 0) + CAST(acc AS INT), -1) AS VARCHAR) END"
    return f"CAST(list_reduce(list_prepend('0', {w}), lambda acc, y: {step}) AS INT) >= 0"


def abbreviates(a: str, b: str) -> str:
    """On word lists."""
    return f"(len({a}) > 0 AND len({b}) > 0 AND len({a}) <= len({b}) AND ({in_order(a, b)} OR (len({a}) >= 2 AND {in_order(f'list_transform({a}, lambda z: z[1:1])', b)})))"


def clean_doi(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '^(?:(?:https?://(?:dx\.)?doi\.org/|dx\.doi\.org/|doi\.org/|doi:)\s*)+', ''), '(?s)\?.*$', ''), '[.,;:。，；）」】)\]}}!?！？\"”’''\s]+$', '')"""


def compared(base: str) -> str:
    """CTEs cmp and graded over a relation with claimed_*, title, authors, journal and pubdate."""
    cjk = r"'[぀-ヿ㐀-䶿一-鿿가-힯]'"
    return f"""pre AS (
  SELECT *, {word_set('claimed_title')} AS cw, {word_set('title')} AS rw,
         coalesce(claimed_title, '') <> '' AND coalesce(title, '') <> '' AS title_ran,
         coalesce(claimed_title, '') <> '' AND coalesce(title, '') <> '' AND regexp_matches(claimed_title, {cjk}) <> regexp_matches(title, {cjk}) AS title_skipped,
         {surnames('claimed_authors')} AS ca, {surnames('authors[1:10]')} AS ra,
         {journal_words('claimed_journal', JOURNAL_STOP, False)} AS cj, {journal_words('journal', JOURNAL_STOP, False)} AS rj,
         {journal_words('claimed_journal', ABBREV_STOP, True)} AS ca_j, {journal_words('journal', ABBREV_STOP, True)} AS ra_j,
         regexp_extract(coalesce(pubdate, ''), '((?:19|20)[0-9]{{2}})', 1) AS reg_year
  FROM {base}
), pre2 AS (
  SELECT *, CASE WHEN title_ran AND NOT title_skipped THEN {jaccard('cw', 'rw')} END AS word_ratio,
         coalesce(len(ca), 0) > 0 AND coalesce(len(ra), 0) > 0 AS author_ran,
         CASE WHEN coalesce(len(ca), 0) > 0 AND coalesce(len(ra), 0) > 0 THEN len(list_filter(ca, lambda s: len(list_filter(ra, lambda r: contains(r, s))) > 0)) END AS author_hits,
         coalesce(claimed_journal, '') <> '' AND coalesce(journal, '') <> '' AS journal_ran,
         coalesce(claimed_year, '') <> '' AND reg_year <> '' AS year_ran
  FROM pre
), cmp AS (
  SELECT *, coalesce(word_ratio >= 0.5, false) AS title_match,
         author_ran AND author_hits >= CASE WHEN len(ca) >= 2 THEN 2 ELSE 1 END AS author_match,
         journal_ran AND (contains(lower(trim(journal)), lower(trim(claimed_journal))) OR contains(lower(trim(claimed_journal)), lower(trim(journal)))
           OR (len(cj) > 0 AND len(rj) > 0 AND CAST(len(list_intersect(cj, rj)) AS DOUBLE) / least(len(list_distinct(cj)), len(list_distinct(rj))) >= 0.5)
           OR {abbreviates('ca_j', 'ra_j')} OR {abbreviates('ra_j', 'ca_j')}) AS journal_match,
         year_ran AND claimed_year = reg_year AS year_match,
         coalesce(claimed_title, '') <> '' AS has_title, coalesce(len(claimed_authors), 0) > 0 AS has_authors
  FROM pre2
), graded AS (
  SELECT *, (CAST(title_ran AS INT) + CAST(author_ran AS INT) + CAST(journal_ran AS INT) + CAST(year_ran AS INT)) AS checks,
         (CAST(title_match AS INT) + CAST(author_match AS INT) + CAST(journal_match AS INT) + CAST(year_match AS INT)) AS wins,
         CASE WHEN NOT title_ran AND NOT author_ran AND NOT journal_ran AND NOT year_ran THEN 'unknown'
              WHEN NOT has_title AND NOT has_authors THEN 'unknown'
              WHEN NOT has_title OR title_skipped THEN 'partial'
              WHEN title_match AND (author_match OR journal_match) THEN
                CASE WHEN has_authors AND NOT author_match AND author_hits = 0 AND journal_match
                          AND len(list_filter(claimed_authors, lambda t: length(t) >= 4 AND contains(array_to_string(authors, ' '), t))) = 0 THEN 'partial' ELSE 'correct' END
              WHEN author_match AND journal_match THEN 'partial' WHEN title_match THEN 'partial' ELSE 'mismatch' END AS ladder
  FROM cmp
)"""


def pmid_rows() -> str:
    """CTEs up to pmid_rows: the PMID leg by words only."""
    return f"""{synth_sql()}, base AS (
  SELECT c.*, r.title, r.authors, r.journal, r.pubdate, r.volume, r.issue, r.pages, r.doi, r.cited_by_count,
         coalesce(r.valid, false) AS valid, coalesce(r.network_error, false) AS network_error, coalesce(r.retracted, false) AND coalesce(r.valid, false) AS retracted
  FROM claims c LEFT JOIN registry r ON r.pmid = c.id
), {compared('base')}, splice AS (
  SELECT *, valid AND {clean_doi('claimed_doi')} <> '' AND {clean_doi('doi')} <> '' AND {clean_doi('claimed_doi')} <> {clean_doi('doi')} AS doi_splice,
         CASE WHEN checks > 0 THEN CAST(wins AS DOUBLE) / checks ELSE 0 END AS conf
  FROM graded
), routed AS (
  SELECT *, CASE WHEN NOT valid AND network_error THEN 'network_error' WHEN NOT valid THEN 'not_found'
                 WHEN NOT has_title AND NOT has_authors THEN 'existence_only'
                 WHEN ladder = 'mismatch' AND NOT (has_title AND has_authors) AND label NOT IN ('cli', 'claims', 'cli-quick') THEN 'mismatch_gated'
                 WHEN ladder = 'partial' AND title_match AND NOT has_authors AND coalesce(claimed_journal, '') = '' AND coalesce(claimed_year, '') = '' AND label NOT IN ('cli', 'claims') AND NOT explicit THEN 'existence_title_match'
                 ELSE 'metadata' END AS route
  FROM splice
), v1 AS (
  SELECT *, CASE route WHEN 'network_error' THEN 'unknown' WHEN 'not_found' THEN 'invalid' WHEN 'existence_only' THEN 'correct' WHEN 'mismatch_gated' THEN 'unknown' WHEN 'existence_title_match' THEN 'correct' ELSE ladder END AS v1,
         CASE WHEN route IN ('network_error', 'not_found') THEN 0 WHEN route = 'existence_only' THEN 1 WHEN route = 'existence_title_match' THEN greatest(conf, 0.8) ELSE conf END AS conf1
  FROM routed
), pmid_rows AS MATERIALIZED (
  SELECT * EXCLUDE (v1, conf1), CASE WHEN retracted AND v1 IN ('correct', 'partial') THEN 'partial' WHEN doi_splice AND v1 = 'correct' THEN 'partial' ELSE v1 END AS verdict, round_even(conf1, 2) AS confidence
  FROM v1
)"""


def keyword_score(title: str, keywords: str) -> str:
    table = "map([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "], [" + ", ".join(words(v) for v in KEYWORDS.values()) + "])"
    hit = f"contains(lower({title}), lower(k)) OR len(list_filter(coalesce({table}[lower(k)], []), lambda x: contains(lower({title}), x))) > 0"
    return f"CAST(len(list_filter({keywords}, lambda k: {hit})) AS DOUBLE) / len({keywords})"
