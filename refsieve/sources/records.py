"""Registry records from vendors' stored answers: JSON and Atom bodies in a column, decoded by Spark's own functions.

A body that is no answer (not JSON, or without the part that holds results) is a
network error for all ids asked for, never a "not found"; an id that a whole
answer lacks is not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.functions.text import blank_to_null, clean_doi, pubtype_retracted, registered_doi, single_blanks, strip_tags

c = F.col
_NAMES = "ARRAY<STRUCT<name: STRING>>"
SUMMARY = f"STRUCT<title: STRING, authors: {_NAMES}, source: STRING, pubdate: STRING, volume: STRING, issue: STRING, pages: STRING, pubtype: ARRAY<STRING>, articleids: ARRAY<STRUCT<idtype: STRING, value: STRING>>, elocationid: STRING, error: STRING>"
EUROPE = "STRUCT<id: STRING, title: STRING, authorString: STRING, journalTitle: STRING, pubYear: STRING, journalVolume: STRING, issue: STRING, pageInfo: STRING, doi: STRING, citedByCount: STRING, citedCount: STRING, pubType: STRING>"
_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<STRING>>, `date-time`: STRING>"
CROSSREF = f"STRUCT<title: ARRAY<STRING>, author: ARRAY<STRUCT<family: STRING, given: STRING>>, `container-title`: ARRAY<STRING>, `published-print`: {_DATE}, `published-online`: {_DATE}, created: {_DATE}, `updated-by`: ARRAY<STRUCT<DOI: STRING, type: STRING, `update-type`: STRING, updated: {_DATE}>>, abstract: STRING>"
OPENALEX = "STRUCT<id: STRING, doi: STRING, display_name: STRING, publication_year: STRING, is_retracted: BOOLEAN, cited_by_count: INT, authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, primary_location: STRUCT<source: STRUCT<display_name: STRING>>>"


def _record(source: str, found: Column, lost: Column, down: Column, **fields: Column) -> list[Column]:
    """The columns of a registry row: values only where the record was found."""
    kept = [F.when(found, v).alias(k) for k, v in fields.items()]
    return [*kept, found.alias("valid"), down.alias("network_error"), F.when(lost | found, source).alias("source")]


def ncbi_summaries(answers: DataFrame) -> DataFrame:
    """Registry rows of (pmids array, body): one per PMID asked for."""
    held = F.from_json(F.get_json_object("body", "$.result"), "MAP<STRING, STRING>")
    rows = answers.withColumn("__held", held).select("__held", F.explode("pmids").alias("pmid"))
    rows = rows.select("pmid", c("__held").isNull().alias("__down"), F.from_json(F.try_element_at("__held", c("pmid")), SUMMARY).alias("x"))
    found = ~c("__down") & c("x").isNotNull() & c("x.error").isNull()
    doi = registered_doi(c("x.articleids"), c("x.elocationid"))
    retracted = pubtype_retracted(F.transform("x.pubtype", lambda t: single_blanks(t)))
    columns = _record("ncbi", found, ~c("__down"), c("__down"), title=c("x.title"), authors=F.transform("x.authors", lambda a: a["name"]), journal=c("x.source"), pubdate=c("x.pubdate"), volume=c("x.volume"), issue=c("x.issue"), pages=c("x.pages"), doi=doi, retracted=retracted, retraction_note=F.when(retracted, "publication type: Retracted Publication"))
    return rows.select("pmid", *columns)


def europe_pmc(answers: DataFrame) -> DataFrame:
    """Registry rows of (pmids array, body) of the second source."""
    held = F.from_json("body", f"STRUCT<resultList: STRUCT<result: ARRAY<{EUROPE}>>>")["resultList"]
    rows = answers.withColumn("__list", held).select("__list", F.explode("pmids").alias("pmid"))
    mine = F.try_element_at(F.filter("__list.result", lambda x: F.trim(x["id"]) == c("pmid")), F.lit(-1))
    rows = rows.select("pmid", c("__list").isNull().alias("__down"), mine.alias("x"))
    found = c("x").isNotNull()
    names = F.filter(F.transform(F.split(F.coalesce("x.authorString", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    retracted = F.contains(F.lower(F.coalesce("x.pubType", F.lit(""))), F.lit("retracted publication"))
    cited = F.coalesce("x.citedByCount", "x.citedCount")
    columns = _record("europepmc", found, ~c("__down"), c("__down"), title=c("x.title"), authors=names, journal=c("x.journalTitle"), pubdate=c("x.pubYear"), volume=c("x.journalVolume"), issue=c("x.issue"), pages=c("x.pageInfo"), doi=F.coalesce("x.doi", F.lit("")), retracted=retracted, retraction_note=F.when(retracted, "publication type: retracted publication"), cited_by_count=F.when(cited.rlike(r"^\d+$"), cited.cast("int")))
    return rows.select("pmid", *columns)


def crossref_works(answers: DataFrame) -> DataFrame:
    """DOI records of (doi, http_status, body): 404 is not found, anything else that is no answer an error."""
    rows = answers.withColumn("x", F.from_json(F.get_json_object("body", "$.message"), CROSSREF))
    resolved = (c("http_status") == 200) & c("x").isNotNull()
    withdrawn = F.filter("x.updated-by", lambda u: F.lower(F.coalesce(u["type"], u["update-type"], F.lit(""))).isin("retraction", "removal"))
    rows = rows.withColumns({"__ok": F.coalesce(resolved, F.lit(False)), "__u": F.try_element_at(withdrawn, F.lit(1))})
    kind = F.lower(F.coalesce("__u.type", "__u.update-type"))
    parts = F.coalesce(*[c(f"x.{k}.date-parts") for k in ("published-print", "published-online", "created")])
    first = lambda name: F.coalesce(F.get(c(f"x.{name}"), F.lit(0)), F.lit(""))
    note = F.concat(F.when(kind == "removal", "removed").otherwise("retracted"), F.lit(" by DOI "), F.coalesce("__u.DOI", F.lit("?")))
    made = {"title": first("title"), "journal": first("container-title"), "year": F.coalesce(F.get(F.get(parts, F.lit(0)), F.lit(0)), F.lit("")), "authors": F.transform("x.author", lambda a: F.trim(F.concat(F.coalesce(a["family"], F.lit("")), F.lit(" "), F.coalesce(a["given"], F.lit(""))))), "retracted": c("__u").isNotNull(), "retraction_type": kind, "retraction_note": F.when(c("__u").isNotNull(), note), "notice_doi": F.trim("__u.DOI"), "abstract": strip_tags(F.coalesce("x.abstract", F.lit("")))}
    status = F.when(c("__ok"), "resolved").when(c("http_status") == 404, "not_found").otherwise("error")
    return rows.select(clean_doi(c("doi")).alias("doi"), status.alias("status"), *[F.when(c("__ok"), v).alias(k) for k, v in made.items()])


def openalex_works(answers: DataFrame) -> DataFrame:
    """Works of (key, body), a list of results or one work: the fallback by DOI and the title search."""
    listed = F.from_json("body", f"STRUCT<results: ARRAY<{OPENALEX}>>")["results"]
    one = F.from_json("body", OPENALEX)
    rows = answers.select("key", F.explode(F.when(listed.isNotNull(), listed).when(one["id"].isNotNull() | one["display_name"].isNotNull(), F.array(one))).alias("x"))
    names = F.filter(F.transform("x.authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return rows.select("key", c("x.id").alias("work_id"), F.trim("x.display_name").alias("title"), names.alias("authors"), c("x.primary_location.source.display_name").alias("journal"), c("x.publication_year").alias("year"), clean_doi(c("x.doi")).alias("doi"), F.coalesce("x.is_retracted", F.lit(False)).alias("retracted"), c("x.cited_by_count").alias("cited_by_count"))


def arxiv_feed(answers: DataFrame) -> DataFrame:
    """arXiv records of (arxiv_id, body): no feed is no answer, a feed without entries is not found, an error entry an error."""
    feed = '/*[local-name()="feed"]'
    entry = f'{feed}/*[local-name()="entry"][1]'
    get = lambda path: F.xpath_string("body", F.lit(path))
    # Only a body that looks like a feed reaches the XML reader, which refuses all else.
    is_feed = F.coalesce(c("body").rlike(r"^\s*(<\?xml[^>]*>\s*)?<feed[\s>]") & c("body").rlike(r"</feed>\s*$"), F.lit(False))
    rows = answers.withColumn("body", F.when(is_feed, c("body")))
    title, year = single_blanks(get(f'{entry}/*[local-name()="title"]')), F.substring(get(f'{entry}/*[local-name()="published"]'), 1, 4)
    rows = rows.select("arxiv_id", c("body").isNotNull().alias("__feed"), F.xpath_int("body", F.lit(f'count({feed}/*[local-name()="entry"])')).alias("__n"), title.alias("title"), year.alias("year"), F.transform(F.xpath("body", F.lit(f'{entry}/*[local-name()="author"]/*[local-name()="name"]/text()')), lambda a: single_blanks(a)).alias("authors"), blank_to_null(get(f'{entry}/*[local-name()="doi"]')).alias("registered_doi"), blank_to_null(F.substring(single_blanks(get(f'{entry}/*[local-name()="journal_ref"]')), 1, 120)).alias("journal_ref"))
    answered = (c("title") != "") & (F.lower("title") != "error") & (c("year") != "")
    status = F.when(~c("__feed"), "error").when(c("__n") == 0, "not_found").when(answered, "found").otherwise("error")
    found = status == "found"
    return rows.select("arxiv_id", status.alias("status"), *[F.when(found, c(k)).alias(k) for k in ("title", "year", "authors", "registered_doi", "journal_ref")])
