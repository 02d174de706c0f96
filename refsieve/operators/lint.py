"""Offline checks of claims sheets and bibliography entries, and their roll-up by severity.

Issues are rows (line, tag, severity, message). Rules are columns of one pass;
a repeated key is found by joining each row with the first line of its key, so a
key that a third of all rows share is aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.functions.text import arxiv_valid, clean_doi
from refsieve.sources import sheets

#: Columns that a claims sheet may have, lower-cased, and those that hold an id.
KNOWN_COLUMNS = ("pmid", "arxiv_id", "arxiv", "doi", "title", "authors", "author", "journal", "year")
ID_COLUMNS = ("pmid", "arxiv_id", "arxiv", "doi")
c = F.col


def _text(name: str) -> Column:
    return F.trim(F.coalesce(c(name), F.lit("")))


def with_first(rows: DataFrame, key: str = "__key", order: str = "line", of: list[str] | None = None) -> DataFrame:
    """``rows`` with ``__first``, the first line that has the same key (and the same ``of`` columns); rows without a key have none."""
    first = rows.where(c(key).isNotNull()).groupBy(*(of or []), key).agg(F.min(order).alias("__first"))
    return rows.join(first, [*(of or []), key], "left")


def _file(rows: DataFrame) -> list[str]:
    return ["path"] if "path" in rows.columns else []


def _issues(rows: DataFrame, order: list[str], rules: list[tuple[Column, str, str | Column, Column]]) -> DataFrame:
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(tag).alias("tag"), (F.lit(level) if isinstance(level, str) else level).alias("severity"), text.alias("message"))) for when, tag, level, text in rules])
    return rows.select(*order, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(*order, "i.*")


def header(names: list[str]) -> list[tuple[str, str, str]]:
    """(tag, severity, message) of a sheet's column names."""
    have = [n.strip().lower() for n in names]
    unknown = [n for n in names if n.strip().lower() not in KNOWN_COLUMNS]
    found = [("unknown_column", "WARN", f"unknown columns {unknown}")] if unknown else []
    return found if any(n in have for n in ID_COLUMNS) else [*found, ("no_id_column", "ERROR", "none of pmid, arxiv_id and doi")]


def sheet(rows: DataFrame) -> DataFrame:
    """Issues of a sheet's rows (line, pmid, doi, arxiv_id, title; others count only for blankness). A row without an id has that issue only; a blank one an INFO.

    With a ``path``, keys repeat within a file. With ``closed``, a record whose
    quote nothing closes has that issue too.
    """
    of = _file(rows)
    pmid, doi, arxiv = _text("pmid"), _text("doi"), _text("arxiv_id")
    rows = rows.withColumn("__blank", F.concat_ws("", *[F.trim(F.coalesce(c(n).cast("string"), F.lit(""))) for n in rows.columns if n not in ("line", "first_line", "path", "closed")]) == "")
    rows = rows.withColumns({"__closed": c("closed") if "closed" in rows.columns else F.lit(True), "__digits": pmid.rlike(r"^\d+$"), "__doi": clean_doi(doi), "__none": ~c("__blank") & (pmid == "") & (doi == "") & (arxiv == "")})
    key = F.when(c("__digits"), F.concat(F.lit("pmid "), pmid)).when(arxiv != "", F.concat(F.lit("arxiv "), F.lower(arxiv))).when(doi != "", F.concat(F.lit("doi "), F.coalesce(F.nullif(c("__doi"), F.lit("")), F.lower(doi))))
    rows = with_first(rows.withColumn("__key", key), of=of)
    usable = ~c("__blank") & ~c("__none")
    rules = [
        (~c("__closed"), "unclosed_quote", "ERROR", F.lit("a quote is not closed; the rest of the file belongs to this row")),
        (c("__blank"), "blank_row", "INFO", F.lit("blank row skipped")),
        (c("__none"), "missing_id", "ERROR", F.lit("no pmid, arxiv_id or doi")),
        (usable & (pmid != "") & ~c("__digits"), "pmid_not_digits", "ERROR", F.concat(F.lit("pmid "), pmid)),
        (usable & (arxiv != "") & ~arxiv_valid(arxiv), "arxiv_shape", "ERROR", F.concat(F.lit("arxiv_id "), arxiv)),
        (usable & (doi != "") & ~F.startswith(c("__doi"), F.lit("10.")), "doi_prefix", "ERROR", F.concat(F.lit("doi "), doi)),
        (usable & (_text("title") == ""), "no_title", "WARN", F.lit("verdict caps at partial")),
        (usable & (c("line") > c("__first")), "duplicate_key", "WARN", F.concat(F.lit("same "), c("__key"), F.lit(" as line "), c("__first").cast("string"))),
    ]
    return _issues(rows, [*of, "line"], rules)


def claims(rows: DataFrame) -> DataFrame:
    """Issues of a claims array's items (line, pmid, doi, arxiv_id, title, authors as JSON text, keys).

    ``keys`` are the item's own names; an item that is no object has null keys.
    An item without an id has no issues but that and unknown keys. A PMID of
    other than digits is an error only if there is no other id. With a ``path``,
    keys repeat within a file; with ``root`` (``sheets.claim_items``), a text
    that is no array has that issue.
    """
    of = _file(rows)
    pmid, doi, arxiv = _text("pmid"), _text("doi"), _text("arxiv_id")
    digits = pmid.rlike(r"^\d+$")
    key = F.coalesce(*[F.when(when, F.concat(F.lit(f"{n} "), F.lower(x))) for n, when, x in (("pmid", digits, pmid), ("arxiv", arxiv != "", arxiv), ("doi", doi != "", F.coalesce(F.nullif(clean_doi(doi), F.lit("")), doi)))])
    rows = rows if "root" in rows.columns else rows.withColumn("root", F.lit("array"))
    rows = with_first(rows.withColumn("__key", key), of=of)
    unknown = F.array_except("keys", F.array(*map(F.lit, KNOWN_COLUMNS)))
    listed, item = c("root") == "array", c("keys").isNotNull()
    none = (pmid == "") & (doi == "") & (arxiv == "")
    usable = item & ~none
    rules = [
        (c("root") == "unreadable", "unreadable", "ERROR", F.lit("not readable as JSON")),
        (c("root") == "not_an_array", "not_an_array", "ERROR", F.lit("claims must be an array of objects")),
        (listed & ~item, "not_an_object", "ERROR", F.lit("item is not an object")),
        (item & (F.size(unknown) > 0), "unknown_key", "WARN", F.concat(F.lit("unknown keys "), F.array_join(F.array_sort(unknown), ", "))),
        (item & none, "missing_id", "ERROR", F.lit("no pmid, arxiv_id or doi")),
        (usable & (pmid != "") & ~digits, "pmid_not_digits", F.when((doi == "") & (arxiv == ""), "ERROR").otherwise("WARN"), F.concat(F.lit("pmid "), pmid)),
        (usable & (arxiv != "") & ~arxiv_valid(arxiv), "arxiv_shape", "ERROR", F.concat(F.lit("arxiv_id "), arxiv)),
        (usable & (doi != "") & ~F.startswith(clean_doi(doi), F.lit("10.")), "doi_prefix", "ERROR", F.concat(F.lit("doi "), doi)),
        (usable & (_text("title") == ""), "no_title", "WARN", F.lit("verdict caps at partial")),
        (usable & (_text("authors") != "") & ~F.startswith(_text("authors"), F.lit("[")), "authors_type", "WARN", F.lit("authors should be a list")),
        (usable & (c("line") > c("__first")), "duplicate_key", "WARN", F.concat(F.lit("same "), c("__key"), F.lit(" as item "), c("__first").cast("string"))),
    ]
    return _issues(rows, [*of, "line"], rules)


def file(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, tag, severity, message): issues of claims files as they are, by extension: .json arrays, else sheets.

    A sheet's line is the last physical line of the row; what concerns its header has line 1.
    """
    if path.lower().endswith(".json"):
        texts = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("path"), c("value").alias("text"))
        return claims(sheets.claim_items(texts))
    names, rows = sheets.claim_sheet(spark, path)
    top = [(path, 1, *issue) for issue in header(names)]
    return spark.createDataFrame(top, "path string, line long, tag string, severity string, message string").unionByName(sheet(rows))


def one_word(x: Column) -> Column:
    """User data in a tag: no colon, so that none can stand for a severity; single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit(":"), F.lit("_")), r"\s+", " "))


def entries(rows: DataFrame) -> DataFrame:
    """Issues of routed BibTeX or RIS entries (line, citekey, entry_type, fields, route, id, issue)."""
    title = F.coalesce(F.try_element_at("fields", F.lit("title")), F.try_element_at("fields", F.lit("ti")), F.lit(""))
    rows = with_first(rows.withColumn("__key", F.when(c("route") != "none", F.concat(c("route"), F.lit(" "), c("id")))))
    name = F.concat(F.lit("@"), one_word(c("entry_type")), F.lit(" "), one_word(c("citekey")))
    whole = c("issue").isNull() | c("citekey").isNotNull()
    rules = [
        (c("issue").isNotNull(), "syntax", "ERROR", c("issue")),
        (whole & (c("route") == "none"), "unroutable", "ERROR", F.concat(name, F.lit(" has no pmid, doi or arXiv id"))),
        (whole & (c("line") > c("__first")), "duplicate_key", "WARN", F.concat(name, F.lit(" same "), c("__key"))),
        (whole & (title == ""), "no_title", "WARN", F.concat(name, F.when(c("route").isin("doi", "none"), " stays unknown").otherwise(" caps at partial"))),
    ]
    return _issues(rows, ["line"], rules)


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def outcome(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos and exit_code, 1 if there is an error."""
    count = lambda level: F.count_if(c("severity") == level)
    return issues.agg(count("ERROR").alias("errors"), count("WARN").alias("warnings"), count("INFO").alias("infos")).withColumn("exit_code", F.when(c("errors") > 0, 1).otherwise(0))
