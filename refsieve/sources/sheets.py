"""Claims files as they are: quoted sheets whose cells break lines, and JSON arrays whose items have any shape.

A sheet is read as lines, by as many tasks as it has blocks. Whether a line
begins a record depends on the quotes before it; blocks are summed up under
both answers and a running sum over a file's blocks tells which one holds, so no
task reads more than its block. Quotes are taken to enclose cells and to be
doubled inside them. Lines may end in LF, CRLF or CR; inside a cell each becomes
one LF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
#: The fields of a claim and the names that a sheet's column may have for each, lower-cased.
ALIASES = {"pmid": ("pmid",), "doi": ("doi",), "arxiv_id": ("arxiv_id", "arxiv"), "title": ("title",), "authors": ("authors", "author"), "journal": ("journal",), "year": ("year",)}
_BLOCK = ("path", "block")


def _stripped(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, text): the lines of the files at ``path``; ``at`` orders those of one block."""
    return spark.read.text(path).select(c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), c("value").alias("text"))


def records(raw: DataFrame) -> DataFrame:
    """(path, first_line, line, text, closed): the records of lines (path, block, at, text), each with its first and last line from 1.

    A quote that nothing closes makes the rest of a file one record; of that one
    only the first line is kept and ``closed`` is false, so that no group grows
    with a file. A null line is an empty one; empty input has no records.
    """
    within = Window.partitionBy(*_BLOCK).orderBy("at")
    text = F.coalesce(c("text"), F.lit(""))
    rows = raw.select(*_BLOCK, "at", text.alias("text"), (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))).cast("long").alias("quotes"))
    rows = rows.withColumns({"nth": F.row_number().over(within).cast("long"), "seen": F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    odd = c("seen") % 2
    blocks = rows.groupBy(*_BLOCK).agg(F.count("*").alias("n"), F.sum("quotes").alias("q"), F.max(F.when(odd == 0, c("nth"))).alias("last_if_even"), F.max(F.when(odd == 1, c("nth"))).alias("last_if_odd"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("path")
    blocks = blocks.withColumns({"lines_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "quotes_before": F.coalesce(F.sum("q").over(before), F.lit(0)), "all_quotes": F.sum("q").over(total)})
    last = F.when(c("quotes_before") % 2 == 0, c("last_if_even")).otherwise(c("last_if_odd")) + c("lines_before")
    blocks = blocks.withColumn("last", last)
    blocks = blocks.select(*_BLOCK, "lines_before", "quotes_before", F.last("last", ignorenulls=True).over(before).alias("open_from"), F.when(c("all_quotes") % 2 == 1, F.max("last").over(total)).alias("unclosed"))
    rows = rows.join(blocks, list(_BLOCK)).withColumn("line", c("nth") + c("lines_before"))
    begins = F.when((c("seen") + c("quotes_before")) % 2 == 0, c("line"))
    rows = rows.withColumn("first_line", F.coalesce(F.max(begins).over(within.rowsBetween(Window.unboundedPreceding, 0)), c("open_from")))
    rows = rows.withColumn("closed", ~F.coalesce(c("first_line") == c("unclosed"), F.lit(False))).where(c("closed") | (c("line") == c("first_line")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return rows.groupBy("path", "first_line").agg(F.max("line").alias("line"), F.array_join(parts, "\n").alias("text"), F.bool_and("closed").alias("closed"))


def cells(text: Column, n: int) -> Column:
    """The first ``n`` cells of a record as an array; a short record has nulls at its end."""
    names = [f"c{i}" for i in range(n)]
    row = F.from_csv(text, ", ".join(f"{x} string" for x in names), {"quote": '"', "escape": '"', "lineSep": "\u001e", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return F.array(*[row[x] for x in names])


def column_names(found: DataFrame) -> list[str]:
    """The names in a sheet's first line (of several files: of the first by name), trimmed, without a byte order mark."""
    first = found.where("first_line = 1").orderBy("path").select("text").take(1)
    if not first:
        return []
    head = found.sparkSession.createDataFrame([(first[0]["text"].lstrip("﻿"),)], "text string")
    wide = first[0]["text"].count(",") + 1
    return [x.strip() for x in head.select(cells(c("text"), wide).alias("x")).first()["x"] if x is not None]


def fields(found: DataFrame, names: list[str]) -> DataFrame:
    """(path, line, first_line, closed, the claim's fields, other): records below a header of such names, which is the record of line 1; empty lines are left out.

    A field is the first non-blank cell under any of its names; ``other`` joins
    what stands under further names.
    """
    rows = found.where((c("first_line") > 1) & (c("text") != "")).withColumn("cell", cells(c("text"), max(len(names), 1)))
    under = lambda wanted: [_stripped(c("cell")[i]) for i, name in enumerate(names) if wanted(name.lower())]
    none = F.lit(None).cast("string")
    known = {name for alias in ALIASES.values() for name in alias}
    picked = {field: F.coalesce(*under(lambda name, alias=alias: name in alias), none).alias(field) for field, alias in ALIASES.items()}
    other = F.concat_ws(" ", *under(lambda name: name not in known))
    return rows.select("path", "line", "first_line", "closed", *picked.values(), other.alias("other"))


def claim_sheet(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The column names of a claims sheet and its rows (``fields``)."""
    found = records(lines(spark, path))
    names = column_names(found)
    return names, fields(found, names)


def claim_items(texts: DataFrame) -> DataFrame:
    """(path, line, root, pmid, doi, arxiv_id, title, authors, journal, year, keys, names) of JSON texts (path, text).

    ``line`` is an item's place from 1. ``authors`` is JSON text, ``names`` the
    list of authors if it is one, ``keys`` the item's own keys, null if it is no
    object. A text that is no array has one row, of line 0, whose ``root`` says
    ``unreadable`` (no JSON, null, or an object that repeats a key) or
    ``not_an_array``; an empty array has none. One text is one row of Spark, so
    it is bounded by what a row can hold.
    """
    parsed = texts.select("path", F.try_parse_json("text").alias("v"))
    is_array = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    root = F.when(c("v").isNull(), "unreadable").when(is_array, "array").otherwise("not_an_array")
    parsed = parsed.withColumn("root", root)
    items = parsed.where("root = 'array'").lateralJoin(texts.sparkSession.tvf.variant_explode(c("v").outer()))
    items = items.select("path", "root", (c("pos") + 1).cast("long").alias("line"), c("value").alias("item"))
    text = lambda key: _stripped(F.try_variant_get("item", f"$.{key}", "string")).alias(key)
    authors = F.try_variant_get("item", "$.authors", "variant")
    found = items.select(
        "path", "line", "root", *[text(k) for k in ("pmid", "doi", "arxiv_id", "title")],
        F.when(~F.is_variant_null(authors), F.to_json(authors)).alias("authors"), text("journal"), text("year"),
        F.json_object_keys(F.to_json("item")).alias("keys"), F.try_variant_get("item", "$.authors", "array<string>").alias("names"),
    )
    return found.unionByName(parsed.where("root <> 'array'").select("path", F.lit(0).cast("long").alias("line"), "root"), allowMissingColumns=True)
