"""Exports: one text or struct per row as column expressions, and writers.

A bibliography is an ordered set of lines, so ``write_lines`` sorts globally and
writes parts in order; nothing is gathered on the driver except by ``report``
functions, which render bounded summaries.
"""

from __future__ import annotations

import json
from html import escape
from pathlib import Path
from typing import TextIO

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refsieve.functions.styles import AUTHOR_DATE, author_list, reference
from refsieve.functions.text import first_year, formula_safe, markdown_safe, single_blanks
from refsieve.operators.durable import written
from refsieve.operators.rollup import by_severity, counters, ledger, readiness, stats

c = F.col


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graded rows, computed and written once, and their counters (``rollup.stats``), observed in the same pass.

    Whatever renders more than one thing of its rows begins here, so that the
    legs run once however many sinks there are.
    """
    seen = Observation()
    made = counters(rows)
    kept = written(rows.observe(seen, *made), "graded")
    names = kept.agg(*made).columns
    return kept, rows.sparkSession.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"`{n}` long" for n in names))


def display(rows: DataFrame) -> DataFrame:
    """``rows`` with authors as text: the first three, and whether there were more."""
    names = c("authors")
    return rows.withColumns({"authors_truncated": F.coalesce(F.size(names) > 3, F.lit(False)), "authors": _text(F.array_join(F.slice(names, 1, 3), ", "))})


def bibliography(rows: DataFrame) -> DataFrame:
    """One row per PMID (the first cited; rows without one all stay) with ``status``: included, partial, retracted or excluded."""
    # Rows without a PMID get keys of their own, so that none is merged and none gathers in one place.
    key = F.coalesce(c("pmid"), F.concat(F.lit("row:"), c("input_ord").cast("string"), F.lit(":"), _text(c("id"))))
    first = F.row_number().over(Window.partitionBy(key).orderBy("input_ord"))
    status = F.when(F.coalesce("retracted", F.lit(False)), "retracted").when(~F.coalesce("valid", F.lit(False)), "excluded").when(c("verdict") == "correct", "included").when(c("verdict") == "partial", "partial").otherwise("excluded")
    return rows.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("status", status)


def export_counts(rows: DataFrame) -> DataFrame:
    """included, partial, excluded (retracted among them), of deduplicated rows."""
    return bibliography(rows).agg(F.count_if(c("status") == "included").alias("included"), F.count_if(c("status") == "partial").alias("partial"), F.count_if(c("status").isin("excluded", "retracted")).alias("excluded"))


def bib_escaped(x: Column) -> Column:
    x = F.trim(F.translate(_text(x), "{}", "()"))
    for mark, made in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("_", "\\_")):
        x = F.replace(x, F.lit(mark), F.lit(made))
    return x


def bib_authors() -> Column:
    """ "Smith J, Doe A" as "Smith, J and Doe, A"; "and others" after a cut list."""
    names = F.filter(F.transform(F.split(_text(c("authors")), ","), lambda a: F.trim(a)), lambda a: a != "")
    turned = F.transform(names, lambda a: F.regexp_replace(a, r"^(.*) (\S*)$", "$1, $2"))
    return F.concat(F.array_join(turned, " and "), F.when(F.coalesce("authors_truncated", F.lit(False)), " and others").otherwise(""))


def bibtex(rows: DataFrame) -> DataFrame:
    """``display`` rows with ``entry``: an @article, commented out if partial; retracted ones a remark; others none."""
    year = F.coalesce(F.nullif(first_year(c("pubdate")), F.lit("")), F.lit("n.d."))
    family = F.coalesce(F.nullif(F.regexp_extract(_text(c("authors")), r"^\s*([^\s,]+)", 1), F.lit("")), F.lit("Anonymous"))
    rows = bibliography(rows).withColumn("__key", F.lower(F.concat(family, year, F.lit("pmid"), _text(c("pmid")))))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("input_ord"))
    rows = rows.withColumn("__nth", nth)
    key = F.concat(c("__key"), F.when(c("__nth") > 1, c("__nth").cast("string")).otherwise(""))
    line = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))
    optional = [line(k, bib_escaped(c(k)), _text(c(k)) != "") for k in ("volume", "pages", "doi")]
    note = F.concat(F.lit("  note = {verified ("), c("verdict"), F.when(c("pmid").isNotNull(), F.concat(F.lit("; PMID "), c("pmid"))).otherwise(""), F.lit(")}"))
    body = F.concat_ws("\n", F.concat(F.lit("@article{"), key, F.lit(",")), line("pmid", _text(c("pmid"))), line("title", bib_escaped(c("title"))), line("author", bib_authors()), line("journal", bib_escaped(c("journal"))), line("year", year), *optional, note, F.lit("}"))
    remark = F.concat(F.lit("% PARTIAL MATCH — verify manually: "), single_blanks(c("details")), F.lit("\n% "), F.replace(body, F.lit("\n"), F.lit("\n% ")))
    entry = F.when(c("status") == "included", body).when(c("status") == "partial", remark).when(c("status") == "retracted", F.concat(F.lit("% EXCLUDED (RETRACTED): PMID "), _text(c("pmid")), F.lit(" — do not cite.")))
    return rows.select("input_ord", "pmid", "status", entry.alias("entry"))


def ris(rows: DataFrame) -> DataFrame:
    """``display`` rows with ``entry``: a JOUR record, DATA if partial."""
    line = lambda tag, value, when=F.lit(True): F.when(when, F.concat(F.lit(f"{tag}  - "), value))
    year, verdict = first_year(c("pubdate")), c("verdict")
    names = F.array_join(F.transform(author_list(), lambda a: F.concat(F.lit("AU  - "), single_blanks(a))), "\n")
    note = F.concat(F.lit("verified ("), verdict, F.when(c("pmid").isNotNull(), F.concat(F.lit("; PMID "), c("pmid"))).otherwise(""), F.lit(")"), F.when(verdict == "partial", F.concat(F.lit("; PARTIAL MATCH — verify manually: "), single_blanks(c("details")))).otherwise(""))
    body = F.concat_ws("\n", line("TY", F.when(verdict == "correct", "JOUR").otherwise("DATA")), line("TI", single_blanks(c("title"))), F.nullif(names, F.lit("")), line("JO", single_blanks(c("journal")), _text(c("journal")) != ""), line("PY", year, year != ""), line("DO", c("doi"), _text(c("doi")) != ""), line("AN", c("pmid"), c("pmid").isNotNull()), line("N1", note), F.lit("ER  - "))
    rows = bibliography(rows)
    return rows.select("input_ord", "pmid", "status", F.when(c("status").isin("included", "partial"), body).when(c("status") == "retracted", F.concat(F.lit("% EXCLUDED (RETRACTED): PMID "), _text(c("pmid")), F.lit(" — do not cite."))).alias("entry"))


def csl_names() -> Column:
    """Authors as (family, given, literal): a short last part is the given name."""

    def one(a: Column) -> Column:
        shaped = a.rlike(r"^.+ [A-Za-z][A-Za-z.]{0,3}$")
        return F.struct(F.when(shaped, F.regexp_extract(a, r"^(.+) (\S+)$", 1)).alias("family"), F.when(shaped, F.regexp_extract(a, r"^(.+) (\S+)$", 2)).alias("given"), F.when(~shaped, a).alias("literal"))

    return F.transform(F.filter(F.transform(F.split(_text(c("authors")), ","), lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != "et al.")), one)


def csl(rows: DataFrame) -> DataFrame:
    """``display`` rows with ``item``, a CSL article-journal as JSON, for included and partial ones."""
    year = F.nullif(first_year(c("pubdate")), F.lit("")).cast("int")
    full = lambda k: F.nullif(_text(c(k)), F.lit(""))
    note = F.concat(F.lit("verified ("), c("verdict"), F.lit(")"), F.when(c("verdict") == "partial", F.concat(F.lit("; PARTIAL MATCH — verify manually: "), F.substring(single_blanks(c("details")), 1, 200))).otherwise(""))
    item = F.struct(
        F.coalesce(F.concat(F.lit("pmid:"), c("pmid")), F.concat(F.lit("doi:"), full("doi")), F.lit("entry")).alias("id"), F.lit("article-journal").alias("type"), single_blanks(c("title")).alias("title"), csl_names().alias("author"), note.alias("note"),
        F.nullif(single_blanks(c("journal")), F.lit("")).alias("container-title"), F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("issued"), full("volume").alias("volume"), full("pages").alias("page"), full("doi").alias("DOI"),
    )
    return bibliography(rows).where(c("status").isin("included", "partial")).select("input_ord", "pmid", "status", F.to_json(item).alias("item"))


def reference_list(rows: DataFrame, style: str) -> DataFrame:
    """(section, n, entry) of ``display`` rows: verified entries numbered, then those to review; retracted ones are left out."""
    rows = bibliography(rows).where(c("status").isin("included", "partial")).withColumn("section", F.when(c("status") == "included", "verified").otherwise("review"))
    name = F.lower(F.coalesce(F.get(author_list(), F.lit(0)), F.lit("")))
    rows = numbered(rows, [name, c("input_ord"), c("pmid")] if style in AUTHOR_DATE else [c("input_ord"), c("pmid")])
    return rows.select("section", "n", "pmid", reference(style, c("n")).alias("entry"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``n``, their place within their section (O3).

    The rows are dealt into ranges of the order itself, by a sample of it, so
    that however they cluster no task gets much more than another. Each range is
    sorted and its rows take numbers from where it starts; a running sum over
    the ranges' sizes, a row for each range and section, does the rest.
    """
    keys = [c("section"), *[c(f"__key{i}") for i in range(len(order))]]
    rows = written(rows.withColumns({f"__key{i}": x for i, x in enumerate(order)}), "entries")
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # A number is its task's, in the upper bits, and its place there.
    at = F.monotonically_increasing_id()
    placed = written(ranged.withColumn("__at", at).withColumn("__range", F.shiftright("__at", 33)), "entries-placed")
    sizes = placed.groupBy("section", "__range").agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
    before = F.sum("__size").over(Window.partitionBy("section").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("section", "__range", (F.coalesce(before, F.lit(0)) - c("__first") + 1).alias("__add"))
    out = placed.join(F.broadcast(offsets), ["section", "__range"]).withColumn("n", c("__at") + c("__add"))
    return out.drop("__at", "__range", "__add", *[f"__key{i}" for i in range(len(order))])


def csv_rows(rows: DataFrame) -> DataFrame:
    """The CSV report's columns of ``display`` rows, each safe in a spreadsheet (K6)."""
    return rows.select("input_ord", *[formula_safe(_text(c(k).cast("string"))).alias(k) for k in ("id", "verdict", "confidence", "title", "authors", "journal", "pubdate", "doi", "claimed_title", "claimed_journal", "claimed_year", "details", "retracted", "label")])


def markdown_rows(rows: DataFrame) -> DataFrame:
    cells = F.array(*[markdown_safe(_text(c(k).cast("string"))) for k in ("id", "verdict", "confidence", "claimed_title", "title", "details")])
    return rows.select("input_ord", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


def html_rows(rows: DataFrame) -> DataFrame:
    """Table rows in order of severity, escaped (K4). A row's classes are its verdict and, where they hold, ``retracted`` and ``splice``."""
    safe = lambda x: F.replace(F.replace(F.replace(F.replace(_text(x.cast("string")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = F.concat(*[F.concat(F.lit("<td>"), safe(c(k)), F.lit("</td>")) for k in ("id", "verdict", "confidence", "claimed_title", "title", "authors", "journal", "pubdate", "doi", "details", "label")])
    flag = lambda column, name: F.when(F.coalesce(c(column), F.lit(False)), name)
    classes = F.concat_ws(" ", c("verdict"), flag("retracted", "retracted"), flag("doi_splice", "splice"))
    return by_severity(rows).select("severity", "input_ord", F.concat(F.lit('<tr class="'), classes, F.lit('">'), cells, F.lit("</tr>")).alias("row"))


def audit_items(rows: DataFrame) -> DataFrame:
    """(input_ord, item): nested audit records as JSON (K7)."""
    fields = F.struct(*[c(f"field_{k}").alias(k) for k in ("title", "author", "journal", "year")])
    item = F.struct(c("id").alias("pmid"), c("label").alias("source_file"), F.struct("claimed_title", "claimed_authors", "claimed_journal", "claimed_year").alias("claimed"), F.struct("title", "authors", "journal", "pubdate", "doi").alias("registered"), fields.alias("evidence"), F.struct(F.coalesce("retracted", F.lit(False)).alias("flagged")).alias("retraction"), F.struct(c("verdict").alias("final"), "details", "confidence").alias("verdict"))
    return rows.select("input_ord", F.to_json(item).alias("item"))


def claims_template(rows: DataFrame) -> DataFrame:
    """Any list as a claims sheet: pmid, doi, arxiv_id, title, authors, journal, year (P20). Authors are kept."""
    have = set(rows.columns)
    col = lambda *names: _text(F.coalesce(*[c(n) for n in names if n in have], F.lit("")))
    authors = F.array_join(c("claimed_authors"), "; ") if "claimed_authors" in have else F.lit("")
    return rows.select(col("pmid").alias("pmid"), col("doi").alias("doi"), col("arxiv_id").alias("arxiv_id"), col("claimed_title").alias("title"), _text(authors).alias("authors"), col("claimed_journal").alias("journal"), col("claimed_year").alias("year"))


def write_lines(lines: DataFrame, text: str, order: list[str], path: str) -> None:
    """Write one text column in global order, in as many parts as there are partitions."""
    lines.where(c(text).isNotNull()).orderBy(*order).select(text).write.mode("overwrite").text(path)


def evidence_pack(rows: DataFrame, path: str) -> None:
    """Eight folders under ``path``: audit, bibtex, ris, csl, csv, references, ledger, summary (K12); the rows are computed once."""
    rows, counts = settled(rows)
    shown = display(rows)
    write_lines(audit_items(rows), "item", ["input_ord"], f"{path}/audit")
    whole = bibtex(shown).select(F.lit(0).alias("part"), "input_ord", "entry").union(bib_total(shown).select(F.lit(1), F.lit(0), "entry"))
    write_lines(whole, "entry", ["part", "input_ord"], f"{path}/bibtex")
    write_lines(ris(shown), "entry", ["input_ord"], f"{path}/ris")
    write_lines(csl(shown), "item", ["input_ord"], f"{path}/csl")
    csv_rows(shown).orderBy("input_ord").write.mode("overwrite").csv(f"{path}/csv", header=True)
    write_lines(reference_list(shown, "gbt"), "entry", ["section", "n"], f"{path}/references")
    ledger(rows).write.mode("overwrite").json(f"{path}/ledger")
    counts.crossJoin(readiness(counts)).write.mode("overwrite").json(f"{path}/summary")


#: Marks of the verdicts and of a field that agrees, differs or was not compared.
ICONS = {"correct": "✅", "mismatch": "⚠️", "partial": "🔶", "invalid": "❌"}
FIELD_MARKS = ("✓", "✗", "—")
#: How many rows of each category of a change report a readable report lists; the counts cover all.
LISTED = {"newly_retracted": 50, "degraded": 20, "improved": 20, "new": 20, "dropped": 20}
#: What a reader of an audit should know of how this engine grades.
HONESTY = (
    "A row is unknown, not invalid, where its registry could not be asked; such answers never enter the cache.",
    "Retractions are those in the registry tables as they were given; a later one shows once its cached record has expired.",
    "Absent records expire sooner than found ones; rollup.fresh holds both ages.",
    "Only retractions are flagged; expressions of concern are not read.",
)


def text_rows(rows: DataFrame) -> DataFrame:
    """(input_ord, line): each row as a person reads it, with evidence by field and suggestions (K1)."""
    have = set(rows.columns)
    icon = F.lit("❓")
    for verdict, mark in ICONS.items():
        icon = F.when(c("verdict") == verdict, mark).otherwise(icon)
    label = F.when(c("kind") == "arxiv", "arXiv ").when((c("kind") == "doi") & (_text(c("pmid")) == ""), "DOI ").otherwise("PMID ") if {"kind", "pmid"} <= have else F.lit("PMID ")
    yes, no, none = FIELD_MARKS
    marks = F.array_join(F.array(*[F.concat(F.lit(f"{k} "), F.when(c(f"field_{k}"), yes).when(~c(f"field_{k}"), no).otherwise(none)) for k in ("title", "author", "journal", "year")]), " · ")
    line = lambda head, x, most=90: F.when(_text(x) != "", F.concat(F.lit(f"\n   {head}: "), F.substring(x, 1, most)))
    known = F.concat_ws("", line("Actual", c("title")), line("Claimed", c("claimed_title")), line("Details", c("details"), 100_000), F.concat(F.lit("\n   Evidence: "), marks))
    if "replacement_pmids" in have:
        known = F.concat_ws("", known, F.concat(F.lit("\n   ♻ same-topic records, no verdicts: "), F.array_join("replacement_pmids", ", ")))
    if "suggested_pmids" in have:
        known = F.concat_ws("", known, F.array_join(F.transform(F.slice("suggested_pmids", 1, 2), lambda s: F.concat(F.lit("\n   → PMID "), s["pmid"], F.lit(" - "), s["title"])), ""))
    body = F.when(F.coalesce("valid", F.lit(False)), known).otherwise(F.concat(F.lit("\n   Error: "), F.coalesce(F.nullif(c("details"), F.lit("")), F.lit("?"))))
    return rows.select("input_ord", F.concat(icon, F.lit(" "), label, _text(c("id")), F.lit(" ("), _text(c("label")), F.lit(") ["), c("verdict"), F.lit("]"), body).alias("line"))


def text_head(counts: DataFrame) -> DataFrame:
    """(at, line): readiness, counts and warnings above the rows of a text report."""
    both = counts.crossJoin(readiness(counts).select("line"))  # one row each
    number = lambda k: c(k).cast("string")
    results = F.concat(F.lit("Results: "), number("correct"), F.lit("/"), number("total"), F.lit(" correct, "), number("mismatch"), F.lit(" mismatch, "), number("invalid"), F.lit(" invalid, "), number("partial"), F.lit(" partial, "), number("unknown"), F.lit(" unknown"))
    warn = lambda k, text: F.when(c(k) > 0, F.concat(F.lit("⚠ "), number(k), F.lit(f" {text}")))
    lines = F.array(F.concat(F.lit("Readiness: "), c("line")), results, warn("unmatched", "relevance warnings"), warn("network_errors", "could not be verified (network); unknown, not invalid"), warn("retracted", "point to retracted papers; capped at partial"), warn("doi_splice", "claim a DOI other than the registered one; capped at partial"))
    return both.select(F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("at", "line"))


def bib_total(rows: DataFrame) -> DataFrame:
    """The remark that ends a BibTeX export: how many entries were kept, commented out and left out."""
    counts = export_counts(rows)
    return counts.select(F.concat(F.lit("% total: "), c("included").cast("string"), F.lit(" included, "), c("partial").cast("string"), F.lit(" partial (commented), "), c("excluded").cast("string"), F.lit(" excluded")).alias("entry"))


def jsonl_lines(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(part, input_ord, line): a JSON object per row, then one with the counters (K3), counted here if they are not given."""
    body = rows.select(F.lit(0).alias("part"), "input_ord", F.to_json(F.struct(*rows.columns)).alias("line"))
    tail = (stats(rows) if counts is None else counts).select(F.struct("*").alias("_stats")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("input_ord"), F.to_json(F.struct("_stats")).alias("line"))
    return body.union(tail)


def delta_lines(changes: DataFrame) -> DataFrame:
    """(at, n, line): a change report's counts, then the first rows of each category by key (K5)."""
    sizes = changes.groupBy("category").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))  # five categories at most
    counts = F.array_join(F.array(*[F.concat(F.lit(f"{k.replace('_', ' ')}: "), F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("string")) for k in LISTED]), " · ")
    head = whole.select(F.lit(0).alias("at"), F.lit(0).alias("n"), counts.alias("line"))
    most, place, mark = F.lit(0), F.lit(0), F.lit("")
    for i, ((name, limit), sign) in enumerate(zip(LISTED.items(), "⚠↓↑+−", strict=True), 1):
        most, place, mark = (F.when(c("category") == name, F.lit(x)).otherwise(y) for x, y in ((limit, most), (i, place), (sign, mark)))
    rows = changes.withColumns({"n": F.row_number().over(Window.partitionBy("category").orderBy("key")), "at": place}).where(c("n") <= most)
    moved = F.when(c("category").isin("degraded", "improved"), F.concat(F.lit(": "), c("was"), F.lit(" → "), c("now"))).otherwise("")
    return head.union(rows.select("at", "n", F.concat(F.lit("- "), mark, F.lit(" "), markdown_safe(c("key")), moved)))


def audit_document(counts: DataFrame, options: dict, changes: DataFrame | None = None) -> dict:
    """All of an audit but its citations, from its counters: tool, options, summary, changes and what the reader should know (K7)."""
    made = {"tool": {"name": "refsieve", "options": options}, "summary": counts.first().asDict(), "readiness": readiness(counts).first().asDict(), "honesty_notes": list(HONESTY)}
    made["delta_vs_baseline"] = None if changes is None else {r["category"]: r["n"] for r in changes.groupBy("category").agg(F.count("*").alias("n")).collect()}
    return made


_SHOWN = ("", "correct", "mismatch", "partial", "invalid", "unknown", "retracted", "splice")
_FILTERS = "<p>" + " ".join(f"""<button onclick="pick('{name}')">{name or "all"}</button>""" for name in _SHOWN) + """</p>
<script>function pick(v){document.querySelectorAll('tr').forEach(function(r){r.hidden=v!==''&&!r.classList.contains(v)})}</script>
"""


def _write_items(out: TextIO, whole: dict, name: str, items: DataFrame) -> None:
    """``whole`` as a JSON object with one more member: the items, streamed in input order."""
    out.write(f'{json.dumps(whole, ensure_ascii=False)[:-1]}, "{name}": [')
    for i, r in enumerate(items.orderBy("input_ord").toLocalIterator()):
        out.write((", " if i else "") + r["item"])
    out.write("]}\n")


def audit_report(rows: DataFrame, path: str, options: dict, changes: DataFrame | None = None) -> None:
    """The whole audit as one JSON file, from which it can be followed (K7)."""
    rows, counts = settled(rows)
    with open(path, "w", encoding="utf-8") as out:
        _write_items(out, audit_document(counts, options, changes), "citations", audit_items(rows))


def report(rows: DataFrame, path: str, changes: DataFrame | None = None) -> None:
    """A report by the path's extension: .json, .jsonl (a folder), .md, .html, .csv or .txt; anything else is refused (K0).

    ``changes`` are the rows of ``rollup.delta`` against an earlier run. The
    single-file forms are for reports that a person reads, so their rows are
    streamed to the file, not collected.
    """
    form = Path(path).suffix.lower()
    if form not in (".json", ".jsonl", ".md", ".html", ".csv", ".txt"):
        raise ValueError(f"no report form for {form or path!r}")
    rows, counts = settled(rows)
    if form == ".jsonl":
        write_lines(jsonl_lines(rows, counts), "line", ["part", "input_ord"], path)
        return
    shown = display(rows)
    told = [] if changes is None else [r["line"] for r in delta_lines(changes).orderBy("at", "n").toLocalIterator()]
    with open(path, "w", encoding="utf-8-sig" if form == ".csv" else "utf-8") as out:
        if form == ".json":
            _write_items(out, {"stats": counts.first().asDict()}, "results", audit_items(rows))
        elif form == ".md":
            out.write("| id | verdict | confidence | claimed | registered | details |\n|---|---|---|---|---|---|\n")
            out.writelines(r["line"] + "\n" for r in markdown_rows(shown).orderBy("input_ord").toLocalIterator())
            out.writelines(["\n## Delta vs baseline\n", *(f"{line}\n" for line in told)] if told else [])
        elif form == ".html":
            out.write(f"<!DOCTYPE html><meta charset=utf-8>\n{_FILTERS}<table>\n")
            out.writelines(r["row"] + "\n" for r in html_rows(shown).toLocalIterator())
            out.write("</table>\n")
            out.writelines(["<section><h2>Delta vs baseline</h2>\n", *(f"<p>{escape(line)}</p>\n" for line in told), "</section>\n"] if told else [])
        elif form == ".txt":
            out.writelines(r["line"] + "\n" for r in text_head(counts).orderBy("at").toLocalIterator())
            out.writelines(line + "\n" for line in told)
            out.writelines(r["line"] + "\n" for r in text_rows(rows).orderBy("input_ord").toLocalIterator())
        else:
            frame = csv_rows(shown).orderBy("input_ord")
            out.write(",".join(frame.columns) + "\n")
            for r in frame.toLocalIterator():
                out.write(",".join('"' + str(v).replace('"', '""') + '"' for v in r) + "\n")
