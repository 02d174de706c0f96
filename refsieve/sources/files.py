"""Documents and input files: a multi-format reader, claims sheets, baselines, and an optional stream of files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.functions.text import blank_to_null
from refsieve.sources import sheets

#: Extensions that a scan reads; the largest part of an archive; tags that break lines.
EXTENSIONS = ("md", "txt", "html", "htm", "json", "docx", "pptx", "nxml", "jats", "xml")
PART_LIMIT = 64 << 20
BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol blockquote pre td th dt dd figcaption header footer".split())
JATS_BREAKS = frozenset("p sec title article-title ref mixed-citation element-citation abstract caption list-item tr td th break".split())
_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in ("script", "style")
        if tag in BREAKS:
            self.parts.append("\n")
        self.parts += [f" {v} " for k, v in attrs if v and k in ("href", "src", "cite")]

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    """Text with a line per block; links' targets stay, scripts and styles go."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[^\S\n]+", " ", "".join(parser.parts))
    return re.sub(r" ?\n[ \n]*", "\n", text).strip()


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > PART_LIMIT:
            raise ValueError("part too large")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(x for x in lines if x)


def pptx_text(data: bytes) -> str:
    """Slides by number, then notes by number."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for folder, stem in (("slides", "slide"), ("notesSlides", "notesSlide")):
            found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(rf"ppt/{folder}/{stem}(\d+)\.xml", n))]
            for _, name in sorted(found):
                if z.getinfo(name).file_size <= PART_LIMIT:
                    root = ElementTree.fromstring(z.read(name))
                    out += ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in root.iter(f"{_A}p")]
    return "\n".join(x for x in out if x)


def jats_text(data: bytes) -> str:
    root = ElementTree.fromstring(data)
    local = lambda e: str(e.tag).rpartition("}")[2]
    if local(root) not in ("article", "pmc-articleset") and not any(local(e) == "front" for e in root.iter()):
        raise ValueError("not JATS")
    out: list[str] = []
    todo = [("open", root)]  # a stack, as depth is the document's choice
    while todo:
        step, e = todo.pop()
        line = "\n" if local(e) in JATS_BREAKS else ""
        if step == "open":
            out += [line, e.text or "", *(f" {v} " for k, v in e.attrib.items() if k.rpartition("}")[2] == "href")]
            todo.append(("close", e))
            for child in reversed(e):
                todo += [("tail", child), ("open", child)]
        else:
            out.append(line if step == "close" else e.tail or "")
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", "".join(out))).strip()


def decode(path: str, data: bytes) -> tuple[str, str, bool]:
    """(text, format, degraded): structured formats that fail are read as plain text."""
    form = {"docx": "docx", "pptx": "pptx", "html": "html", "htm": "html", "nxml": "jats", "jats": "jats", "xml": "jats"}.get(path.rpartition(".")[2].lower(), "text")
    raw = data.decode("utf-8", "ignore")
    readers = {"docx": docx_text, "pptx": pptx_text, "jats": jats_text, "html": lambda _: html_text(raw)}
    if form == "text":
        return raw, form, False
    try:
        return readers[form](data), form, False
    except (zipfile.BadZipFile, zlib.error, KeyError, ValueError, RuntimeError, EOFError, ElementTree.ParseError):  # encrypted, too deep and unknown packings among them
        return raw, "text", True


def decoded(files: DataFrame) -> DataFrame:
    """(path, basename, format, text, degraded) of (path, content) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, p.rpartition("/")[2], *decode(p, bytes(b or b""))) for p, b in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "basename", "text", "format", "degraded"])

    return files.select("path", "content").mapInPandas(run, "path string, basename string, text string, format string, degraded boolean")


def wanted(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """All documents under a folder, read once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return decoded(files.where(wanted(F.col("path"), extensions)))


def claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """A claims sheet as (input_ord, pmid, doi, arxiv_id, claimed_*); headers in any of their usual spellings.

    ``input_ord`` is the row's first physical line, whatever the partitions.
    """
    _, rows = sheets.claim_sheet(spark, path)
    mark = F.when(F.contains("authors", F.lit(";")), ";").when(F.contains("authors", F.lit("|")), r"\|").otherwise(",")
    names = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), mark), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select(F.col("first_line").alias("input_ord"), "pmid", "doi", "arxiv_id", F.col("title").alias("claimed_title"), F.col("journal").alias("claimed_journal"), F.col("year").alias("claimed_year"), names.alias("claimed_authors"))


def claims_json(spark: SparkSession, path: str) -> DataFrame:
    """A claims array; authors count only if they are a list, items only if they are objects. ``input_ord`` is an item's place."""
    texts = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    items = sheets.claim_items(texts).where(F.col("keys").isNotNull())
    return items.select(F.col("line").alias("input_ord"), "pmid", "doi", "arxiv_id", F.col("title").alias("claimed_title"), F.coalesce("names", F.array().cast("array<string>")).alias("claimed_authors"), F.col("journal").alias("claimed_journal"), F.col("year").alias("claimed_year"))


def work_items(claims: DataFrame, label: str = "claims") -> DataFrame:
    """Claims as work items: a digit PMID first, else an arXiv id, else a DOI; ``kind`` tells which."""
    pmid = F.when(F.col("pmid").rlike(r"^\d+$"), F.col("pmid"))
    kind = F.when(pmid.isNotNull(), "pmid").when(F.col("arxiv_id").isNotNull(), "arxiv").when(F.col("doi").isNotNull(), "doi").otherwise("title")
    return claims.select(F.coalesce(pmid, "arxiv_id", "doi").alias("id"), kind.alias("kind"), F.lit(label).alias("label"), F.lit(True).alias("explicit"), "input_ord", "claimed_title", "claimed_authors", "claimed_journal", "claimed_year", F.col("doi").alias("claimed_doi"))


def literal_ids(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """A comma-separated list of ids; PMIDs that are not digits are left out."""
    rows = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", ",")).alias("input_ord", "id")).withColumn("id", F.trim("id")).where("id <> ''")
    rows = rows.where(F.col("id").rlike(r"^\d+$")) if kind == "pmid" else rows
    return rows.select("id", F.lit(kind).alias("kind"), F.lit("cli").alias("label"), F.lit(True).alias("explicit"), F.col("input_ord").cast("long"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(key, verdict, retracted) of an earlier audit: an object with citations, or a bare list."""
    item = "ARRAY<STRUCT<pmid: STRING, doi: STRING, verdict: STRUCT<final: STRING>, retraction: STRUCT<flagged: BOOLEAN>>>"
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"STRUCT<citations: {item}>")["citations"], F.from_json("value", item))
    rows = text.select(F.explode(listed).alias("x"))
    key = F.coalesce(blank_to_null(F.col("x.pmid")), blank_to_null(F.col("x.doi")))
    return rows.select(key.alias("key"), F.col("x.verdict.final").alias("verdict"), F.coalesce("x.retraction.flagged", F.lit(False)).alias("retracted")).where("key is not null").dropDuplicates(["key"])
