"""Claims files as they are: physical lines of quoted sheets, items of any shape."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from refsieve.operators import lint
from refsieve.sources import files, sheets


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_over_blocks_are_those_of_csv(small_blocks, tmp_path):
    spark, draw = small_blocks, random.Random(3)
    out = io.StringIO()
    sheet = csv.writer(out, lineterminator="\n")
    sheet.writerow(["pmid", "title", "note"])
    for n in range(300):
        sheet.writerow([n, draw.choice(["plain", 'a "b"', "x\ny", "\n\n", "long " * 60, "é\n文", ""]), draw.choice(["", "z\n" * draw.randint(1, 9), "q,r"])])
    (tmp_path / "s.csv").write_text("﻿" + out.getvalue(), encoding="utf-8")
    reader = csv.reader(io.StringIO(out.getvalue()))
    want = [(reader.line_num, *row) for row in reader][1:]
    raw = sheets.lines(spark, str(tmp_path / "s.csv"))
    assert raw.select("block").distinct().count() > 20
    got = sheets.records(raw).where("first_line > 1").orderBy("line").select("line", sheets.cells(F.col("text"), 3).alias("x")).collect()
    assert [(r["line"], *[v or "" for v in r["x"]]) for r in got] == want
    names, rows = sheets.claim_sheet(spark, str(tmp_path / "s.csv"))
    assert names == ["pmid", "title", "note"] and rows.count() == 300
    orders = [r["input_ord"] for r in files.claims_csv(spark, str(tmp_path / "s.csv")).orderBy(F.col("pmid").cast("int")).collect()]
    assert orders == sorted(orders) and len(set(orders)) == 300


def test_sheet_issues_have_physical_lines(small_blocks, tmp_path):
    (tmp_path / "s.csv").write_text('PMID,Title,typo,title\n1,"A\nb",,\n\n,,,\n1,,,"second\nname"\nx,t,,\n,only title,,\n"7\n",t,,\n8,"open\n9,t,,\n')
    got = {(r["line"], r["tag"]) for r in lint.file(small_blocks, str(tmp_path / "s.csv")).collect()}
    assert got == {(1, "unknown_column"), (5, "blank_row"), (7, "duplicate_key"), (8, "pmid_not_digits"), (9, "missing_id"), (12, "unclosed_quote")}


def test_empty_sheets(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("pmid,title\n")
    assert [r["tag"] for r in lint.file(spark, str(tmp_path / "none.csv")).collect()] == ["no_id_column"]
    assert lint.file(spark, str(tmp_path / "head.csv")).count() == 0 and files.claims_csv(spark, str(tmp_path / "head.csv")).count() == 0


def test_array_issues(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"pmid": 12, "titel": "x", "authors": "S"}, 5, null, {"doi": "10.1/x", "pmid": "p", "authors": ["a", 1], "title": ""}, {"title": "t"}, {"pmid": "12", "title": "t"}, {"pmid": "z", "title": "t"}]')
    got = {(r["line"], r["tag"], r["severity"]) for r in lint.file(spark, str(tmp_path / "a.json")).collect()}
    warned = {(1, "unknown_key"), (1, "no_title"), (1, "authors_type"), (4, "pmid_not_digits"), (4, "no_title"), (6, "duplicate_key")}
    assert got == {(*x, "WARN") for x in warned} | {(2, "not_an_object", "ERROR"), (3, "not_an_object", "ERROR"), (5, "missing_id", "ERROR"), (7, "pmid_not_digits", "ERROR")}
    items = files.claims_json(spark, str(tmp_path / "a.json")).orderBy("input_ord").collect()
    assert [(r["input_ord"], r["pmid"], r["claimed_authors"]) for r in items][:2] == [(1, "12", []), (4, "p", ["a", "1"])]


@pytest.mark.parametrize(("text", "tag"), [("{}", "not_an_array"), ("no", "unreadable"), ("", "unreadable"), ('[{"a": 1, "a": 2}]', "unreadable")])
def test_roots(spark, text, tag):
    rows = sheets.claim_items(spark.createDataFrame([("p", text), ("e", "[]")], "path string, text string"))
    assert [(r["path"], r["line"], r["tag"]) for r in lint.claims(rows).collect()] == [("p", 0, tag)]
