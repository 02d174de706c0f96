"""The stream with a memory: batches equal one run, restarts lose and repeat nothing, changes are told."""

import os
from datetime import datetime, timedelta

import pytest

from refsieve.plans.schemas import DOI_RECORD, REGISTRY
from refsieve.streaming import citations

DAY = datetime(2024, 3, 1)
TEXTS = [
    "Ravelli A, Martini B. A trial of early therapy. Lancet. 2020;1:5. PMID: 1234567 and PMID: 2222222",
    "Other X. Wrong words here altogether. Lancet. 2020;1:5. PMID: 1234567; see doi:10.1000/LOST",
    "Smith J, Doe A. Another study of late therapy. BMJ. 2021;2:6. PMID: 7654321 doi:10.1000/lost PMID: 2222222",
]


def record(pmid, title, authors, journal, year, **more):
    have = {"pmid": pmid, "title": title, "authors": authors, "journal": journal, "pubdate": year, "valid": True, "network_error": False, "retracted": False} | more
    return tuple(have.get(field.split()[0]) for field in REGISTRY.split(", "))


def tables(spark, **more):
    pmid = [record("1234567", "A trial of early therapy", ["Ravelli A", "Martini B"], "Lancet", "2020", **more), record("7654321", "Another study of late therapy", ["Smith J", "Doe A"], "BMJ", "2021")]
    doi = [("10.1000/lost", "not_found", *([None] * (len(DOI_RECORD.split(",")) - 2)))]
    return lambda: {"pmid": spark.createDataFrame(pmid, REGISTRY), "doi": spark.createDataFrame(doi, DOI_RECORD)}


def put(folder, n, text):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.txt").write_text(text)
    os.utime(folder / f"{n}.txt", (1_700_000_000 + n, 1_700_000_000 + n))


def run(spark, at, registries, day=DAY, **more):
    citations.follow(spark, str(at / "in"), registries, str(at / "out"), str(at / "cp"), now=lambda: day, buckets=4, **more).awaitTermination()


def seen(spark, at, what="changes"):
    order = ["batch", "change", "key"] if what == "changes" else ["key"]
    return [r.asDict() for r in spark.read.parquet(str(at / "out" / what)).orderBy(*order).collect()]


def test_batches_and_restarts_equal_one_run(spark, tmp_path):
    for n, text in enumerate(TEXTS):
        put(tmp_path / "one" / "in" if (tmp_path / "one").mkdir(exist_ok=True) is None else None, n, text)
    run(spark, tmp_path / "one", tables(spark))
    run_three = tmp_path / "three"
    run_three.mkdir()
    for n, text in enumerate(TEXTS):  # a run each, begun anew from the checkpoint
        put(run_three / "in", n, text)
        run(spark, run_three, tables(spark))
    plain = lambda at, drop: sorted((r["key"], r["verdict"], r["valid"], os.path.basename(r["label"]), r["change"]) for r in seen(spark, at))
    assert plain(run_three, 0) == plain(tmp_path / "one", 0)
    assert [x[:2] for x in plain(run_three, 0)] == [("doi 10.1000/lost", "unknown"), ("pmid 1234567", "correct"), ("pmid 2222222", "invalid"), ("pmid 7654321", "correct")]
    assert {r["batch"] for r in seen(spark, run_three)} == {0, 1, 2}


def test_a_cut_batch_is_repeated(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", 0, TEXTS[0])
    whole, calls = citations.replace_buckets, []

    def cut(rows, *rest):
        whole(rows.where("bucket = 0") if "bucket" in rows.columns else rows.limit(1), *rest)
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(citations, "replace_buckets", cut)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, tables(spark))
    first = seen(spark, tmp_path)
    monkeypatch.setattr(citations, "replace_buckets", whole)
    put(tmp_path / "in", 1, TEXTS[1])
    run(spark, tmp_path, tables(spark))
    assert calls and [r for r in seen(spark, tmp_path) if r["batch"] == 0] == first and len(first) == 2
    assert [r["key"] for r in seen(spark, tmp_path, "state")] == ["doi 10.1000/lost", "pmid 1234567", "pmid 2222222"]


def test_retractions_and_ages(spark, tmp_path):
    put(tmp_path / "in", 0, TEXTS[0])
    run(spark, tmp_path, tables(spark))
    put(tmp_path / "in", 1, "PMID: 2222222 again, two days later")
    run(spark, tmp_path, tables(spark), DAY + timedelta(days=2))
    put(tmp_path / "in", 2, "PMID: 2222222 again, four days later")
    run(spark, tmp_path, tables(spark, retracted=True), DAY + timedelta(days=4))
    put(tmp_path / "in", 3, TEXTS[0])
    run(spark, tmp_path, tables(spark, retracted=True), DAY + timedelta(days=40))
    got = [(r["batch"], r["change"], r["key"], r["was"], r["verdict"]) for r in seen(spark, tmp_path)]
    assert got == [
        (0, "first", "pmid 1234567", None, "correct"), (0, "first", "pmid 2222222", None, "invalid"),
        (2, "again", "pmid 2222222", "invalid", "invalid"), (2, "retracted", "pmid 1234567", "correct", "partial"),
        (3, "again", "pmid 1234567", "partial", "partial"), (3, "again", "pmid 2222222", "invalid", "invalid"),
    ]


def test_unanswered_ids_are_not_remembered(spark, tmp_path):
    put(tmp_path / "in", 0, "PMID: 1234567")
    run(spark, tmp_path, tables(spark, valid=False, network_error=True))
    assert [r["change"] for r in seen(spark, tmp_path)] == ["unanswered"] and spark.read.parquet(str(tmp_path / "out" / "graded")).count() == 1
    put(tmp_path / "in", 1, TEXTS[0])
    run(spark, tmp_path, tables(spark))
    assert [(r["key"], r["batch"]) for r in seen(spark, tmp_path, "state")] == [("pmid 1234567", 1), ("pmid 2222222", 1)]
