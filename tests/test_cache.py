"""The bucketed cache: what an upsert rewrites, older versions, and what is never stored."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from refsieve.operators import cache


def rows(spark, ids, day, title="t", **more):
    have = {"title": title, "valid": True, "source": "pubmed", "retracted": False} | more
    data = [tuple(i if n == "pmid" else datetime(2024, 1, day) if n == "cached_at" else have.get(n) for n in cache.COLUMNS) for i in ids]
    return spark.createDataFrame(data, cache.SCHEMA)


def files(path):
    return {p.parent.name: p.name for p in (path / "rows").glob("bucket=*/*.parquet")}


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    at, path = str(tmp_path / "c"), tmp_path / "c"
    cache.create(rows(spark, [str(i) for i in range(200)], 5), at, buckets=16)
    before = files(path)
    assert len(before) == 16
    new = rows(spark, ["7", "900"], 6, "new").unionByName(rows(spark, ["8"], 4, "older")).withColumn("network_error", F.lit(False))
    new = new.unionByName(rows(spark, ["9", "901"], 7, "down").withColumn("network_error", F.lit(True))).unionByName(rows(spark, [None], 7).withColumn("network_error", F.lit(False)))
    for _ in range(2):  # repeated, as after a cut
        n = cache.upsert(spark, at, new)
        got = {r["pmid"]: r["title"] for r in cache.load(spark, at).collect()}
        assert n <= 3 and len(got) == cache.load(spark, at).count() == 201
        assert (got["7"], got["900"], got["8"], got["9"]) == ("new", "new", "t", "t") and "901" not in got
    touched = {f"bucket={r['b']}" for r in spark.createDataFrame([("7",), ("8",), ("900",)], "k string").select(cache.bucket(F.col("k"), 16).alias("b")).collect()}
    assert {b for b, name in files(path).items() if before[b] != name} == touched
    assert cache.upsert(spark, at, new.where("false")) == 0


def test_older_versions(spark, tmp_path):
    old = spark.createDataFrame([("1", "a", '["X"]', 1, 86400.0), ("2", None, None, 0, 86400.0), (None, "c", None, 1, 0.0)], "pmid string, title string, authors string, valid int, cached_at double")
    for version, kept in ((1, ["1"]), (2, ["1", "2"])):
        at = str(tmp_path / f"v{version}")
        cache.create(old, at, version=version, buckets=4)
        read = cache.load(spark, at).orderBy("pmid").collect()
        assert [r["pmid"] for r in read] == kept and read[0]["authors"] == ["X"] and read[0]["retracted"] is False and read[0]["cached_at"] == datetime(1970, 1, 2)
        assert cache.migrate(spark, at) and not cache.migrate(spark, at)
        assert cache.about(spark, at)["version"] == cache.VERSION
        assert cache.load(spark, at).orderBy("pmid").collect() == read
        cache.upsert(spark, at, rows(spark, ["1"], 2, "b"))
        assert cache.load(spark, at).where("pmid = '1'").first()["title"] == "b"
    with pytest.raises(ValueError):
        cache.migrated(old, 4)
