"""The record cache as a table of hash buckets, with a version of its schema.

``path/rows/bucket=<n>`` holds the records whose id falls into a bucket,
``path/about`` the version and how many buckets there are. An upsert reads and
rewrites only the buckets that its ids fall into; a bucket is replaced as a whole
and the latest record of an id wins, so an upsert that was cut off is repeated
with the same result. Choose the buckets so that one is read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from refsieve.operators.durable import written
from refsieve.operators.rollup import upserted

c = F.col
VERSION, BUCKETS = 3, 64
SCHEMA = "pmid string, title string, authors array<string>, journal string, pubdate string, doi string, valid boolean, error string, cached_at timestamp, source string, retracted boolean"
COLUMNS = tuple(field.split()[0] for field in SCHEMA.split(", "))


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def migrated(rows: DataFrame, version: int) -> DataFrame:
    """Rows of an older version in today's columns; a version from the future raises.

    Before version 2 a failed request could pass for a record that is not there,
    so those are left out. Before version 3 nothing tells retractions, so none
    is known. Authors may be JSON text, validity a number, ages seconds since 1970.
    A column that is missing is null; rows without an id have no place.
    """
    if version > VERSION:
        raise ValueError(f"the cache has version {version}, later than {VERSION}")
    types = dict(rows.dtypes)
    cast = {
        "authors": lambda x: F.from_json(x, "array<string>") if types["authors"] == "string" else x,
        "valid": lambda x: x if types["valid"] == "boolean" else x != 0,
        "cached_at": lambda x: F.timestamp_seconds(x) if types["cached_at"] in ("double", "float", "int", "bigint") else x.cast("timestamp"),
    }
    whole = dict(field.split() for field in SCHEMA.split(", "))
    value = {n: cast[n](c(n)) if n in cast and n in types else c(n) if n in types else F.lit(None) for n in COLUMNS}
    value["retracted"] = F.coalesce(value["retracted"].cast("boolean"), F.lit(False))
    rows = rows.where(c("pmid").isNotNull()).select(*[value[n].cast(whole[n]).alias(n) for n in COLUMNS])
    return rows if version >= 2 else rows.where("valid")


def about(spark: SparkSession, path: str) -> Row:
    """(version, buckets) of the cache at ``path``."""
    return spark.read.schema("version int, buckets int").json(f"{path}/about").first()


def create(rows: DataFrame, path: str, version: int = VERSION, buckets: int = BUCKETS) -> None:
    """Lay out rows of some version at a new ``path``, as they are."""
    placed = rows.withColumn("bucket", bucket(c("pmid"), buckets))
    placed.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    _describe(rows.sparkSession, path, version, buckets)


def _describe(spark: SparkSession, path: str, version: int, buckets: int) -> None:
    spark.createDataFrame([(version, buckets)], "version int, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def replace_buckets(rows: DataFrame, path: str, buckets: int, key: str = "pmid") -> None:
    """Replace the folders ``bucket=<n>`` at ``path`` that ``rows`` fall into; they are written elsewhere first, as they may come from there."""
    placed = written(rows.withColumn("bucket", bucket(c(key), buckets)), "cache")
    placed.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cache in today's columns and ``bucket``, whatever its version; a filter on ``bucket`` reads those folders only."""
    rows = spark.read.parquet(f"{path}/rows")
    known = about(spark, path)
    today = migrated(rows, known["version"])
    return today.withColumn("bucket", bucket(c("pmid"), known["buckets"])) if known["version"] < VERSION else rows.select(*COLUMNS, "bucket")


def migrate(spark: SparkSession, path: str) -> bool:
    """Rewrite a cache of an older version as today's; false if there is nothing to do.

    The new rows are complete in the shared folder before the old ones go, and
    the version is told last: a run that was cut off is begun anew from what is there.
    """
    known = about(spark, path)
    if known["version"] >= VERSION:
        return False
    rows = written(migrated(spark.read.parquet(f"{path}/rows"), known["version"]).withColumn("bucket", bucket(c("pmid"), known["buckets"])), "cache")
    rows.repartition(known["buckets"], "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/rows")
    _describe(spark, path, VERSION, known["buckets"])
    return True


def upsert(spark: SparkSession, path: str, found: DataFrame) -> int:
    """Put found records (today's columns, perhaps ``network_error``) over cached ones; returns how many buckets were rewritten.

    Network failures and rows without an id are never stored.
    """
    migrate(spark, path)
    buckets = about(spark, path)["buckets"]
    found = found if "network_error" in found.columns else found.withColumn("network_error", F.lit(False))
    found = written(found.select(*COLUMNS, "network_error").where("pmid is not null and not coalesce(network_error, false)"), "found")
    touched = [r["b"] for r in found.select(bucket(c("pmid"), buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        old = load(spark, path).where(c("bucket").isin(touched)).drop("bucket")
        replace_buckets(upserted(old, found), f"{path}/rows", buckets)
    return len(touched)
