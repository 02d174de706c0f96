"""A stream of citations with a memory: each id is graded when it first appears, and what becomes of it is told later.

The memory is a table of one row an id, laid out in hash buckets. A batch reads
it, grades the ids that it does not hold or holds for too long, finds those whose
record has been retracted since, and writes, in this order, the graded rows, the
changes, and the memory made from the changes. A batch that was cut off is
repeated: if the memory already has rows of it, its changes are complete and only
the memory is written again; otherwise the batch begins anew.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refsieve.operators import verify
from refsieve.operators.cache import BUCKETS, bucket, replace_buckets
from refsieve.operators.durable import written
from refsieve.operators.rollup import union_legs
from refsieve.plans.schemas import CACHE_DAYS, NEGATIVE_CACHE_DAYS
from refsieve.sources.context import parse_context
from refsieve.sources.extract import extract
from refsieve.sources.files import EXTENSIONS, decoded, wanted

c = F.col
STATE = "key string, kind string, label string, verdict string, valid boolean, retracted boolean, graded_at timestamp, batch long"
_STATE = [field.split()[0] for field in STATE.split(", ")]
_FILES = "path string, modificationTime timestamp, length long, content binary"


def _key(kind: Column, given: Column) -> Column:
    """PMIDs as they are, other ids without regard to case; the kind tells equal ones apart."""
    return F.concat(kind, F.lit(" "), F.when(kind == "pmid", given).otherwise(F.lower(given)))


def arrivals(files: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Work items of files (path, modificationTime, content), each id once: its first citation by age of the file, path, pattern and place."""
    texts = decoded(files.where(wanted(c("path"), EXTENSIONS)))
    hits = extract(texts, kinds).join(files.select("path", c("modificationTime").alias("arrived")), "path")
    hits = hits.withColumn("key", _key(c("id_kind"), c("id")))
    first = F.min_by(F.struct("id", "id_kind", "path", "context", "arrived", "pattern_no", "pos"), F.struct("arrived", "path", "pattern_no", "pos"))
    kept = hits.groupBy("key").agg(first.alias("x")).select("key", "x.*").withColumn("claim", parse_context(c("context")))
    order = F.xxhash64("path", "id_kind", "pattern_no", "pos")
    return kept.select("key", "id", c("id_kind").alias("kind"), c("path").alias("label"), F.lit(False).alias("explicit"), order.alias("input_ord"), "claim.claimed_title", "claim.claimed_authors", "claim.claimed_journal", "claim.claimed_year", "claim.claimed_doi")


def graded(items: DataFrame, registries: dict[str, DataFrame]) -> DataFrame:
    """Items graded against the registries that are given: ``pmid`` always, ``doi`` and ``arxiv`` perhaps."""
    of = lambda kind: items.where(c("kind") == kind).drop("key")
    legs = [verify.verify_pmid(of("pmid"), registries["pmid"])]
    if "doi" in registries:
        legs.append(verify.verify_doi(of("doi"), registries["doi"], registries["pmid"]))
    if "arxiv" in registries:
        legs.append(verify.verify_arxiv(of("arxiv"), registries["arxiv"], registries["pmid"]))
    return union_legs(*legs)


def changes(state: DataFrame, rows: DataFrame, registry: DataFrame, now: Column, number: int) -> DataFrame:
    """What a batch changes: the columns of the memory, ``was`` and ``change``.

    ``first`` and ``again`` (too old to hold) are this batch's graded ``rows``;
    ``unanswered`` ones, whose registry could not be asked, are not remembered.
    ``retracted`` are PMIDs of earlier batches whose record has been retracted
    since; they keep their age.
    """
    known = state.select("key", c("verdict").alias("was"))
    told = rows.withColumn("key", _key(c("kind"), c("id"))).join(known, "key", "left")
    down = F.coalesce("network_error", F.lit(False))
    told = told.withColumns({"change": F.when(down, "unanswered").when(c("was").isNull(), "first").otherwise("again"), "graded_at": now})
    told = told.select("key", "kind", "label", "verdict", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("retracted", F.lit(False)).alias("retracted"), "graded_at", "was", "change")
    gone = registry.where("valid and retracted").select(F.concat(F.lit("pmid "), "pmid").alias("key")).distinct()
    turned = state.where("kind = 'pmid' and valid and not retracted").join(gone, "key", "left_semi").join(told.select("key"), "key", "left_anti")
    turned = turned.select("key", "kind", "label", verify.capped_retraction(c("verdict"), F.lit(True)).alias("verdict"), "valid", F.lit(True).alias("retracted"), "graded_at", c("verdict").alias("was"), F.lit("retracted").alias("change"))
    return told.unionByName(turned).withColumn("batch", F.lit(number).cast("long"))


def remember(told: DataFrame, state: DataFrame, path: str, buckets: int) -> None:
    """The memory with a batch's changes; only the buckets of their ids are rewritten."""
    new = told.where("change <> 'unanswered'").select(*_STATE)
    touched = [r["b"] for r in new.select(bucket(c("key"), buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        old = state.where(c("bucket").isin(touched)).drop("bucket").join(new, "key", "left_anti")
        replace_buckets(old.select(*_STATE).unionByName(new), path, buckets, "key")


def follow(spark: SparkSession, folder: str, registries: Callable[[], dict[str, DataFrame]], output: str, checkpoint: str, now: Callable[[], datetime] = datetime.now, files_at_once: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Grade what new files cite into ``output/graded/batch=<n>`` and ``output/changes/batch=<n>``; the memory is ``output/state``.

    ``registries`` is called for each batch, so that it sees later records.
    A found id holds for 30 days, one that was not found for 3; after that it is
    graded again when it is cited again. Ids are graded on their own: a DOI is
    not merged into a PMID that another batch may bring. ``buckets`` must stay
    the same for an ``output``.
    """
    source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
    files = (source.option("maxFilesPerTrigger", files_at_once) if files_at_once else source).load(folder)
    memory = f"{output}/state"
    empty = spark.createDataFrame([], f"{STATE}, bucket int")
    empty.write.mode("append").partitionBy("bucket").parquet(memory)

    def grade(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = session.read.schema(f"{STATE}, bucket int").parquet(memory)
        at = f"{output}/changes/batch={number}"
        if state.where(c("batch") == number).isEmpty():
            asked, today = registries(), F.lit(now())
            days = F.when(c("valid"), CACHE_DAYS).otherwise(NEGATIVE_CACHE_DAYS)
            held = state.where(c("graded_at") > today - F.make_dt_interval(days))
            kinds = tuple(k for k in ("pmid", "doi", "arxiv") if k in asked)
            items = written(arrivals(batch, kinds).join(held, "key", "left_anti"), "arrivals")
            graded(items, asked).write.mode("overwrite").parquet(f"{output}/graded/batch={number}")
            rows = session.read.parquet(f"{output}/graded/batch={number}")
            changes(state.drop("bucket"), rows, asked["pmid"], today, number).drop("batch").write.mode("overwrite").parquet(at)
        told = session.read.parquet(at).withColumn("batch", F.lit(number).cast("long"))
        remember(told, state, memory, buckets)

    return files.writeStream.foreachBatch(grade).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
