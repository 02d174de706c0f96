"""A stream of documents: files that arrive in a folder are extracted and graded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refsieve.operators import verify
from refsieve.operators.rollup import union_legs
from refsieve.sources.context import parse_context
from refsieve.sources.extract import extract
from refsieve.sources.files import EXTENSIONS, decoded, wanted


def scanned_items(documents: DataFrame, kinds: tuple[str, ...] = ("pmid",)) -> DataFrame:
    """Work items of some kinds from (path, text) documents, claims parsed from each hit's context."""
    found = extract(documents, kinds).withColumn("claim", parse_context(F.col("context")))
    order = F.xxhash64("path", "id_kind", "pattern_no", "pos")
    return found.select("id", F.col("id_kind").alias("kind"), F.col("path").alias("label"), F.lit(False).alias("explicit"), order.alias("input_ord"), "claim.claimed_title", "claim.claimed_authors", "claim.claimed_journal", "claim.claimed_year", "claim.claimed_doi")


def watch(spark: SparkSession, folder: str, registry: DataFrame, output: str, checkpoint: str, once: bool = True, doi_records: DataFrame | None = None, arxiv_records: DataFrame | None = None) -> StreamingQuery:
    """Grade the identifiers of new files into Parquet at ``output``; exactly-once by batch folders.

    PMIDs are graded against ``registry``, DOIs and arXiv ids where their records
    are given. Every citation is graded: a batch knows nothing of earlier ones.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    kinds = ("pmid", *(("doi",) if doi_records is not None else ()), *(("arxiv",) if arxiv_records is not None else ()))

    def grade(batch: DataFrame, number: int) -> None:
        items = scanned_items(decoded(batch.where(wanted(F.col("path"), EXTENSIONS))), kinds).persist()
        of = lambda kind: items.where(F.col("kind") == kind)
        legs = [verify.verify_pmid(of("pmid"), registry)]
        if doi_records is not None:
            legs.append(verify.verify_doi(verify.doi_merged(of("doi"), legs[0]), doi_records, registry))
        if arxiv_records is not None:
            legs.append(verify.verify_arxiv(of("arxiv"), arxiv_records, registry))
        union_legs(*legs).write.mode("overwrite").parquet(f"{output}/batch={number}")
        items.unpersist()

    writer = files.writeStream.foreachBatch(grade).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
