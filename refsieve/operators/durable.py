"""Tables between steps, written where every executor reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder from spark.checkpoint.dir; where that is unset, a temporary one of a local master. A cluster without it raises."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.refsieve.tables", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="refsieve-tables-")
        spark.conf.set("spark.refsieve.tables", base)
    return f"{base.rstrip('/')}/refsieve-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: computed once, and there when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores: a small file is one task, however much is made of each of its rows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
