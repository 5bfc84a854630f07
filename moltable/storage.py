"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set a local folder on a local master, as in tests, and an error on a cluster."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = os.path.join(tempfile.gettempdir(), "moltable-checkpoints")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(parts: list[DataFrame], name: str = "step") -> DataFrame:
    """The rows of all parts as one stored table; the tables that the parts were read from are deleted."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = stored(out, name)
    discard(*parts)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    spark = tables[0].sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)
