"""Intermediate tables that outlive the executors which computed them.

Lineage is cut by writing a table to the shared folder that the session names
in ``spark.checkpoint.dir``.  A written table keeps column pruning and file
statistics, which an RDD checkpoint loses.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.workers import per_worker


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors; a temporary one, of this process, only where Spark runs in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        where = per_worker("local shared folder", lambda: f"file://{tempfile.mkdtemp(prefix='orrery-')}")
    return where.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str = "stage", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once and return the written table; ``group_rows`` bounds row groups where single rows are large."""
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write
    if group_rows is not None:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)
