"""Tables of a data folder as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a file that one task works on, where rows are dealt out.
SHARE = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in few files dealt over all cores and more, for work that costs far more than a shuffle of them.

    A file of one row group is read by one task, whatever its size and the cores.  Tables of as many files as there are cores
    stay as they are.
    """
    spark = rows.sparkSession
    files, cores = rows.inputFiles(), spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return rows
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)  # of fewer files than cores
    return rows.repartition(max(cores, size // SHARE))
