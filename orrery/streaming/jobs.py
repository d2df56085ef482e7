"""Structured Streaming jobs over folders of files; each runs on what is there and stops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.storage import table_path


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a written table."""
    spark = stream.sparkSession
    out, state = table_path(spark, name), table_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def file_stream(rows: DataFrame, name: str, per_batch: int = 2) -> DataFrame:
    """The rows as a stream of files, ``per_batch`` files at a time."""
    spark = rows.sparkSession
    where = table_path(spark, name)
    rows.write.parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(where)


def deduplicated(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """First row of each key; keys are remembered as long as the watermark allows."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def token_bucket(stream: DataFrame, key: str, event_time: str, per_hour: float, cap: float) -> DataFrame:
    """``key, n, allowed``: tokens refill with time up to a cap, and each event takes one if there is one."""

    def take(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, n, allowed = state.get if state.exists else (cap, None, 0, 0)
        for part in parts:
            for at in part.sort_values(event_time)[event_time]:
                now = at.timestamp()
                tokens = min(cap, tokens + max(0.0, now - (last if last is not None else now)) * per_hour / 3600)
                last, n = now, n + 1
                if tokens >= 1:
                    tokens, allowed = tokens - 1, allowed + 1
        state.update((tokens, last, n, allowed))
        yield pd.DataFrame({key: [k[0]], "n": [n], "allowed": [allowed]})

    return stream.select(key, event_time).groupBy(key).applyInPandasWithState(
        take, f"{key} long, n long, allowed long", "tokens double, last double, n long, allowed long", "update", GroupStateTimeout.NoTimeout
    )


def token_bucket_batch(rows: DataFrame, key: str, event_time: str, per_hour: float, cap: float) -> DataFrame:
    """``key, n, allowed`` over a whole table: a task goes once through its keys' events in order of time, whatever their number."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, last, n, allowed = None, cap, 0.0, 0, 0
        for batch in batches:
            done = []
            for k, now in zip(batch[key].tolist(), batch["__at"].tolist(), strict=True):
                if n and k != at:
                    done.append((at, n, allowed))
                    n = 0
                if not n:
                    at, tokens, last, allowed = k, cap, now, 0
                tokens = min(cap, tokens + max(0.0, now - last) * per_hour / 3600)
                last, n = now, n + 1
                if tokens >= 1:
                    tokens, allowed = tokens - 1, allowed + 1
            yield pd.DataFrame(done, columns=[key, "n", "allowed"])
        if n:
            yield pd.DataFrame([(at, n, allowed)], columns=[key, "n", "allowed"])

    timed = rows.select(key, F.col(event_time).cast("timestamp").cast("double").alias("__at")).filter(F.col(key).isNotNull())
    return timed.repartition(key).sortWithinPartitions(key, "__at").mapInPandas(take, f"{key} long, n long, allowed long")


def run_update(stream: DataFrame, name: str, key: str) -> DataFrame:
    """Run an updating stream; the last row of each key stays."""
    spark = stream.sparkSession
    out, state = table_path(spark, name), table_path(spark, f"{name}-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")


def upsert_batches(spark: SparkSession, stream: DataFrame, target: str, key: str, order: str, buckets: int = 16) -> DataFrame:
    """Merge micro-batches into a table under ``target``, in which the latest row of each key wins; the table as it is at the end.

    A key belongs to a bucket, and a batch writes a new version of those buckets only that it has rows of.  A repeated
    batch writes the same version again.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", bucket)
        if batch_id:
            touched = rows.select("bucket").distinct()
            before = latest(spark, target, rows.schema, batch_id).join(F.broadcast(touched), "bucket", "left_semi")  # `buckets` rows at most
            rows = before.select(*rows.columns).unionByName(rows)
        best = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*", "bucket")
        best.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={batch_id}")

    state = table_path(spark, "upsert-state")
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("bucket", T.IntegerType())])
    return latest(spark, target, schema).select(*stream.columns)


def latest(spark: SparkSession, target: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The last version of each bucket (that a batch below ``before`` wrote)."""
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])).parquet(target)
    every = every if before is None else every.filter(F.col("version") < before)
    last = every.groupBy("bucket").agg(F.max("version").alias("version"))
    return every.join(F.broadcast(last), ["bucket", "version"], "left_semi")  # a row a bucket
