"""The news job: a stream of items that leaves mentions, events, alerts and investments, each written once.

Items arrive as files, late and twice.  A watermark on the time of publication drops
what is too late and forgets links after the same delay.  What is left of a
micro-batch goes to four tables in one ``foreachBatch``; every table has a folder a
batch that is overwritten, so a batch that is repeated after a failure changes
nothing, and a job that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "mentions": "link string, company string, amount double, published timestamp",
    "events": "company string, kind string, amount double, published timestamp",
    "alerts": "company string, link string, reason string",
    "investments": "company string, investor string, amount double, link string",
}
Extract = Callable[[DataFrame], DataFrame]


def news_outputs(items: DataFrame, companies: DataFrame, large: float) -> dict[str, DataFrame]:
    """The four tables of some items ``(link, company, amount, investors, published)``; ``companies`` has distinct ``company``."""
    known = items.join(companies.select("company", F.lit(True).alias("known")), "company", "left")
    seen = known.filter("known")
    reason = F.when(F.col("known").isNull(), "unknown company").when(F.col("amount") >= large, "large round")
    return {
        "mentions": items.select("link", "company", "amount", "published"),
        "events": seen.filter("amount is not null").select("company", F.lit("funding").alias("kind"), "amount", "published"),
        "alerts": known.select("company", "link", reason.alias("reason")).filter("reason is not null"),
        "investments": seen.select("company", F.explode("investors").alias("investor"), "amount", "link"),
    }


def run_news_job(stream: DataFrame, companies: DataFrame, extract: Extract, where: str, delay: str = "7 days", large: float = 1e7) -> None:
    """Work through all items ``(link, title, published)`` that are there and stop; called again, go on with what is new."""
    fresh = stream.filter("link is not null and published is not null").withWatermark("published", delay).dropDuplicatesWithinWatermark(["link"])

    def write(batch: DataFrame, batch_id: int) -> None:
        items = extract(batch).persist()
        try:
            for name, rows in news_outputs(items, companies, large).items():
                rows.write.mode("overwrite").parquet(f"{where}/{name}/batch={batch_id}")
        finally:
            items.unpersist()

    query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def read_output(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{where}/{name}").drop("batch")
