"""Exports of named layouts: files that other programs read, written by Spark's writers and counted while they are written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the exported files, in their order.
COMPANY_FIELDS = (
    "id", "company_number", "native_company_number", "name", "legal_form", "current_status", "registry_court", "registry_type", "registration_date", "city",
    "state", "capital_amount", "capital_currency", "ai_robotics_score", "matched_keywords", "tech_categories", "website", "source", "first_seen_date",
)
SCORED_FIELDS = ("id", "name", "city", "registration_date", "capital_amount", "ai_robotics_score", "startup_score", "startup_classification", "website", "purpose")

#: Quotes are doubled, lines may lie in a quoted field, and white space is kept.
CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


@dataclass(frozen=True)
class Report:
    """Rows of one file of an export; ``order`` sorts the whole export, across its part files."""

    rows: DataFrame
    fields: Sequence[str] | None = None
    order: Sequence[Column] = ()


def laid_out(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields of a layout, in its order: those that the rows lack are null, lists are joined by comma and space, and other columns go."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def field(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        return (F.array_join(name, ", ") if isinstance(kinds[name], T.ArrayType) else F.col(f"`{name}`")).alias(name)

    return rows.select([field(name) for name in fields])


def write_csv(report: Report, where: str) -> int:
    """Write a report as CSV with a header in each part; how many rows were written, as the write saw them."""
    rows = report.rows.orderBy(*report.order) if report.order else report.rows
    seen = Observation()
    laid_out(rows, report.fields or rows.columns).observe(seen, F.count(F.lit(1)).alias("n")).write.options(**CSV).csv(where)
    return seen.get["n"]


def read_csv(spark: SparkSession, where: str, fields: Sequence[str]) -> DataFrame:
    """An export as text columns.  CSV has one way to write nothing: null and empty are both null."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return spark.read.options(**CSV, multiLine="true", enforceSchema="false").schema(schema).csv(where)


def write_reports(reports: Mapping[str, Report], where: str) -> dict[str, int]:
    """A folder of CSV exports, one below each name, with the rows of each."""
    return {name: write_csv(report, f"{where}/{name}") for name, report in reports.items()}


def selected(rows: DataFrame, score: str, least: float, kind: str | None = None, label: str | None = None, limit: int | None = 10_000, key: str = "id") -> Report:
    """Rows of a least score, and of one class if ``label`` is given, the highest scores first, equal scores by ``key``; ``limit`` is the export's own."""
    rows = rows.filter(F.col(score) >= least)
    if label is not None:
        rows = rows.filter(F.col(kind) == label)
    order = (F.desc(score), F.col(key))
    return Report(rows.orderBy(*order).limit(limit) if limit is not None else rows, SCORED_FIELDS, order)


def write_bundle(parts: Mapping[str, DataFrame], where: str, exported_at: str) -> DataFrame:
    """A JSON export with an envelope: a folder of records, one a line, below each part's name, and a manifest of them.

    The manifest, ``exported_at, part, count`` with a row for each part, is written last, so that a folder without one is an
    export that did not end.  Records of other parts (officers, events) carry the key of their company instead of lying
    inside its record, where one company's could be any number.
    """
    spark = next(iter(parts.values())).sparkSession
    counts = []
    for name, rows in parts.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").json(f"{where}/{name}")
        counts.append((exported_at, name, seen.get["n"]))
    spark.createDataFrame(counts, "exported_at string, part string, count long").coalesce(1).write.json(f"{where}/manifest")
    return spark.read.schema("exported_at string, part string, count long").json(f"{where}/manifest")


def read_part(spark: SparkSession, where: str, name: str, schema: str | T.StructType) -> DataFrame:
    """Records of a part whose folder has a manifest; an error without one."""
    spark.read.schema("part string").json(f"{where}/manifest")
    return spark.read.schema(schema).json(f"{where}/{name}")
