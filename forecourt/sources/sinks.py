"""Sinks: listing snapshots, posting logs, posted titles, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions.exprs import first_filled
from .feeds import NULL


def write_snapshot(listings: DataFrame, path: str, run_id: str) -> None:
    """The run's listings as its own partition; earlier runs stay, and a repeated run replaces itself."""
    rows = listings.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_json(listings: DataFrame, path: str, run_id: str) -> None:
    """The run's listings as JSON lines beside those of other runs, fields without a value included; a repeated run replaces its own."""
    writer = listings.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", False).partitionBy("run_id").json(path)


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """A run's report beside those of other runs; a repeated run replaces its own."""
    write_snapshot(report, path, run_id)


def append_log(rows: DataFrame, path: str) -> None:
    """Posting-log rows as CSV with a header, a folder per day."""
    dated = rows.withColumn("day", F.to_date("timestamp"))
    csv_writer(dated).mode("append").partitionBy("day").csv(path)


def posted_titles(cars: DataFrame) -> DataFrame:
    return cars.select(first_filled(F.col("title"), F.lit("Unknown Title")).alias("value"))


def append_titles(cars: DataFrame, path: str) -> None:
    posted_titles(cars).write.mode("append").text(path)


def csv_writer(rows: DataFrame) -> DataFrameWriter:
    """As feeds.csv_feed() reads it: white space and quotes as they are."""
    writer = rows.write.option("header", True).option("escape", '"').option("nullValue", NULL)
    return writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write_csv(rows: DataFrame, path: str) -> None:
    csv_writer(rows).csv(path)
