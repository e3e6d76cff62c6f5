"""Listing pages and outcome logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, filters, report
from ..sources.feeds import exists
from ..sources.schemas import PAGE, POSTING_LOG
from .history import History


def accepted(pages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(page_id, source_url, source_id, title, variant), excluded before the costly fields are taken out of the page."""
    rows = pages if terms is None else filters.exclude_by_url(pages, terms, url="url")
    names = [c.alias(name) for name, c in extract.heading(F.col("html")).items()]
    return rows.select("page_id", F.col("url").alias("source_url"), extract.listing_id(F.col("url")).alias("source_id"), *names)


def accept_batch(history: History, pages: DataFrame, run: str, batch: int, terms: DataFrame | None = None) -> None:
    """Adds to the history the pages of a batch whose address neither the batch nor the history has had, each with the fields of accepted().

    Exclusion and history look at addresses alone; only pages that pass both are compared with each other."""
    rows = pages if terms is None else filters.exclude_by_url(pages, terms, url="url")
    new = history.unseen(rows.withColumnRenamed("url", history.url), run, batch).withColumnRenamed(history.url, "url")
    history.append(accepted(filters.first_seen(new, "url", ["page_id", "html"])), run, batch)


def ingest_pages(
    spark: SparkSession, source: str, target: str, checkpoint: str, terms: DataFrame | None = None, files_per_batch: int = 100, run: str = "run", history: History | None = None
) -> StreamingQuery:
    """Appends to target the pages whose address neither this run nor an earlier one has had and that no term excludes.

    A batch writes its own partition, and doesn't count it as history, so that a repeated batch replaces itself. Runs with a
    checkpoint of their own need a name of their own."""
    history = history or History(spark, target)
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = pages.writeStream.foreachBatch(lambda batch, n: accept_batch(history, batch, run, n, terms))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_pages(spark: SparkSession, source: str, within: str = "7 days", files_per_batch: int = 100) -> DataFrame:
    """The stream of pages by their first address in `within`, by the time of their files; an address that comes again later passes again.

    The state holds an address for that long only, whatever the length of the stream. Which of several pages of an address stays is
    left open: (source_url, source_id, arrived) don't depend on it but for the time. Pages without an address aren't in it."""
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = pages.select("url", F.col("_metadata.file_modification_time").alias("arrived")).where("url IS NOT NULL")
    first = rows.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["url"])
    return first.select(F.col("url").alias("source_url"), extract.listing_id(F.col("url")).alias("source_id"), "arrived")


def keep(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's final rows to a table."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_sizes(query: StreamingQuery) -> list[dict]:
    """For each batch of the query that is remembered: batch, rows in, state rows, those removed and dropped as too late."""
    out = []
    for p in query.recentProgress:
        ops = p["stateOperators"]
        totals = {to: sum(o[of] for o in ops) for to, of in (("state_rows", "numRowsTotal"), ("removed", "numRowsRemoved"), ("dropped", "numRowsDroppedByWatermark"))}
        out.append({"batch": p["batchId"], "rows": p["numInputRows"]} | totals)
    return out


def log_stream(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(POSTING_LOG).option("header", True).option("multiLine", True).option("escape", '"')
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).csv(source)


def running_summary(log: DataFrame) -> DataFrame:
    """The posting summary of all that has come, for output mode complete."""
    return log.agg(*report.status_counts(F.col("status")))


def keep_summary(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes running_summary() to target whenever new rows have come; a repeated batch writes the same."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = running_summary(log).writeStream.outputMode("complete").foreachBatch(put)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DAY = "1 day"


def daily_summary(log: DataFrame, late: str = "1 day") -> DataFrame:
    """The same for each day; a day is final when the watermark has passed it, rows that come later are left out: see late_rows()."""
    days = log.withWatermark("timestamp", late).groupBy(F.window("timestamp", DAY))
    return days.agg(*report.status_counts(F.col("status"))).select(F.col("window.start").alias("day"), "total", "posted", "skipped", "rejected", "failed")


def keep_late(log: DataFrame, target: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends to target the rows that daily_summary() leaves out, with their batch: those whose day ended before the watermark of the batch before theirs.

    It runs on the same files in the same batches as the summary. The highest time of each batch is kept beside the rows, at
    `target`-marks; a repeated batch replaces what it wrote. As the summary closes its days at the end of a run, all earlier
    batches count for the first one of the next run."""
    spark = log.sparkSession
    marks, first = f"{target}-marks", {"run": True}
    dynamic = {"partitionOverwriteMode": "dynamic"}

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        last = batch_id if first.pop("run", False) else batch_id - 1
        if exists(spark, marks):
            high = spark.read.parquet(marks).where(F.col("batch") < last).agg((F.max("high") - F.expr(f"INTERVAL {late}")).alias("mark"))
            ends = batch.withColumn("ends", F.window("timestamp", DAY)["end"])
            rows = ends.join(F.broadcast(high), F.col("ends") <= F.col("mark"))  # one row
            rows.drop("mark", "ends").write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(target)
        batch.groupBy("batch").agg(F.max("timestamp").alias("high")).write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(marks)

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, target: str) -> DataFrame:
    """What keep_late() has written to target, none if it has seen one batch only."""
    schema = T.StructType([*POSTING_LOG.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(target) if exists(spark, target) else spark.createDataFrame([], schema)
