"""The work queue as tables: what is left is the queue without the outcomes, so any rerun resumes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_filled
from ..sources.shared import landed

KEYLESS = ["", "."]


def identified(queue: DataFrame) -> DataFrame:
    """queue with queue_id, its source_id or else its id, and link, the address under either name, else "."."""
    has = queue.columns
    ids = [F.col(c).cast("string") for c in ("source_id", "id") if c in has]
    links = [F.col(f"`{c}`") for c in ("Source Link", "source_url") if c in has]
    return queue.withColumns({"queue_id": first_filled(*ids), "link": first_filled(*links, F.lit(".")) if links else F.lit(".")})


def with_position(queue: DataFrame, order: list, to: str = "pos") -> DataFrame:
    """queue with `to`, each row's place in the order, from 1 and without gaps; of rows of one place in the order any comes first.

    Rows are sorted in ranges, and a range begins where the ones before end: only the sizes of the ranges go through the driver, one
    number for each, and no task sees more than its range."""
    sorted_ = queue.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = landed(sorted_.withColumn("_n", F.monotonically_increasing_id()), "queue")
    part, within = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())
    starts, total = {}, 0
    for r in sizes:
        starts[str(r["part"])], total = total, total + r["count"]
    table = F.from_json(F.lit(json.dumps(starts)), "map<string,bigint>")
    return rows.withColumn(to, F.element_at(table, part.cast("string")) + within + 1).drop("_n")


def left(queue: DataFrame) -> DataFrame:
    """One row: how many are left."""
    return queue.agg(F.count("*").alias("remaining"))


def head(queue: DataFrame, k: int, order: list) -> DataFrame:
    return queue.orderBy(*order).limit(k)


def route(decision: Column) -> Column:
    """posted for y and yes, cancelled for any other answer, waiting without one."""
    return F.when(decision.isNull(), "waiting").when(F.lower(F.trim(decision)).isin("y", "yes"), "posted").otherwise("cancelled")


def keyless(queue: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows that no outcome can name; they leave the queue for a person to look at."""
    return queue.where(F.col(key).isNull() | F.col(key).isin(KEYLESS))


def remaining(queue: DataFrame, done: DataFrame, key: str = "source_id") -> DataFrame:
    named = queue.where(F.col(key).isNotNull() & ~F.col(key).isin(KEYLESS))
    return named.join(done.select(key).distinct(), key, "left_anti")
