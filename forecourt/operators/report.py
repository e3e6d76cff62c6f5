"""Posting logs and reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import first_filled

LOG_TEXTS = ["ad_number", "source_url", "year", "make", "model", "variant", "status", "reason"]


def log_rows(outcomes: DataFrame) -> DataFrame:
    """Log rows: absent texts are '', vehicle_id the address or else the id, times to the second."""
    has = outcomes.columns
    texts = {c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("") for c in LOG_TEXTS}
    ids = [F.col(c) for c in ("source_url", "source_id") if c in has]
    return outcomes.select(
        F.date_trunc("second", "timestamp").alias("timestamp"),
        texts["ad_number"].cast("string").alias("ad_number"),
        F.coalesce(first_filled(*ids, F.lit("")), F.lit("")).alias("vehicle_id"),
        *[texts[c].alias(c) for c in LOG_TEXTS[1:]],
    )


def status_counts(status: Column) -> list[Column]:
    """total, and posted, skipped, rejected, failed without regard to case; other statuses count only in total."""
    return [F.count("*").alias("total"), *[F.count_if(F.upper(status) == s).alias(s.lower()) for s in ("POSTED", "SKIPPED", "REJECTED", "FAILED")]]


def summary(log: DataFrame) -> DataFrame:
    return log.agg(*status_counts(F.col("status")))


MODES = ["validate", "prepare", "run"]
#: Counters of a report and the first mode that gets as far as them.
COUNTERS = {"total": "validate", "valid": "validate", "invalid": "validate", "duplicates": "validate", "processed": "prepare", "successful": "run", "failed": "run", "skipped": "run"}


def counters() -> list[Column]:
    """The counters of tagged rows (duplicate, errors, outcome) that have gone through all stages."""
    duplicate, errors, outcome = F.col("duplicate"), F.col("errors"), F.col("outcome")
    valid = ~duplicate & (errors == 0)
    found = {
        "total": F.count("*"), "valid": F.count_if(valid), "invalid": F.count_if(~duplicate & (errors > 0)), "duplicates": F.count_if(duplicate), "processed": F.count_if(valid),
        "successful": F.count_if(valid & (outcome == "posted")), "failed": F.count_if(valid & (outcome == "failed")), "skipped": F.count_if(valid & (outcome == "cancelled")),
    }
    return [c.alias(name) for name, c in found.items()]


def reached(name: str, mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(mode)
    return MODES.index(mode) >= MODES.index(COUNTERS[name])


def batch_report(rows: DataFrame, mode: str = "run", runtime: float | None = None) -> DataFrame:
    """One row, with runtime (seconds) if it is given, over tagged rows (duplicate, errors, outcome): validate stops at validity, prepare at processing, run goes through."""
    kept = [name for name in COUNTERS if reached(name, mode)]
    found = rows.agg(*counters()).select(*[F.col(c) if c in kept else F.lit(0).cast("long").alias(c) for c in COUNTERS])
    return found if runtime is None else found.withColumn("runtime", F.lit(float(runtime)))


def observed_reports(rows: DataFrame, write: Callable[[DataFrame], None], modes: list[str] = MODES) -> DataFrame:
    """The reports of several modes (run_id, counters, runtime in seconds) of one pass: rows are counted while write() takes them to their sink."""
    for mode in modes:
        reached("total", mode)
    seen, began = Observation(), time.monotonic()
    write(rows.observe(seen, *counters()))
    took, found = time.monotonic() - began, seen.get
    reports = [(mode, *[found[c] if reached(c, mode) else 0 for c in COUNTERS], took) for mode in modes]
    return rows.sparkSession.createDataFrame(reports, "run_id string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", runtime double")


def preview(features: Column, highlights: Column, images: Column) -> dict[str, Column]:
    return {
        "first_features": F.array_join(F.slice(features, 1, 3), ", "),
        "n_features": F.size(features).cast("long"),
        "first_highlights": F.array_join(F.slice(highlights, 1, 2), ", "),
        "n_images": F.size(images).cast("long"),
    }
