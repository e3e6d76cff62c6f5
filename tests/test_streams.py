"""Bounded history, windows in event time, state that forgets."""

import datetime

import pytest

from forecourt.operators import report
from forecourt.sources import sinks
from forecourt.streaming import ingest
from forecourt.streaming.history import History

PAGE = "page_id long, url string, html string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, f"<h1>t{i}</h1>") for i, u in enumerate(urls)], PAGE)


def files_read(rows):
    """Files and folders that the scan of a history took, by the metrics of the plan that ran."""
    plan = rows._jdf.queryExecution().executedPlan()
    found = {}

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            metrics = node.metrics()
            if metrics.contains("numPartitions") and "bucket" in node.schema().toString() and "bitmap" not in node.schema().toString():
                found["partitions"] = metrics.apply("numPartitions").value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        return None

    walk(plan)
    return found


def test_a_batch_reads_only_buckets_that_may_hold_its_addresses(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), buckets=32, blocks=4)
    ingest.accept_batch(history, pages(spark, [f"https://x/{i}" for i in range(2000)]), "a", 0)
    assert history.rows().select("bucket").distinct().count() == 32
    batch = pages(spark, [f"https://y/{i}" for i in range(20)] + ["https://x/7", None]).withColumnRenamed("url", "source_url")
    maybe = history.possibly_seen(batch, "a", 1)
    touched = maybe.select("bucket").distinct().count()
    assert 1 <= touched < 8
    seen = history.seen(batch.select("source_url"), "a", 1)
    assert "dynamicpruning" in seen._jdf.queryExecution().executedPlan().toString().lower()
    assert [r[0] for r in seen.collect()] == ["https://x/7"]
    assert files_read(seen) == {"partitions": touched}
    left = history.unseen(batch, "a", 1)
    assert left.count() == 21 and left.where("source_url IS NULL").count() == 1


def test_repeated_batches_and_later_runs_add_nothing(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), buckets=4, blocks=1)
    terms = spark.createDataFrame([("no go",)], "term string")
    batches = [["https://x/1", "https://x/2", "https://x/1", None, "https://x/no-go"], ["https://x/2", "https://x/3"], ["https://x/3"], ["https://x/4", None]]

    def state():
        return sorted((r.batch, str(r.source_url)) for r in history.rows().where("run = 'a'").collect())

    for n, urls in enumerate(batches):
        for _ in range(3):
            ingest.accept_batch(history, pages(spark, urls), "a", n, terms)
    assert state() == [(0, "None"), (0, "https://x/1"), (0, "https://x/2"), (1, "https://x/3"), (3, "None"), (3, "https://x/4")]
    before = state()
    for n, urls in enumerate(batches):
        ingest.accept_batch(history, pages(spark, urls), "b", n, terms)
    assert state() == before and {r.source_url for r in history.rows().where("run = 'b'").collect()} == {None}
    index, _ = history.index("b", 9)
    assert index.count() <= 4 and spark.read.parquet(history.index_path).select("generation").distinct().count() <= 2


def test_index_has_the_bits_of_all_addresses(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), buckets=3, blocks=2)
    for n in range(4):
        ingest.accept_batch(history, pages(spark, [f"https://x/{n}/{i}" for i in range(50)]), "a", n)
    urls = history.rows().select("source_url")
    assert history.possibly_seen(urls, "other", 0).count() == 200 and history.unseen(urls, "other", 0).count() == 0


def write_log(spark, path, days):
    """One file; days: of January 2024."""
    rows = [(datetime.datetime(2024, 1, d, 12, i), f"{d}-{i}", "posted") for i, d in enumerate(days)]
    log = report.log_rows(spark.createDataFrame(rows, "timestamp timestamp, ad_number string, status string"))
    sinks.csv_writer(log.coalesce(1)).mode("append").csv(path)


@pytest.mark.parametrize("runs", [[4], [1, 1, 1, 1], [2, 2]])
def test_late_rows_are_those_that_the_days_leave_out(spark, tmp_path, runs):
    """In one run or in several: every row is counted in its day, waits for it to close, or is listed as late."""
    deliveries = [[1, 2, 3], [1, 5, 6], [1, 2, 5, 9], [1, 6, 8, 12]]
    source, days, late = (str(tmp_path / n) for n in ("log", "days", "late"))
    dropped, at = 0, 0
    for n in runs:
        for delivery in deliveries[at : at + n]:
            write_log(spark, source, delivery)
        at += n
        summary = ingest.keep(ingest.daily_summary(ingest.log_stream(spark, source, 1)), days, f"{days}-at")
        summary.awaitTermination()
        dropped += sum(s["dropped"] for s in ingest.state_sizes(summary))
        ingest.keep_late(ingest.log_stream(spark, source, 1), late, f"{late}-at").awaitTermination()
    listed = ingest.late_rows(spark, late).collect()
    counted = {r.day.day: r.total for r in spark.read.parquet(days).collect()}
    every = [d for delivery in deliveries for d in delivery]
    assert len(listed) > 0 and sum(counted.values()) + len(listed) + sum(d > 10 for d in every) == len(every)
    for day in range(1, 11):
        assert counted.get(day, 0) + sum(r.timestamp.day == day for r in listed) == every.count(day)


def test_no_late_rows_before_there_are_any(spark, tmp_path):
    assert ingest.late_rows(spark, str(tmp_path / "none")).count() == 0


def test_addresses_within_the_watermark_equal_the_exact_way(spark, tmp_path):
    urls = [f"https://x/{i % 40}" for i in range(100)] + [None]
    source = str(tmp_path / "in")
    for _ in range(2):
        pages(spark, urls).repartition(3).write.mode("append").parquet(source)
    query = ingest.keep(ingest.recent_pages(spark, source, files_per_batch=2), str(tmp_path / "out"), str(tmp_path / "at"))
    query.awaitTermination()
    ingest.ingest_pages(spark, source, str(tmp_path / "exact"), str(tmp_path / "exact-at"), files_per_batch=2).awaitTermination()
    exact = {r.source_url for r in spark.read.parquet(str(tmp_path / "exact")).where("source_url IS NOT NULL").collect()}
    recent = [r.source_url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(recent) == len(set(recent)) and set(recent) == exact
    sizes = ingest.state_sizes(query)
    assert max(s["state_rows"] for s in sizes) == 40 and sum(s["rows"] for s in sizes) == 202
