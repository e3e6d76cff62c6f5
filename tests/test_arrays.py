"""JSON arrays read in splits, against whole-file parsing; stores that can't be read."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.operators import filters
from forecourt.plans import queries
from forecourt.sources import arrays, feeds

TEXT = T.StringType()
INNER = T.StructType().add("a", TEXT).add("b", T.StructType().add("c", TEXT))
SCHEMA = T.StructType().add("id", TEXT).add("title", TEXT).add("images", T.ArrayType(TEXT)).add("more", INNER)
SIGNS = ["{", "}", "},{", "[", "]", '"', "\\", '\\"', "\\\\", "é", "\n", ",", ":", "a", "word", " "]


def random_array(r, n):
    text = lambda: "".join(r.choice(SIGNS) for _ in range(r.randint(0, 9)))
    return [{"id": str(i), "title": text(), "images": [text() for _ in range(r.randint(0, 3))], "more": {"a": text(), "b": {"c": text()}}} for i in range(n)]


def plain(rows):
    return sorted((x.file.rsplit("/", 1)[-1], x.pos, x.id, x.title, x.images, x.more.a, x.more.b.c) for x in rows)


@pytest.mark.parametrize("split", [40, 333, 1 << 27])
def test_arrays_in_splits_equal_the_whole(spark, tmp_path, split):
    r, want = random.Random(split), []
    for name in ("a.json", "b.json", "c.json"):
        array = random_array(r, 25)
        written = json.dumps(array, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)
        (tmp_path / name).write_text(r.choice(["", "\n ", "﻿"]) + written + r.choice(["", "\n\n"]), encoding="utf-8")
        want += [(name, i, x["id"], x["title"], x["images"], x["more"]["a"], x["more"]["b"]["c"]) for i, x in enumerate(array)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        splits = arrays.chunks(spark, [str(tmp_path)]).select("file", "block").distinct().count()
        got = plain(arrays.json_array_feed(spark, str(tmp_path), SCHEMA).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want) and (splits > 30 if split < 400 else splits >= 3)


@pytest.mark.parametrize(("split", "batch"), [(1500, 3), (1 << 27, 4)])
def test_records_go_over_batches_and_splits(spark, tmp_path, split, batch):
    """Deep records of more chunks than a batch has, next to files of one split; texts aren't shuffled, but for the ends of splits."""
    r, want = random.Random(batch), []
    for name, n in (("a.json", 12), ("b.json", 1), ("c.json", 7)):
        array = random_array(r, n)
        for x in array:
            x["rest"] = [{"k": "}" * r.randint(0, 9)} for _ in range(r.randint(0, 9))]
        (tmp_path / name).write_text(json.dumps(array), encoding="utf-8")
        want += [(name, i, x["id"], x["title"], x["images"], x["more"]["a"], x["more"]["b"]["c"]) for i, x in enumerate(array)]
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 1, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    for key, value in conf.items():
        spark.conf.set(key, str(value))
    try:
        rows = arrays.json_array_feed(spark, str(tmp_path), SCHEMA)
        got, plan = plain(rows.collect()), rows._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        with pytest.raises(Exception, match="other splits than at first"):  # never a wrong result
            rows.select("*").collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert got == sorted(want)
    assert not [x for x in plan.splitlines() if ("Window" in x or "Aggregate" in x) and "value" in x], plan


BAD = {
    "cut.json": '[{"id": "1"}, {"id": "2', "object.json": '{"id": "1"}', "none.json": " [ ] ", "open.json": '[{"id": "1"}', "twice.json": '[{"id": "1"}]]',
    "text.json": '[{"id": "1}]', "deep.json": '[{"id": {"a": "1"}]',
}
PROBLEMS = {"cut.json": "not closed", "object.json": "not an array", "none.json": "empty", "open.json": "not closed", "twice.json": "not closed", "text.json": "not closed", "deep.json": "not closed"}


def test_unreadable_files_and_records_are_set_aside(spark, tmp_path):
    for name, text in BAD.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "nothing.json").write_text("")
    (tmp_path / "good.json").write_text('[{"id": "1"}, {"id" 2}, {}, {"id": "4", "title": null}]')
    rows, quarantine = arrays.tolerant_feed(spark, [str(tmp_path), str(tmp_path / "missing")], SCHEMA)
    assert sorted((x.pos, x.id) for x in rows.collect()) == [(0, "1"), (2, None), (3, "4")]
    got = {(x.file.rsplit("/", 1)[-1], x.pos): x.problem for x in quarantine.collect()}
    assert got == {(k, None): v for k, v in PROBLEMS.items()} | {("good.json", 1): "not a record"}
    none, also = arrays.tolerant_feed(spark, [str(tmp_path / "missing")], SCHEMA)
    assert none.count() == also.count() == 0 and none.columns == rows.columns


@pytest.mark.parametrize("name", list(BAD))
def test_strict_reads_raise(spark, tmp_path, name):
    (tmp_path / name).write_text(BAD[name])
    with pytest.raises(Exception, match="not a filled array"):
        feeds.json_array_feed(spark, str(tmp_path / name)).collect()


def test_links_of_stores(spark, tmp_path):
    (tmp_path / "cars.json").write_text('[{"Source Link": "a", "x": 1}, {"source_url": "b"}, {"source_url": "c", "Source Link": "d"}]')
    (tmp_path / "inventory.json").write_text('[{"source_url": "e"}, {"sou')
    history, quarantine = feeds.seen_links(spark, [str(tmp_path / "cars.json"), str(tmp_path / "inventory.json"), str(tmp_path / "none.json")])
    listings = spark.createDataFrame([(c,) for c in "abcdef"], "source_url string")
    assert sorted(x.source_url for x in filters.not_seen(listings, history).collect()) == ["e", "f"]
    assert [(x.file.rsplit("/", 1)[-1], x.problem) for x in quarantine.collect()] == [("inventory.json", "not closed")]
    assert quarantine.where(F.col("text").isNotNull()).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_listings_are_computed_once_for_all_stores(spark):
    plan = queries.QUERIES["seen_in_stores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "s_suppkey" not in plan  # neither parts nor suppliers are broadcast again
