"""What holds of plans and tasks however large the tables are: rare signatures, stops, positions, one pass, one map."""

import random

import pytest
from pyspark.sql import functions as F

from forecourt.operators import ads, filters, mapping, queue, report


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_gram_pairs_equal_brute_force(spark, hot):
    r = random.Random(hot)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(0, 25))) for _ in range(150)]
    needles = [t[i : i + r.randint(1, 12)] for t in texts if t for i in [r.randrange(len(t))]] + ["zzz", "", "zzzzzzzzzz", "a" * 26]
    got = filters.gram_pairs(column(spark, "h", sorted(set(texts))), column(spark, "n", needles), hot=hot).collect()
    assert sorted((x.h, x.n) for x in got) == sorted((h, n) for h in set(texts) for n in set(needles) if n and n in h)


def test_terms_that_end_alike_are_found_by_their_rarest_gram(spark):
    """2,000 titles and 2,000 terms that all end in "series": no gram of a term is in many titles, and no task gets many rows."""
    titles, terms = column(spark, "h", [f"{i * 7919 % 10007:05d} model series" for i in range(2000)]), column(spark, "n", [f"{i * 7919 % 10007:05d} model series" for i in range(1000, 3000)])
    chosen = filters.signatures(titles, terms, 6, [6]).collect()
    assert len(chosen) == 1000 and max(x.df for x in chosen) == 1 and not any(x.gram in ("series", "eries", "model ") for x in chosen)
    assert filters.gram_pairs(titles, terms).count() == 1000


def test_frequent_grams_are_dealt_in_parts(spark):
    titles = column(spark, "h", [f"common {i}" for i in range(4000)])
    pairs = filters.gram_pairs(titles, column(spark, "n", ["common"]), hot=100)
    assert pairs.count() == 4000
    plan = pairs._jdf.queryExecution().toString()
    assert "_part" in plan


def test_short_targets_are_matched_without_pairs(spark):
    options = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("option "), "id").alias("label"))
    records = spark.createDataFrame([(1, "o"), (2, "on 29"), (3, "ption 2999"), (4, "9"), (5, "x")], "k int, t string")
    found = mapping.loose_option(records, options, ["k"], F.array("t"))
    assert {r.k: r.label for r in found.collect()} == {1: "option 0", 2: "option 29", 3: "option 2999", 4: "option 9", 5: None}


def listings(spark, n=5000):
    r = random.Random(5)
    rows = [(i // 10, i, f"k{r.randrange(n // 2)}", r.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(rows, "page long, pos long, key string, good boolean"), rows


@pytest.mark.parametrize("n", [0, 1, 100, 700, 10**6])
def test_harvest_equals_the_full_sort_and_stops_early(spark, n):
    table, rows = listings(spark)
    asked = []

    def accept(part):
        asked.append(part)
        return filters.first_seen(part.where("good"), "key", ["page", "pos"])

    got = filters.harvest(table, accept, n, ["pos"], "key", start_page=3)
    seen, want = set(), []
    for page, pos, key, good in rows:
        if page >= 3 and good and key not in seen:
            seen.add(key)
            want.append(pos)
    assert sorted(x.pos for x in got.rows.collect()) == want[:n]
    read = sum(x["rows"] for x in got.ranges)
    last = {pos: page for page, pos, _, _ in rows}[want[min(n, len(want)) - 1]] if n else 0
    assert len(asked) == len(got.ranges) + 1 and [x["first"] for x in got.ranges] == [3, *[x["last"] + 1 for x in got.ranges[:-1]]][: len(got.ranges)]
    if n == 0:
        assert read == 0
    elif n < len(want):
        assert read <= 3 * 10 * (last - 2) + 20, got.ranges  # at most three times the rows up to the last one taken
    else:
        assert read == 5000 - 30


def test_harvest_of_nothing_and_of_negative_caps(spark):
    table, _ = listings(spark, 50)
    assert filters.harvest(table.where("false"), lambda x: x, 5, ["pos"], "key").rows.count() == 0
    with pytest.raises(ValueError, match="negative"):
        filters.harvest(table, lambda x: x, -1, ["pos"], "key")


def test_positions_are_dense_over_ranges(spark):
    r = random.Random(7)
    rows = [(r.randrange(40), str(i)) for i in range(3000)]
    table = spark.createDataFrame(rows, "rank int, id string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queue.with_position(table, ["rank"])
        assert got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = sorted((x.pos, x["rank"]) for x in got.collect())
    assert [p for p, _ in found] == list(range(1, 3001)) and [k for _, k in found] == sorted(k for k, _ in rows)
    assert sorted(x.id for x in got.collect()) == sorted(i for _, i in rows)
    assert queue.with_position(table.where("false"), ["rank"]).count() == 0
    assert "Window" not in got._jdf.queryExecution().toString()


def test_three_reports_of_one_pass(spark, tmp_path):
    tagged = spark.range(1000).select((F.col("id") % 10 == 0).alias("duplicate"), (F.col("id") % 3).cast("int").alias("errors"), F.element_at(F.array(*map(F.lit, ["posted", "failed", "cancelled", "?"])), (F.col("id") % 4 + 1).cast("int")).alias("outcome"))
    spark.sparkContext.setJobGroup("reports", "one pass")
    try:
        got = report.observed_reports(tagged, lambda rows: rows.write.parquet(str(tmp_path / "out")))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("reports"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 1000
    for row in got.collect():
        want = report.batch_report(tagged, row.run_id).first()
        assert tuple(row)[1:-1] == tuple(want) and row.runtime > 0
    with pytest.raises(ValueError):
        report.observed_reports(tagged, lambda rows: None, ["sell"])


OPTIONS = [("condition", 0, "Used"), ("condition", 1, "used "), ("colour", 0, 'Odd "one" \\'), ("colour", 1, "White"), ("fuel", 0, "Petrol"), ("tag", 0, "x")]


def test_the_option_map_equals_the_joins(spark, monkeypatch):
    names = ["condition", "transmission", "fuel", "drive_type", "colour", "location", *mapping.COPIED]
    rows = [("https://schema.org/UsedCondition", "m", " PETROL", None, 'odd  "ONE" \\', "here"), ("new", "", None, ".", "WHITE", None), (None,) * 6]
    ads = spark.createDataFrame([(*r, *["v"] * len(mapping.COPIED)) for r in rows], ", ".join(f"{n} string" for n in names))
    options = spark.createDataFrame(OPTIONS, "field string, pos int, label string")
    mapped = mapping.mapped(ads, options)
    assert "Join" not in mapped._jdf.queryExecution().toString()
    by_map = sorted(map(str, mapped.collect()))
    monkeypatch.setattr(mapping, "MOST_IN_MAP", 3)
    joined = mapping.mapped(ads, options)
    assert "Join" in joined._jdf.queryExecution().toString()
    assert sorted(map(str, joined.select(mapped.columns).collect())) == by_map
    assert mapping.mapped(ads, options.where("false")).where("_mapped_fuel <=> _value_fuel").count() == 3


def test_first_rows_are_limited_before_the_shuffle_and_carry_only_what_is_asked_for(spark):
    rows = spark.range(5000).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("pos"), F.repeat(F.lit("x"), 500).alias("wide"))
    rows = rows.withColumn("key", F.when(F.col("pos") % 50 != 0, F.col("key")))
    first = filters.first_seen(rows, "key", ["pos"]).select("key", "pos")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "wide" not in plan and "SortAggregate" not in plan
    got = sorted((r.key or "", r.pos) for r in first.collect())
    assert got == sorted([("", i) for i in range(0, 5000, 50)] + [(str(i % 7), i) for i in range(1, 8)])


def test_terms_of_words_ask_for_the_beginnings_of_words_only(spark):
    texts = column(spark, "h", [f"{i} model {'x' * 300} series" for i in range(20)])
    assert filters.text_grams(texts, [], 6).groupBy("h").count().agg(F.max("count")).first()[0] == 3  # not some 300
    got = filters.gram_pairs(texts, column(spark, "n", ["7 model", "odel x"]))  # one of these has no beginning: every place counts
    assert sorted((r.h.split()[0], r.n) for r in got.collect()) == sorted([("7", "7 model"), ("17", "7 model")] + [(str(i), "odel x") for i in range(20)])
    plan = filters.gram_pairs(texts, column(spark, "n", ["7 model xx"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "sequence(" not in plan


@pytest.mark.parametrize("limit", [1000, 0])
def test_listings_are_not_shuffled_by_title(spark, limit):
    rows = spark.range(3000).select("id", F.concat(F.lit("199"), (F.col("id") % 10).cast("string"), F.lit(" model series")).alias("title"))
    kept = filters.exclude_by_title(rows, column(spark, "term", ["1993 model", "1995 model series and more"]), theta_terms=limit)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Range") == 1
    assert kept.count() == 2400


def test_a_payload_cleans_each_field_once_and_makes_no_row_of_a_slot(spark):
    texts = [None, "", " ", ".", " . ", "..", "a", " a", "a.", " a b ", "é", " é ", "\x1fx", "a\n", "\n.\n", "R 1", "R 12 345", "1 ", "12\n3", "R", "1,5", "١"]
    rows = spark.createDataFrame([(str(i), t, t) for i, t in enumerate(texts)], "source_id string, title string, price string")
    made = ads.payload(ads.canonical(rows))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(title") == 1 and "struct(" not in plan
    got = {(int(r.source_id), r.name): (r.slot, r.value) for r in made.collect()}
    for i, t in enumerate(texts):
        title = (t or "").strip()
        title = "Used Car" if title in ("", ".") else title
        digits = (t or "").replace("R", "").replace(" ", "").strip()
        price = digits if digits.isascii() and digits.isdigit() else "0"
        want = {"title": (0, title), "variant": (1, title), "top_condition": (2, "Used"), "price": (19, price), "description": (21, title)}
        assert {k: got[i, k] for k in want} == want, t
    assert len(got) == 22 * len(texts)
