"""Hand-written cases for the rules of the listing engine."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from forecourt.functions import exprs
from forecourt.operators import ads, extract, filters, mapping, queue, report
from forecourt.sources import feeds, sinks
from forecourt.sources.schemas import POSTING_LOG
from forecourt.streaming import ingest


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_and_truthiness(spark):
    assert column(spark, [None, "", " . ", " a ", " b "], lambda c: exprs.clean(c, "?")) == ["?", "?", "?", "a", "b"]
    both = spark.createDataFrame([(".", "x"), ("", "x"), (None, "x"), ("a", "x"), (None, None)], "a string, b string")
    out = [r[0] for r in both.select(exprs.clean(exprs.first_filled(F.col("a"), F.col("b")), "-")).collect()]
    assert out == ["-", "x", "x", "a", "-"]


def test_prices(spark):
    values = ["R 219 900", "R 219 900", "POA", "1,000", "1200.0", None, " R5 ", ""]
    assert column(spark, values, exprs.price_digits) == ["219900", "0", "0", "0", "0", "0", "5", "0"]


def test_match_key_and_capitalize(spark):
    assert column(spark, ["  Weiß  Blau ", None], exprs.match_key) == ["weiss blau", ""]
    assert column(spark, ["frozen WHITE", "", None], exprs.capitalize) == ["Frozen white", "", None]


def test_specs_seats_and_mileage_share_a_token(spark):
    tokens = [["5 seats 100 km", "20 000 km"], ["20 000 km", "5 seats 100 km"], ["airbag 4x4"], None, ["Heated seats", " 5 seater ", "7 Seats", "FROZEN white", "Condition: good", "condition 2"], ["Condition of all that was looked at in it"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t array<string>")
    got = extract.specs(rows, "t").orderBy("i").collect()
    assert [(r.seats, r.mileage) for r in got[:2]] == [("5 seats 100 km", "20 000 km"), ("5 seats 100 km", "20 000 km")]
    assert got[2].drive == "." and got[3].fuel_type == "."
    assert (got[4].seats, got[4].colour, got[4].condition, got[5].condition) == ("5 seater", "Frozen white", "Condition: good", ".")


def test_specs_are_stripped_of_white_space_of_every_kind(spark):
    rows = spark.createDataFrame([(["  manual ", " \t", "", " ", "\u2003white\u00a0", "5 seats  ", "\n 2010", " 90 km "],)], "t array<string>")
    got = extract.specs(rows, "t")
    assert tuple(got.select("transmission", "colour", "seats", "year", "mileage").first()) == ("Manual", "White", "5 seats", "2010", "90 km")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(_plain" in plan  # the pattern for ends runs only where it has to


@pytest.mark.parametrize("seed", range(4))
def test_specs_equal_plain_code(spark, seed):
    """Random tokens, token by token, with the patterns of the survey."""
    r = random.Random(seed)
    words = ["5 seats", "12 Seater", "11 seats", "Heated seats", "seat 4 seats 9 km", "100 km", "20 000\xa0KM", "5 seats 100 km", "1998", "2020 ", " 19999", "Manual", "AUTO", "auto matic", "petrol", "4X4", "awd", "Frozen White",
             "blue", "condition: ok", "Condition report of all that was seen in it", "a\ncondition", "airbag 7 seats", "x" * 40 + " 5 seats", "9 seats\n", "ABS 10 km", "", " \t ", None, "4x2\x1c", "7km", "km", "\u20035 seat\u2003"]
    lists = [[r.choice(words) for _ in range(r.randint(0, 9))] for _ in range(300)] + [None, [], [None]]
    space = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

    def plain(tokens):
        every = [t.strip(space) for t in tokens or [] if t is not None]
        usable = [t for t in every if t and len(t) <= 40 and "\n" not in t and not re.search("bluetooth|aircon|airbag|steering|abs", t, re.I)]
        first = lambda test, skip=-1: next((i for i, t in enumerate(usable) if i != skip and test(t)), -1)
        seats = first(lambda t: re.search(r"\b([1-9]|10|12)\s*(seats|seater|seat)\b", t, re.I))
        at = {
            "seats": seats, "year": first(lambda t: re.fullmatch(r"(19|20)\d{2}", t)), "mileage": first(lambda t: re.search(r"\b\d+[\d\s,]*\s*km\b", t, re.I), seats),
            "transmission": first(lambda t: t.lower() in ("manual", "automatic", "auto")), "fuel_type": first(lambda t: t.lower() in ("petrol", "diesel", "hybrid", "electric")),
            "drive": first(lambda t: t.lower() in ("4x2", "4x4", "awd", "fwd", "rwd")), "colour": first(lambda t: t.lower() in extract.COLOURS),
        }
        shown = {s: usable[i] if i >= 0 else "." for s, i in at.items()}
        for s in ("transmission", "fuel_type", "drive", "colour"):
            shown[s] = shown[s].lower() if s == "drive" and shown[s].lower().startswith("4x") else shown[s].capitalize()
        stated = next((t for t in every if "condition" in t or "Condition" in t), None)
        return shown | {"condition": stated if stated is not None and len(stated) < 35 and "\n" not in stated else "."}

    rows = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>")
    for x in extract.specs(rows, "t").collect():
        assert {k: v for k, v in x.asDict().items() if k not in ("i", "t")} == plain(lists[x.i]), lists[x.i]


def test_page_fields(spark):
    html = (
        '<html><body><div class="card sponsored">x<a href="/for-sale/used/1">s</a></div><article><a href="/for-sale/used/2019-R5-/77">l</a></article>'
        "<h1>Toyota\n Corolla 1.8 </h1><script>no</script><p>One &amp;lt; <b>two</b></p></body></html>"
    )
    pages = spark.createDataFrame([(1, "https://h.example.com/a/77/", html), (2, "https://h.example.com/none", "<a href='/x'>x</a>")], "page_id long, url string, html string")
    assert [tuple(r) for r in extract.listing_links(pages, within="/for-sale/used/").collect()] == [(1, 1, "https://h.example.com/for-sale/used/2019-R5-/77")]
    assert [tuple(r) for r in extract.title_variant(pages).orderBy("page_id").collect()] == [(1, "Toyota", "Corolla 1.8"), (2, ".", ".")]
    ids = [r[0] for r in pages.orderBy("page_id").select(extract.listing_id(F.col("url"))).collect()]
    assert ids[0] == "77" and len(ids[1]) == 32
    assert "One &lt; two" in [r.line for r in feeds.page_lines(pages).collect()]
    assert "sponsored" not in " ".join(r.block for r in extract.blocks(pages).collect())


def test_url_fields(spark):
    urls = ["https://x/1998-a-R200-Gauteng-Benoni/9", "https://x/a-b/"]
    assert column(spark, urls, extract.year_from_url) == ["1998", "."]
    assert column(spark, urls, extract.price_from_url) == ["200", "0"]
    assert column(spark, urls, extract.location_from_url) == ["Benoni, Gauteng", "."]
    assert column(spark, ["https://x/a-Western-Cape-Bellville/7"], extract.location_from_url) == ["Bellville, Western Cape"]
    assert column(spark, ["x 4X4 y", "4x2", "none"], lambda c: extract.drive_from(F.lit("https://x/A"), c)) == ["4x4", "4x2", "."]
    assert column(spark, [" \n Dealer A \nline", "x" * 100, "", None], lambda c: extract.dealer(c, F.lit(" B \nb"))) == ["Dealer A", "B", "B", "B"]
    assert column(spark, ["Location Main Road 1", " Distance From You ", "."], lambda c: extract.address(c, F.lit("https://x/a-Free-State-Bethlehem/7"))) == ["Main Road 1", "Bethlehem, Free State", "Bethlehem, Free State"]


def test_text_fields(spark):
    assert column(spark, ["a 4.8 (630 reviews)", "x 4.8 y 630 reviews", "none", None], extract.rating) == ["4.8 (630 reviews)", "4.8 (630 reviews)", ".", "."]
    rated = ["4.8 (630 Reviews)", "4.8 (1 630 reviews)", "3.2 litre / 4.8\n1 630 reviews", "4.8\n630 REVIEW", "6.1 of 12 reviews"]
    assert column(spark, rated, extract.rating) == ["4.8 (630 Reviews)", "4.8 (1 630 reviews)", "4.8 (1 630 reviews)", "4.8 (630 REVIEW)", "."]
    assert column(spark, ["+27 (011) 555-12345", "12"], extract.phone) == ["2701155512", "."]
    assert column(spark, ["R 9 999", "R 12", None], lambda c: extract.price_of_block(F.lit("Track price R 5 000"), F.lit("https://x/a-R777-b/1"), c)) == ["9999", "777", "777"]
    assert column(spark, ["Fair deal", "R 5 000\nRecalculate"], extract.price_summary) == [".", "R 5 000"]
    assert column(spark, [" a \n\nShow more\nb"], extract.description) == ["a\nb"]
    assert column(spark, ["R 12\nEst. R 90 000\nR 123 456\nfair deal R 99 999"], extract.price_of_block) == ["123456"]
    assert column(spark, [["ab", "abc", "ABS", "abc", "Safety", "x\nyz"]], extract.features, "array<string>") == [["abc", "ABS"]]
    assert column(spark, [["http://a.svg", "http://a.svg?x", "http://a", "b", "http://a", "http://c.SVG"]], extract.images, "array<string>") == [["http://a.svg?x", "http://a", "http://c.SVG"]]
    tags = '<img src="http://a"><img class="x" data-src="http://b"/><img src="" data-src="http://c"><img data-src="http://d" src="http://e"><img alt="no">'
    assert column(spark, [tags], extract.page_images) == [["http://a", "http://b", "http://c", "http://e"]]


TERMS = ["2019 mercedes-benz glc", "2018 toyota corolla", "2017 kia", "kia"]


@pytest.mark.parametrize("limit", [1000, 0])
def test_exclusions_agree_by_theta_and_grams(spark, limit):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    rows = [("u/2019-Mercedes-Benz-GLC-x", "Toyota"), ("u/2018-toyota-corolla-2", "a 2018  Toyota Corolla"), ("u/z", ""), (None, None), ("u/ok", "something else"), ("u/2017-KIA", "2017")]
    listings = spark.createDataFrame(rows, "source_url string, title string")
    by_url = {r.source_url for r in filters.exclude_by_url(listings, terms, theta_terms=limit).collect()}
    assert by_url == {"u/2019-Mercedes-Benz-GLC-x", "u/z", None, "u/ok"}
    hyphens = {r.source_url for r in filters.exclude_by_url(listings, terms, normalize_hyphens=True, theta_terms=limit).collect()}
    assert "u/2019-Mercedes-Benz-GLC-x" not in hyphens
    assert {r.title for r in filters.exclude_by_title(listings, terms, theta_terms=limit).collect()} == {"something else"}


def test_first_seen_history_gate_caps(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "source_url string, pos int")
    assert sorted(str(tuple(r)) for r in filters.first_seen(rows, "source_url", ["pos"]).collect()) == ["('a', 1)", "('b', 3)", "(None, 4)"]
    keyless = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("a", 2)], "source_url string, pos int")
    assert sorted(str(tuple(r)) for r in filters.first_seen(keyless, "source_url", ["pos"]).collect()) == ["('a', 2)", "(None, 1)", "(None, 1)"]
    history = spark.createDataFrame([("a", None)], "link string, source_url string")
    assert {r.source_url for r in filters.not_seen(rows, history).collect()} == {"b", None}
    gate = spark.createDataFrame(
        [(1, ["i"] * 4, ["f"], ["h"]), (2, ["i"] * 5, ["."], ["h"]), (3, ["i"] * 5, ["f"], None), (4, ["i"] * 5, ["f"], ["h"])],
        "k int, images array<string>, features array<string>, highlights array<string>",
    )
    got = gate.select("k", filters.skip_reason(F.col("images"), F.col("features"), F.col("highlights"))).orderBy("k").collect()
    assert [r[1] for r in got] == ["images", "features", "highlights", None]
    assert filters.batch_cap(rows, 0, ["pos"]).count() == 4 and filters.batch_cap(rows, 2, ["pos"]).count() == 2
    with pytest.raises(ValueError):
        filters.batch_cap(rows, -1, ["pos"])


def test_canonical_ad(spark):
    rows = spark.createDataFrame(
        [("1", ".", "GLX", "R 5 000", ["a ", "", "b"], "u", [f"{i}.jpg" for i in range(7)])],
        "id string, `title description` string, variant string, price string, features array<string>, `Source Link` string, images array<string>",
    )
    ad = ads.canonical(rows.withColumn("title", F.lit(None).cast("string"))).first().asDict()
    assert len(ad) == 34
    both = spark.createDataFrame([("A", "B", [], "h1"), ("", "B", ["x", " y "], "h1"), (None, None, None, None)], "id string, source_id string, `vehicle highlights` array<string>, highlights string")
    assert [(r["source_id"], r["vehicle highlights"], r["features"]) for r in ads.canonical(both).collect()] == [("A", "h1", ""), ("B", "x\ny", ""), (".", ".", "")]
    assert ad["source_id"] == "1" and ad["variant"] == "Used Car" and ad["price"] == "5000" and ad["features"] == "a\nb"
    assert ad["Source Link"] == ad["source_url"] == "u" and len(ad["images"]) == 5 and ad["currency"] == "R (Rand)"
    slots = ads.payload(ads.canonical(rows)).orderBy("slot").collect()
    assert len(slots) == 22 and [s.name for s in slots][2::7] == ["top_condition", "bottom_condition", "source_link"] and slots[2].value == "Used" and slots[9].value == "."
    assert [s.name for s in slots][10:17] == ["seats", "pricing_summary", "dealer_name", "dealer_address", "dealer_rating", "contact_number", "source_link"]
    assert ads.with_categories(ads.canonical(rows)).select("category_1", "category_2", "category_3").first() == ("Vehicles", "Cars - Parts", "Used cars in South Africa")


def test_images(spark):
    listed = spark.createDataFrame([("a", 0, "a2"), ("a", 1, "gone"), ("a", 2, "a1"), ("b", 0, "gone")], "source_id string, pos int, path string")
    files = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b2"), ("b", "b1")], "source_id string, path string")
    assert {r.source_id: r.images for r in ads.resolve_images(listed, files).collect()} == {"a": ["a2", "a1"], "b": ["b1", "b2"]}


def test_mapping(spark):
    options = spark.createDataFrame([("colour", 0, "WHITE"), ("colour", 1, "white "), ("currency", 0, "Rs"), ("currency", 1, "Rand (R)")], "field string, pos int, label string")
    valued = spark.createDataFrame([("a", 0, "Rs", "x"), ("a", 1, "Other", "myZAR"), ("a", 2, "Rand", None), ("b", 0, " R ", None), ("c", 0, "Euro", "eur")], "form string, pos int, label string, value string")
    assert sorted(map(tuple, mapping.currency_option(valued, ["form"]).collect())) == [("a", "Other"), ("b", " R ")]
    by_value = mapping.loose_option(spark.createDataFrame([(1, "EUR"), (2, "eu")], "k int, t string"), valued.where("form = 'c'"), ["k"], F.array("t"))
    assert {r.k: r.label for r in by_value.collect()} == {1: "Euro", 2: "Euro"}
    rows = spark.createDataFrame([(1, " White"), (2, "."), (3, None)], "k int, v string")
    got = {r.k: r.m for r in mapping.map_option(rows, options, "colour", F.col("v"), "m").collect()}
    assert got == {1: "WHITE", 2: None, 3: None}
    assert mapping.currency_option(options.where("field = 'currency'").withColumn("value", F.lit(""))).first()[0] == "Rand (R)"
    errors = rows.select("k", mapping.source_errors({"colour": F.col("v")}, {"colour": F.when(F.col("k") == 1, "WHITE")}).alias("e")).orderBy("k").collect()
    assert [r.e for r in errors] == [[], ["No target option for colour: ."], ["Missing source field: colour"]]
    assert column(spark, ["https://schema.org/UsedCondition", "x"], mapping.schema_org_condition) == ["Used", "x"]
    loose = mapping.loose_option(rows, options, ["k"], F.array(F.lit("RAND")))
    assert {r.label for r in loose.collect()} == {"Rand (R)"}


def test_queue_and_reports(spark):
    rows = spark.createDataFrame([("1", "Y"), ("2", " yes "), ("3", "n"), ("4", None), (".", None), (None, None)], "source_id string, decision string")
    got = {r.source_id: r.o for r in rows.select("source_id", queue.route(F.col("decision")).alias("o")).collect()}
    assert got["1"] == got["2"] == "posted" and got["3"] == "cancelled" and got["4"] == "waiting"
    done = rows.where("decision IS NOT NULL")
    assert [r.source_id for r in queue.remaining(rows, done).collect()] == ["4"] and queue.keyless(rows).count() == 2
    log = spark.createDataFrame([("posted",), ("POSTED",), ("queued",)], "status string")
    assert tuple(report.summary(log).first()) == (3, 2, 0, 0, 0)
    tagged = spark.createDataFrame([(False, 0, "posted"), (True, 0, "posted"), (False, 2, None)], "duplicate boolean, errors int, outcome string")
    assert tuple(report.batch_report(tagged).first()) == (3, 1, 1, 1, 1, 1, 0, 0)
    assert tuple(report.batch_report(tagged, "validate").first()) == (3, 1, 1, 1, 0, 0, 0, 0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "cars.json").write_text('[{"id": "1", "title": "a"}, {"id": "2", "features": ["x"]}]')
    feed = feeds.json_array_feed(spark, str(tmp_path / "cars.json")).orderBy("pos").collect()
    assert [(r.pos, r.id, r.title) for r in feed] == [(0, "1", "a"), (1, "2", None)]
    (tmp_path / "bad.json").write_text('{"id": "1"')
    with pytest.raises(Exception, match="not a filled array"):
        feeds.json_array_feed(spark, str(tmp_path / "bad.json")).collect()
    for run, n in (("r1", 2), ("r2", 1), ("r2", 3)):
        sinks.write_snapshot(spark.range(n).toDF("id"), str(tmp_path / "snap"), run)
    assert spark.read.parquet(str(tmp_path / "snap")).groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 3)]
    outcomes = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5, 6), "7", "posted", 'two\nlines, "x"')], "timestamp timestamp, source_id string, status string, reason string")
    sinks.append_log(report.log_rows(outcomes), str(tmp_path / "log"))
    back = feeds.posting_log(spark, str(tmp_path / "log")).first()
    assert back.reason == 'two\nlines, "x"' and back.vehicle_id == "7" and back.make == "" and back.timestamp.microsecond == 0
    sinks.append_titles(spark.createDataFrame([("",), ("t",)], "title string"), str(tmp_path / "titles"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "titles")).collect()) == ["Unknown Title", "t"]
    (tmp_path / "img" / "7").mkdir(parents=True)
    (tmp_path / "img" / "7" / "7_img_1.jpg").write_bytes(b"123")
    assert [(r.source_id, r.length) for r in feeds.image_files(spark, str(tmp_path / "img")).collect()] == [("7", 3)]


def test_streams_equal_batch(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://x/a/{i % 7}", f"<h1>t{i % 7}</h1>") for i in range(20)], "page_id long, url string, html string")
    pages.repartition(5).write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        ingest.ingest_pages(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.source_url for r in got.collect()) == sorted(f"https://x/a/{i}" for i in range(7))
    log = spark.createDataFrame([(datetime.datetime(2024, 1, 1 + i % 3), str(i), "posted" if i % 2 else "x") for i in range(9)], "timestamp timestamp, ad_number string, status string")
    sinks.write_csv(report.log_rows(log), str(tmp_path / "log"))
    q = ingest.running_summary(ingest.log_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("running").first()) == tuple(report.summary(spark.read.schema(POSTING_LOG).option("header", True).csv(str(tmp_path / "log"))).first())


def test_source_audit_of_all_fields(spark):
    raw = spark.createDataFrame([("https://schema.org/UsedCondition", "Manual", "blue", "9 km", "u"), ("Odd", None, "white", None, "u")], "condition string, transmission string, colour string, mileage string, source_url string")
    options = spark.createDataFrame([("condition", 0, "Used"), ("colour", 0, "White"), ("transmission", 0, "Manual"), ("country", 0, "Namibia"), ("drive_type", 0, "4x4")], "field string, pos int, label string")
    got = [r.source_errors for r in mapping.source_audit(ads.canonical(raw), options).orderBy("condition").collect()]
    tail = ["No target option for country: South Africa"]
    assert got == [
        ["No target option for condition: Odd", "No target option for transmission: .", "No target option for drive_type: .", *tail],
        ["No target option for drive_type: .", "No target option for colour: blue", *tail],
    ]
    bare = spark.createDataFrame([(None,) * 11], ", ".join(f"{c} string" for c in ["condition", "transmission", "fuel", "drive_type", "colour", "location", *mapping.COPIED]))
    names = ["condition", "transmission", "fuel", "drive_type", "colour", "country", "title", "description", "price", "mileage", "source_url"]
    assert mapping.source_audit(bare, options).first().source_errors == [f"Missing source field: {f}" for f in names]


def test_dry_run(spark):
    fields = ["condition", "transmission", "fuel", "drive_type", "colour", "location", *mapping.COPIED]
    options = spark.createDataFrame([("condition", 0, "Used"), ("colour", 0, "White")], "field string, pos int, label string")
    good = ("https://schema.org/UsedCondition", "m", "p", "4x4", "white", "here", "t", "d", "1", "2", "u", ["1", "2", "3", "4", "5"])
    bad = (None, "m", "p", "4x4", "blue", "here", "", "d", "1", "2", "u", ["1", "1", "3", "4", "5"])
    few = (*good[:-1], ["1"])
    ads_of = spark.createDataFrame([(1, *good), (2, *bad), (3, *few)], "k int, " + ", ".join(f"{c} string" for c in fields) + ", images array<string>")
    got = {r.k: r for r in mapping.dry_run(ads_of, options).collect()}
    assert (got[1].status, got[1].dry_run, got[1].errors) == ("FORM_FILLED", True, []) and (got[1].mapped.condition, got[1].mapped.colour, got[1].mapped.country) == ("Used", "White", "here")
    assert got[2].errors == ["Missing source field: condition", "No target option for colour: blue", "Missing source field: title", "Missing form field: title", "Form requires five unique images"]
    assert got[2].status == "BLOCKED" and got[2].mapped.title is None and got[2].mapped.colour is None and got[2].source_url == "u"
    assert got[3].errors == ["Exactly five listing images are required", "Form requires five unique images"]


def test_repeated_and_null_page_ids_keep_their_titles(spark):
    pages = spark.createDataFrame([(1, "https://x/1", "<h1>a</h1>"), (1, "https://x/2", "<h1>b</h1>"), (None, "https://x/3", "<h1>c</h1>")], "page_id long, url string, html string")
    assert sorted((r.source_url, r.title) for r in ingest.accepted(pages).collect()) == [("https://x/1", "a"), ("https://x/2", "b"), ("https://x/3", "c")]


def test_thresholds_of_images_and_queue_ids(spark):
    rows = spark.createDataFrame([(1, ["a.JPG", "b.gif"], [1, 52428801]), (2, ["c.webp"], [52428800])], "k int, names array<string>, sizes array<long>")
    rules = filters.content_rules(F.lit("t"), F.lit("1"), F.lit("x" * 50), F.lit(2), F.col("names"), F.col("sizes"))
    assert [r[0] for r in rows.orderBy("k").select(filters.violated(rules)).collect()] == [["image_format", "image_size"], []]
    cars = spark.createDataFrame([("", "7", None, "u"), ("3", "8", "l", "u"), (None, "9", None, None)], "source_id string, id string, `Source Link` string, source_url string")
    assert [(r.queue_id, r.link) for r in queue.identified(cars).collect()] == [("7", "u"), ("3", "l"), ("9", ".")] and queue.left(cars).first()[0] == 3


def test_shared_folder_is_demanded_on_a_cluster():
    from types import SimpleNamespace

    from forecourt.sources import shared

    conf = SimpleNamespace(get=lambda name, default: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)


def test_loose_option_over_many_options(spark):
    options = spark.range(10_001).select(F.col("id").alias("pos"), F.concat(F.lit("Type "), F.col("id") % 50, F.lit(" STEEL")).alias("label"))
    rows = spark.createDataFrame([(1, "7 steel"), (2, ""), (3, "none"), (4, None), (5, "e 12")], "k int, t string")
    got = {r.k: r.label for r in mapping.loose_option(rows, options, ["k"], F.array("t")).collect()}
    assert got == {1: "Type 7 STEEL", 2: "Type 0 STEEL", 3: None, 4: None, 5: "Type 12 STEEL"}
