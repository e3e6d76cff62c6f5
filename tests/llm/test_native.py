"""Quality rules and secret scans, in DataFrame functions."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from forecourt.llm import quality, queries, secrets
from tests.llm import brute
from tests.llm.cases import DATA, documents, edge_documents, python_nodes

ENTRIES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_metrics_equal_brute_force(spark):
    docs = edge_documents(spark)
    got = sorted((tuple(r[c] for c in ENTRIES) for r in quality.quality_rules(docs).collect()), key=str)
    assert got == sorted((tuple(brute.quality(r.text)[c] for c in ENTRIES) for r in docs.collect()), key=str)
    assert not python_nodes(quality.quality_rules(docs))


def test_quality_order_never_changes_the_verdict(spark, monkeypatch):
    docs = documents(spark)
    verdicts = []
    for turn in (False, True):
        monkeypatch.setattr(quality, "ordered", lambda sample, rules, turn=turn: sorted(rules, reverse=turn))
        verdicts.append({r.doc_id: r.kept for r in quality.quality_rules(docs).collect()})
        assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, kept in verdicts[-1].items() if kept}
    assert verdicts[0] == verdicts[1] and 0 < sum(verdicts[0].values()) < len(verdicts[0])


def test_quality_keeps_clean(spark):
    docs = edge_documents(spark).withColumn("more", F.create_map(F.lit("a"), F.lit(1))).withColumnRenamed("x", "a.b")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("text IS NULL").count() == 0
    assert quality.keep_good(docs.limit(0)).count() == 0 and not python_nodes(kept)


CLEAN = " ".join(f"the word{i} of a story{i} and so{i} on." for i in range(30))
REJECTED = {
    "symbols": "### word " * 40, "shouting": CLEAN.upper(), "word_length": "incomprehensibilities-and-more-of-them " * 12, "few_letters": "12 34 the 56 of " * 20,
    "bullets": "\n".join(f"- the item {i} of a list" for i in range(20)), "ellipses": "\n".join(f"the start {i} of a story..." for i in range(20)),
    "no_stop_words": " ".join(f"keyword{i}." for i in range(60)), "few_distinct": "the cat of a dog. " * 40, "digits": "the 12345678901234567890 of " * 9,
    "long_run": CLEAN + " " + "x" * 1000, "no_sentence": CLEAN.replace(".", ""), "placeholder": CLEAN + " Lorem ipsum", "markup": "if (the) { of = a[b]; } " * 10,
    "dup_lines": "\n".join(["the line of all"] * 30),
}


def test_each_rule_rejects_what_it_is_for(spark):
    docs = spark.createDataFrame([*REJECTED.items(), ("clean", CLEAN)], "doc_id string, text string")
    found = quality.rules()
    assert found.keys() == REJECTED.keys()
    rows = {r.doc_id: r for r in quality.base_metrics(docs).select("doc_id", *[c.alias(f"r_{k}") for k, c in found.items()]).collect()}
    for name in found:
        assert rows[name][f"r_{name}"] and not rows["clean"][f"r_{name}"], name


def test_cascade_orders_by_what_the_rules_before_leave(spark):
    rows = spark.range(100).select(F.lit("").alias("text"), "id")
    rules = {"half": F.col("id") < 50, "same_half": F.col("id") < 49, "rest": F.col("id") >= 90, "never": F.lit(False), "cheap_never": F.lit(False)}
    cost = {"half": 1.0, "same_half": 1.1, "rest": 5.0, "never": 2.0, "cheap_never": 1.0}
    assert quality.ordered(rows, rules, cost) == ["half", "rest", "cheap_never", "same_half", "never"]
    dear = {"dear": quality.repeated_words(F.split(F.lit("a b c d e f g a b c d e " * 30), " ")) < F.col("id"), "cheap": F.col("id") < 0}
    assert (measured := quality.costs(rows, dear))["dear"] > measured["cheap"]


def test_sql_of_this_subpackage(spark):
    """Every query that has SQL against DuckDB on the smallest tables."""
    documents(spark)
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, str(DATA))
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall())), name


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.regex) for r in secrets.RULES}
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and frozenset({"api", "pik", "ike", "key"}) in q["assign"]
    assert q["access"] == {frozenset({"aki", "kia"})} and q["hex"] == {frozenset()}
    assert secrets.trigram_query("ab|cdefg") == {frozenset()}
    assert secrets.trigram_query("(?:abc)+x?def") == {frozenset({"abc", "def"}), frozenset({"abc", "xde", "def"})} - {frozenset({"abc", "xde", "def"})}


@pytest.mark.parametrize("seed", range(3))
def test_secrets_equal_brute_force(spark, seed):
    r = random.Random(seed)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", " = ", ":", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef", "x", " ", "é😀", "=", "longvalue-9", "\n", "token=secret:abcdefgh12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(300)] + [None, "", "a" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {x.doc_id: x for x in secrets.secrets(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, joined = brute.base_spans(t)
        assert {k: got[i][k] for k in want} == want, (t, joined, got[i].spans)


@pytest.mark.parametrize("most_buckets", [2000, 0])
def test_postings_and_candidates_equal_brute_force(spark, most_buckets):
    """Rows in several buckets; broadcast and joined bitmaps."""
    r = random.Random(11)
    bits = ["password", "Passwd", "secret", "tok", "en", "api", "_key", "AKIA", "ghp_", "xoxb-", "-----BEGIN", " PRIVATE KEY-----", "AIza", "eyJ", " ", "abc"]
    texts = [(i * 9973, i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(400)]
    frame = spark.createDataFrame(texts, "row long, doc_id long, text string").repartition(3)
    grams = secrets.vocabulary(secrets.RULES)
    index = secrets.postings(frame, grams).collect()
    got = {(x.bucket * 32768 + 8 * k + bit, x.gram) for x in index for k, byte in enumerate(x.bitmap) for bit in range(8) if byte >> bit & 1}
    assert got == {(row, k) for row, _, t in texts for k, g in enumerate(grams) if g in t.lower()}
    rows = {x.row: x for x in secrets.with_candidates(frame, secrets.RULES, most_buckets).collect()}
    for row, _, t in texts:
        for rank, rule in enumerate(secrets.RULES):
            assert rows[row][f"hit{rank}"] == any(all(g in t.lower() for g in x) for x in secrets.trigram_query(rule.regex)), (t, rule.kind)


def test_secrets_in_long_texts_and_of_added_kinds(spark):
    """Added kinds at random places, by the rules' own expressions over the whole text; a text of a million signs."""
    r = random.Random(12)
    made = ["ghp_" + "a1" * 20, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "token=abcdefghij", "AKIA" + "B" * 16, "f" * 40]
    texts = [" ".join(r.choice([*made, "word", "é😀"]) for _ in range(r.randint(0, 9))) for _ in range(150)] + ["lorem " * 170_000 + made[0] + " ipsum" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.secrets(docs).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), k, m.end()) for k, rule in enumerate(secrets.RULES) for m in re.finditer(rule.regex, t, re.A) if m.end(rule.value) - m.start(rule.value) >= rule.least]
        assert got[i] == ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans)), t[:200]


def test_secrets_candidates_lose_no_match(spark):
    """The index's candidates against a full scan by each rule."""
    texts = ["ghp_" + "a1" * 20, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "GHP_" + "Z" * 36, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.secrets(docs).collect()}
    assert [spans[i].split(":")[0] for i in range(7)] == ["github", "slack", "private_key", "google", "jwt", "", ""]
    assert not python_nodes(secrets.secrets(docs)) and secrets.secrets(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "token=abcdefghij")], "doc_id long, text string"))
    assert secrets.secrets(twice).count() == 15
