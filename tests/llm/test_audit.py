"""The filter audit against plain code, on odd rows and with sketches of any fill."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from forecourt.llm import audit
from tests.llm import brute
from tests.llm.cases import CLASHES, python_nodes

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """For each of rows (doc_id, source, text) the set of filters that it fails."""
    out = []
    for i, _, text in rows:
        text = text or ""
        w = brute.words(text)
        same = [j for j, _, t in rows if (t or "") == text and j is not None]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j < i for j in same),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def expected(rows, labels):
    fails, out = failures(rows), []
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    for part in {s or "" for _, s, _ in rows}:
        own = [(i, f) for (i, s, _), f in zip(rows, fails) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for n, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [x for x in left if name not in x[1]]
                total[name] += len(gone)
                all_failing = sum(name in f for _, f in own)
                steps.append((part, "".join(order), n, len(left), len(gone), all_failing - len(gone), sum(f == {name} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def random_rows(r, n):
    long = [" ".join(f"w{r.randint(0, 400)}" for _ in range(230)) for _ in range(4)]
    texts = [*long, long[0] + " #", long[1].upper(), "a " * 300, "short", "", None, "Short", "A" * 50]
    return [(r.choice([None, *range(n)]), r.choice([None, "", "s1", "s2", "s2", "s2"]), r.choice([*texts, f"unique {r.random()}"])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "blocks"), [(1, None), (2, 1), (3, 4)])
def test_audit_equals_brute_force(spark, seed, blocks):
    r = random.Random(seed)
    rows = random_rows(r, 150)
    labels = [(r.randint(0, 150), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(0) for c in [*CLASHES, "mask", "maybe", "block", "low", "n"] if c != "part"}).repartition(3)
    found = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")), blocks)
    assert found.columns == COLUMNS and not python_nodes(found)
    assert sorted(map(tuple, found.collect())) == expected(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "s", "x")], "doc_id long, source string, text string")
    assert audit.filter_audit(one, labels).count() == 600


def test_sketch_clears_unique_texts_and_no_other(spark):
    """5,000 texts, 400 of them twice in different tasks: all copies stay possible; few others do; a full sketch clears nothing."""
    texts = [f"text {i}" for i in range(5000)] + [f"text {i}" for i in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    seen = audit.with_possible_repeats(rows, "text").groupBy("maybe").agg(F.collect_set("text").alias("t")).collect()
    maybe = {x.maybe: set(x.t) for x in seen}
    copies = {f"text {i}" for i in range(400)}
    assert copies <= maybe[True] and len(maybe[True]) < 500 and len(maybe[False]) > 4500
    full = audit.repeated_slots(spark.range(200_000).select(F.xxhash64("id").alias("h")), 1)
    bits = sum(bin(b).count("1") for b in full.first().bitmap)
    assert full.count() == 1 and bits > 32_700


def test_sketch_counts_slots_as_plain_code_does(spark):
    hashes = [x.h for x in spark.range(3000).select(F.xxhash64("id").alias("h")).collect()]
    want = {}
    for h in hashes:
        h &= 2**64 - 1
        for s in {h >> 15 * i & 32767 for i in range(3)}:
            want[((h >> 45) % 4, s)] = want.get(((h >> 45) % 4, s), 0) + 1
    found = audit.repeated_slots(spark.createDataFrame([(h,) for h in hashes], "h long").repartition(5), 4).collect()
    got = {(x.block, 8 * k + bit) for x in found for k, byte in enumerate(x.bitmap) for bit in range(8) if byte >> bit & 1}
    assert got == {k for k, n in want.items() if n > 1}


def test_size_of_the_sketch_is_bounded():
    assert audit.blocks_of(0) == 1 and audit.blocks_of(1_000_000) == 512 and audit.blocks_of(10**12) == audit.MOST_BLOCKS
