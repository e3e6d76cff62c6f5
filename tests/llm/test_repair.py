"""Conversation repair: the search against all edits and against a plain search, the query against plain code."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from forecourt.llm import queries, repair
from tests.llm.cases import DATA

GOOD = re.compile("(s?(ua)+)?")
PRICE = {"K": 0, "R": 3, "D": 4, "I": 3}
SCHEMA = "conv_id long, turn long, role string, text string"


def of_all_edits(rows):
    """The cheapest of all sequences with up to two inserted rows in a place; rows: (letter, must go, truncated)."""
    best = None
    inserts = [list(itertools.product("ua", repeat=k)) for k in range(3)]
    for edits in itertools.product(*[["D"] if gone else ["D", "K", "Ru", "Ra"] for _, gone, _ in rows]):
        for places in itertools.product(range(3), repeat=len(rows) + 1):
            cost = sum(PRICE[e[0]] + (3 if cut and e != "D" else 0) for e, (_, _, cut) in zip(edits, rows)) + 3 * sum(places)
            audit = "".join("I" * k + (edits[i][0] if i < len(rows) else "") for i, k in enumerate(places))
            if best is not None and (cost, audit) >= best:
                continue
            for made in itertools.product(*[inserts[k] for k in places]):
                made_of = "".join("".join(m) + ("" if i == len(rows) or edits[i] == "D" else rows[i][0] if edits[i] == "K" else edits[i][1]) for i, m in enumerate(made))
                if GOOD.fullmatch(made_of):
                    best = (cost, audit)
                    break
    return best


def one_way(rows, start=0, ends=(0, 3)):
    """Uniform-cost search by (cost, letters)."""
    heap, done = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if i == len(rows) and s in ends:
            return cost, audit
        if (i, s) in done:
            continue
        done.add((i, s))
        made = {0: 2, 1: 2, 2: 3, 3: 2}[s]
        heapq.heappush(heap, (cost + 3, audit + "I", i, made))
        if i < len(rows):
            letter, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s))
            if not gone:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, made))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, letter))
                if kept is not None:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, kept))
    return None


def random_rows(r, n):
    return tuple((r.choice("suauauaux"), r.random() < 0.15, r.random() < 0.2) for _ in range(n))


def test_search_finds_the_cheapest_of_all_edits():
    r = random.Random(1)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 2, 2, *[3] * 25]:
        rows = random_rows(r, n)
        assert repair.cheapest(rows, 0, (0, 3)) == of_all_edits(rows), rows


def test_search_from_both_ends_equals_one_from_the_start():
    r = random.Random(2)
    for _ in range(1500):
        rows = random_rows(r, r.randint(0, 14))
        start, ends = r.choice([(0, (0, 3)), (r.randint(0, 3), (r.randint(0, 3),))])
        assert repair.cheapest(rows, start, ends) == one_way(rows, start, ends), (rows, start, ends)
    rows = random_rows(r, 700)
    assert repair.cheapest(rows, 0, (0, 3)) == one_way(rows)


def blank(text):
    return not re.search(r"[^\x20\x09-\x0D]", text)


def plain(rows, damaged):
    """conv_id → the query's other columns; rows: (conv_id, turn, role, text) without two texts of a role in a turn."""
    out = {}
    for conv in dict.fromkeys(x[0] for x in rows):
        own = []
        for _, turn, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0)):
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            role, text = (" " if v is None else v for v in (role, text))
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        faults, seen = [], set()
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = one_way([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(own, faults)])
        done, left, state = [], list(own), ""
        for e in audit:
            if e != "I":
                _, role, text = left.pop(0)
            if e == "K":
                done.append((role, text))
            elif e in "RI":
                made = "assistant" if done and done[-1][0][:1] == "u" else "user"
                done.append((made, text if e == "R" else ""))
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in done).encode()).hexdigest()
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def by_id(found):
    rows = found.collect()
    got = {x.conv_id: tuple(x)[1:] for x in rows}
    assert len(got) == len(rows)
    return got


TEXTS = ["Yes.", "No!", "cut", "", " \n", "Why? ", "so.\t\n", "é…", "a\x0b", None]


def conversations(r, n, most):
    rows = []
    for c in range(n):
        turns = sorted(r.sample(range(-3, 3 * most), r.randint(1, most)))
        for i, t in enumerate([None, *turns] if r.random() < 0.1 else turns):
            rows.append((c if c else None, t, r.choice([["user", "assistant"][i % 2]] * 5 + ["system", "tool", "", None, "ursa"]), r.choice([f"Text {r.random()}."] * 4 + TEXTS)))
    return rows


@pytest.mark.parametrize("piece_rows", [1024, 3])
def test_query_equals_plain_code(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    rows = conversations(random.Random(piece_rows), 250, 14)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("copies", "h1", "first", "part", "audit", "again")}).repartition(4)
    found = repair.damaged_repairs(table)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert by_id(found) == plain(rows, True)
    assert repair.damaged_repairs(table.limit(0)).count() == 0


def test_conversations_over_several_tasks(spark):
    """Half of all rows are one conversation, an eighth are copies of one row of it: pieces of several tasks are put together."""
    r = random.Random(4)
    rows = [(5, t // 2 if t % 7 else None, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"Text {t}.", "cut", ""])) for t in range(3000)]
    rows = list({x[1:3]: x for x in rows}.values()) + [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(6, 500) for t in range(4)]
    hot = [x for x in rows if x[0] == 5]
    assert len({(x[1], x[2]) for x in hot}) == len(hot)
    rows = [(5, i if x[1] is not None else None, *x[2:]) for i, x in enumerate(sorted(hot, key=lambda x: (x[1] is not None, x[1] or 0, x[2])))] + rows[len(hot) :]
    rows = [x for x in rows if x[1] is not None] + [(5, None, "user", "First.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, SCHEMA).repartition(3)
        pieces = repair.pieces(repair.searched(repair.damage(table))).where("conv_id = 5").select(F.shiftright("part", 33).alias("task"), "whole").collect()
        assert len({p.task for p in pieces}) > 1 and not any(p.whole for p in pieces)
        assert by_id(repair.damaged_repairs(table)) == plain(rows, True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_and_turns(spark):
    """Equal rows of a turn are copies; texts of one role and turn come in some order, always the same."""
    rows = [(1, 0, "user", "Hi.")] * 4 + [(1, 1, "assistant", "Yes.")] * 2 + [(2, 0, "user", "One."), (2, 0, "user", "Two.")]
    table = spark.createDataFrame(rows, SCHEMA)
    undamaged = table.withColumn("copies", F.lit(1))
    got = by_id(repair.repair_digests(undamaged))
    assert got[1][:7] == (0, 0, 4, 0, 4, 16, "KDDDKD") and got[2][:7] == (0, 0, 0, 0, 1, 3, "KR")
    assert got == by_id(repair.repair_digests(undamaged.repartition(3)))
    turns = {(x.conv_id, x.place): (x.role, x.text) for x in repair.repaired_turns(table).collect()}
    assert turns[1, 0] == ("user", "Hi.") and turns[1, 1] == ("assistant", "Yes.") and len([k for k in turns if k[0] == 1]) == 2


def test_query_over_the_smallest_tables(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    for d in (DATA, DATA.parent / "sf0.01"):
        rows = [tuple(x) for x in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert by_id(queries.QUERIES["op13_conversation_repair"](spark, str(d))) == plain(rows, True)
