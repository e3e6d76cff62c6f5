"""Chat formatting: exact round trips and digests against plain code."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forecourt.llm import chat, queries
from tests.llm.cases import DATA

CONTROLS = list(chat.INSTRUCT.controls)
PIECES = [*CONTROLS, "\\", "<", "[", "/", ">", "]", "s>", "INST]", "<\\s>", "[\\\\/INST]", " ", "\n", "é", "😀", "word", "|role|", "SYS>>", ""]


def random_text(r, most=12):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, most)))


def digests(rows):
    """Per conversation: turns, their digest, characters under the loss, their digest; rows: (conv_id, turn, role, text)."""
    out = {}
    for c, _, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        n, turns, loss = out.get(c, (0, "", ""))
        out[c] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + (text or "" if role == "assistant" else ""))
    return {c: (n, hashlib.sha256(t.encode()).hexdigest(), len(x), hashlib.sha256(x.encode()).hexdigest()) for c, (n, t, x) in out.items()}


def test_escapes_are_reversible_and_leave_no_control_string():
    r = random.Random(1)
    texts = [random_text(r) for _ in range(3000)] + CONTROLS + [c[0] + "\\" * k + c[1:] for c in CONTROLS for k in range(4)]
    for text, written in zip(texts, chat.INSTRUCT.escape(pa.array(texts, pa.large_string())).to_pylist()):
        assert not any(c in written for c in CONTROLS), text
        assert chat.INSTRUCT.unescape(written) == text
    assert chat.INSTRUCT.escape(pa.array(["</s>", "<\\/s>", "a < b"], pa.large_string())).to_pylist() == ["<\\/s>", "<\\\\/s>", "a < b"]


def test_turns_are_read_back_whatever_they_hold():
    r = random.Random(2)
    for _ in range(400):
        turns = [(r.choice(["user", "assistant", "system", "", "tool", random_text(r)]), random_text(r)) for _ in range(r.randint(1, 6))]
        roles, texts = (pa.array(x, pa.large_string()) for x in zip(*turns))
        buffer, ends, points, before, chars = chat.assemble(roles, texts, chat.INSTRUCT)
        written = buffer.to_pybytes().decode()
        assert list(chat.INSTRUCT.turns(written)) == turns and ends[-1] == len(buffer) and points.sum() == len(written)
        at = np.cumsum(points) - points + before
        assert [chat.INSTRUCT.unescape(written[a : a + n]) for a, n in zip(at, chars)] == [t for _, t in turns]


@pytest.mark.parametrize("window", [7, 64, 4 << 20])
def test_scatter_equals_copying_one_by_one(monkeypatch, window):
    monkeypatch.setattr(chat, "PART_BYTES", window)
    r = np.random.default_rng(3)
    pool, lengths = r.integers(0, 255, 500, dtype=np.uint8), r.integers(0, 30, 200)
    sources, gaps = r.integers(0, 470, 200), r.integers(0, 3, 200)
    starts = np.cumsum(lengths + gaps) - lengths
    got, want = (np.zeros(starts[-1] + 40, np.uint8) for _ in range(2))
    chat.scatter(got, starts, lengths, pool, sources)
    for a, n, s in zip(starts, lengths, sources):
        want[a : a + n] = pool[s : s + n]
    assert (got == want).all()


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, "before all"), (2, 5, "assistant", "</s>"), (2, 5, "assistant", "</s>"), (2, 4, "tool <s>", "x\\</s>"),
    (None, 1, "user", "nobody's"), (None, 0, "assistant", "nobody's"), (3, 0, "assistant", "long " * 40_000), (4, 0, "", ""),
]


@pytest.mark.parametrize("part_bytes", [200, 4 << 20])
def test_odd_conversations(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "whole": F.lit(1), "loss": F.lit(2)})
    got = {x.conv_id: tuple(x)[1:5] for x in chat.chat_digests(rows).collect()}
    assert got == digests(ODD + chat.PROBE)
    assert chat.format_chats(rows.limit(0)).count() == 0 and [x.conv_id for x in chat.chat_digests(rows.limit(0)).collect()] == [-1]


def test_a_conversation_over_several_tasks(spark):
    """One conversation holds half of all rows: no task formats all of it, its digest is that of the whole."""
    r = random.Random(5)
    rows = [(7, t, "assistant" if t % 2 else "user", random_text(r, 30)) for t in range(4000)] + [(c, t, "user", "x" * 40) for c in range(8, 1008) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    parts = chat.format_chats(table)
    # As on a cluster, where ranges are too large to be joined again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = parts.where("conv_id = 7").select(F.shiftright("part", 33)).distinct().count()
        check_parts(parts, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def check_parts(parts, rows):
    assert parts.where("conv_id = 7 AND whole").count() == 0 and parts.where("conv_id > 7 AND whole").count() > 980
    assert parts.agg(F.sum("n_turns")).first()[0] == len(rows)
    got = {x.conv_id: tuple(x)[1:5] for x in chat.digests(parts).collect()}
    assert got == digests(rows)


def test_small_batches_and_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 300)
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant"]), random_text(r)) for c in range(60) for t in range(r.randint(1, 40))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {x.conv_id: tuple(x)[1:5] for x in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == digests(rows + chat.PROBE)


def test_query_over_the_smallest_table(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op11_chat_format"](spark, str(DATA))
    assert found.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {x.conv_id: tuple(x)[1:5] for x in found.collect()} == digests(rows + chat.PROBE)
