"""Documents for tests: the smallest table, and one with all odd cases."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

DATA = Path("/root/testdata/sf0.001")

PROSE = "the quick brown fox jumps over the lazy dog and then it rests under an old oak near the river while clouds drift slowly across a wide and quiet evening sky as lamps in far windows start to glow one after another until night has come"
#: Names that operators use inside.
CLASHES = ["fp", "label", "cell", "k1", "k2", "h", "n_words", "row", "part", "nth", "spans", "kept", "copies", "places", "host", "low", "rank", "length", "w", "x"]

EDGES = [
    (1, PROSE),
    (2, PROSE.upper()),
    (3, PROSE + " again"),
    (3, PROSE + " again"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b\x0c\r "),
    (7, "one"),
    (8, "a b c d e a b c d e a b c d e"),
    (9, "line here\nline here\n\nother\nline here"),
    (10, "### $$$ %%% &&& *** ||| <<< >>> word word2"),
    (None, "no id but some words that nobody else has written down before"),
    (None, None),
    (11, "é ü 日本 \xa0 x\xa0y  z 😀 end"),
    (12, (PROSE + " ") * 3),
    (13, "w" * 5000),
    (14, " ".join(f"u{i}" for i in range(3000))),
    (15, "x " + " ".join(f"u{i}" for i in range(100, 160)) + " y"),
]


def edge_documents(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(0) for c in CLASHES}).repartition(3)


def documents(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def python_nodes(df):
    plan = df._jdf.queryExecution().toString()
    return [w for w in ("ArrowEval", "BatchEval", "MapInArrow", "MapInPandas", "FlatMapGroups") if w in plan]
