"""JSON arrays of records of any size, read by as many tasks as their files have splits.

A file is read as chunks that end with a closing brace, in the order of the file. A first pass over them counts, for each split, quotes
and record ends by their depth, both for a split that begins outside and for one that begins inside a text. From these few rows,
prefix sums over the splits of a file give the state in which each split begins, and a second pass cuts records where they are read:
texts aren't shuffled, but for the ends of splits. No task sees more of a file than its split and whole records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import landed

BLANK = r"[\s\x{FEFF}]"
QUOTE, OPENS, CLOSES = b'"{}'
SIGNS = np.isin(np.arange(256), [QUOTE, OPENS, CLOSES])


def sum_before(c: Column) -> Column:
    """Of the rows of a file, those of earlier splits."""
    return F.coalesce(F.sum(c).over(Window.partitionBy("file").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))


def chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, length, alone, value): the texts up to each closing brace, this brace included, as bytes; alone, whether the split is all of its
    file. After the last brace of a file, one is added."""
    read = spark.read.text(paths, lineSep="}")
    of = [F.col(f"_metadata.{c}").alias(name) for c, name in (("file_path", "file"), ("file_block_start", "block"), ("file_block_length", "length"))]
    return read.select(*of, (F.col("_metadata.file_size") == F.col("_metadata.file_block_length")).alias("alone"), F.concat("value", F.lit("}")).cast("binary").alias("value"))


def split() -> Column:
    """One text for all that is the same in a split, as each column costs as much as a chunk on its way to Python."""
    return F.concat_ws(" ", "block", "length", "alone", "file").alias("split")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, bytes, np.ndarray]]:
    """The parts of batches (split, value) that are of one split each: the split, whether it begins there, the values one after the other, and where each ends."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        split, value = batch.column(0), batch.column(1)
        at = np.frombuffer(value.buffers()[1], np.int64 if pa.types.is_large_binary(value.type) else np.int32)[value.offset : value.offset + len(value) + 1]
        data = memoryview(value.buffers()[2])
        other = pc.not_equal(split.slice(1), split.slice(0, len(split) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(split)]
        for i, j in zip(cuts, cuts[1:]):
            own = split[i].as_py()
            yield own, own != last, bytes(data[at[i] : at[j]]), at[i + 1 : j + 1].astype(np.int64) - int(at[i])
            last = own


def signs(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs of text that count, and which of them end a chunk. What a backslash stands before doesn't count."""
    if b"\\" in text:
        text = text.replace(b"\\\\", b"  ").replace(b'\\"', b"  ").replace(b"\\{", b"  ")
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(SIGNS[data])
    return data[at], np.searchsorted(at, ends - 1)


def depths(found: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """After each sign: how much deeper than at first, and whether outside of texts, if the first one is read inside (1) or outside (0) of a text."""
    outside = (np.cumsum(found == QUOTE) + inside) % 2 == 0
    return np.cumsum(np.where(outside, (found == OPENS).astype(np.int64) - (found == CLOSES), 0)), outside


LEVELS = "split string, part long, state long, level long, ends long, deeper long, quotes long, head binary, tail binary"


def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run, and each state (0 outside, 1 inside of a text) in which its split may begin: chunks that end outside by how much deeper they end
    than the split begins. The first row of a run and state has what the whole run adds to depth and quotes, its last chunk, and the split's first."""
    names, kinds = [c.split()[0] for c in LEVELS.split(", ")], [pa.string(), *[pa.int64()] * 6, *[pa.binary()] * 2]
    for part, (split, begins, text, ends) in enumerate(runs(batches)):
        if begins:
            deeper, quotes = [0, 0], 0
        found, last = signs(text, ends)
        own, rows = int((found == QUOTE).sum()), []
        head, tail = text[: ends[0]] if begins else None, text[ends[-2] if len(ends) > 1 else 0 :]
        for state in (0,) if split.startswith("0 ") else (0, 1):  # a file begins outside
            depth, outside = depths(found, (quotes + state) % 2)
            level, of = np.unique(depth[last] + deeper[state], return_inverse=True)
            closed = np.bincount(of, outside[last], len(level))
            for i in range(len(level)):
                rows.append([split, part, state, int(level[i]), int(closed[i]), *([0, 0, None, None] if i else [int(depth[-1]), own, head, tail])])
            deeper[state] += int(depth[-1])
        quotes += own
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


PIECES = "file string, block long, pos long, whole boolean, ended boolean, text binary"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (pos, text) and, at the ends of splits, pieces of them that aren't whole; ended, whether a piece has the record's end. The splits of
    batches begin with the state of the split: whether inside of a text, the depth, the records before."""

    def rows(pos: int, first: bool, ended: bool, text: bytes, cuts: np.ndarray) -> pa.RecordBatch:
        n = len(cuts) - 1
        whole = np.full(n, ended)
        whole[0] &= first
        texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(text)])
        columns = [pa.repeat(file, n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(np.arange(pos, pos + n)), pa.array(whole), pa.repeat(ended, n), texts]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    rest, pos, whole = [], 0, True
    for split, begins, text, ends in runs(batches):
        if begins:
            if rest:
                left = b"".join(rest)
                yield rows(pos, False, False, left, np.array([0, len(left)]))
            inside, deep, pos, block, _, _, file = split.split(" ", 6)
            inside, deep, pos, block = map(int, (inside, deep, pos, block))
            rest, whole = [], block == 0
        found, last = signs(text, ends)
        depth, outside = depths(found, inside)
        ends = ends[(depth[last] + deep == 0) & outside[last]]
        inside, deep = (inside + int((found == QUOTE).sum())) % 2, deep + int(depth[-1])
        if len(ends):
            before, after = sum(map(len, rest)), text[ends[-1] :]
            yield rows(pos, whole, True, b"".join([*rest, text[: ends[-1]]]), np.array([0, *(ends + before)]))
            pos, rest, whole, text = pos + len(ends), [], True, after
        if text:
            rest.append(text)
    if rest:
        left = b"".join(rest)
        yield rows(pos, False, False, left, np.array([0, len(left)]))


@dataclass(frozen=True)
class Arrays:
    """records: (file, pos, text), each the text of one object. files: (file, problem) of all files, problem null for a filled array of objects.

    Spark passes over files of no bytes: they have no records and no problem."""

    records: DataFrame
    files: DataFrame


def splits_of(rows: DataFrame) -> DataFrame:
    """One row (file, block, alone, split, ...) for each split of chunks(): start, whether it begins inside (1) of a text; base, the depth there; before, the records that end before it; and
    (ends, lowest, depth, outside, head, tail): records that end in it, its lowest depth, that after it, whether it ends outside of texts, its first and last chunk."""
    seen = landed(rows.select(split(), "value").mapInArrow(levels, LEVELS), "levels")
    place = F.split("split", " ", 4)
    seen = seen.withColumns({"block": place[0].cast("long"), "alone": place[2] == "true", "file": place[3]})
    start = sum_before(F.when(F.col("state") == 0, F.col("quotes"))) % 2
    own = seen.withColumn("start", start).where("state = start").withColumn("base", sum_before(F.col("deeper")))
    level = F.col("base") + F.col("level")
    splits = own.groupBy("file", "block", "alone", "split", "start", "base").agg(
        F.sum(F.when(level == 0, F.col("ends")).otherwise(0)).alias("ends"), F.min(level).alias("lowest"), (F.col("base") + F.sum("deeper")).alias("depth"),
        ((F.col("start") + F.sum("quotes")) % 2 == 0).alias("outside"), F.max("head").alias("head"), F.max(F.when(F.col("tail").isNotNull(), F.struct("part", "tail"))).alias("tail"),
    )
    return splits.withColumns({"before": sum_before(F.col("ends")), "head": F.col("head").cast("string"), "tail": F.col("tail.tail").cast("string")})


def json_arrays(spark: SparkSession, paths: list[str]) -> Arrays:
    """The arrays of the files of paths. A record is what stands between the top-level braces; commas between records aren't checked.

    Reads the files once at the call. Of files with several splits, the state of each split goes to all tasks: a row for 128 MB, as Spark sets it."""
    rows = chunks(spark, paths)
    splits = splits_of(rows)
    # A brace is added to the last chunk, which therefore leaves a file at depth -1.
    files = splits.groupBy("file").agg(F.min_by("head", "block").alias("head"), F.max_by(F.struct("tail", "depth", "outside"), "block").alias("last"), F.min("lowest").alias("lowest"))
    problem = (
        F.when(~F.col("head").rlike(rf"^{BLANK}*\["), "not an array")
        .when(F.col("head").rlike(rf"^{BLANK}*\[{BLANK}*\]{BLANK}*\}}\z"), "empty")
        .when((F.col("last.depth") != -1) | ~F.col("last.outside") | (F.col("lowest") < -1) | ~F.col("last.tail").rlike(rf"^{BLANK}*\]{BLANK}*\}}\z"), "not closed")
    )
    files = files.select("file", problem.alias("problem"))
    states = splits.where("NOT alone").select("split", F.concat_ws(" ", "start", "base", "before").alias("state"))
    changed = F.raise_error(F.concat(F.lit("other splits than at first, as cores or settings have changed: "), "split")).cast("string")

    def cut(of: DataFrame) -> DataFrame:
        known = of.select(split(), "alone", "value").join(F.broadcast(states), "split", "left")
        state = F.when(F.col("alone"), "0 0 0").otherwise(F.coalesce("state", changed))
        return known.select(F.concat_ws(" ", state, "split").alias("split"), "value").mapInArrow(pieces, PIECES)

    whole = cut(rows).where("whole").select("file", "pos", F.col("text").cast("string").alias("text"))
    ends = cut(rows.where("NOT alone")).where("NOT whole")
    ends = ends.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))).alias("all"), F.max("ended").alias("ended")).where("ended")
    both = whole.unionByName(ends.select("file", "pos", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text")))
    return Arrays(both.withColumn("text", F.regexp_replace("text", rf"^(?:{BLANK}|[\[,])+", "")), files)


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """(file, pos, record, bad): bad is the text of a record that isn't a JSON object, whose record is null then."""
    named = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = records.withColumn("_record", F.from_json("text", named, {"columnNameOfCorruptRecord": "_bad"}))
    own = F.struct(*[F.col("_record")[f.name].alias(f.name) for f in schema.fields])
    return read.select("file", "pos", F.when(F.col("_record._bad").isNull(), own).alias("record"), F.coalesce("_record._bad", F.when(F.col("_record").isNull(), F.col("text"))).alias("bad"))


def json_array_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array of objects each, as rows with file and pos, the place in the array, from 0.

    A file that isn't a filled array of objects raises when its rows are read."""
    arrays = json_arrays(spark, [path])
    rows = parsed(arrays.records, schema)
    bad = arrays.files.where("problem IS NOT NULL").select("file", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(rows.schema["record"].dataType).alias("record"), F.col("problem").alias("bad"))
    both = rows.unionByName(bad)
    message = F.concat(F.lit("not a filled array of records: "), "file", F.lit(": "), "bad")
    checked = F.when(F.col("bad").isNotNull(), F.raise_error(message)).otherwise(F.col("record"))
    return both.select("file", "pos", checked.alias("record")).select("file", "pos", "record.*")


def tolerant_feed(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of those of paths that exist: rows as json_array_feed() has them, but of whole arrays and readable records only; quarantine
    (file, pos, problem, text) has a row for each file that isn't a filled array, with pos and text null, and for each record that
    isn't an object of the schema."""
    from .feeds import exists

    there = [p for p in paths if exists(spark, p)]
    quarantine = T.StructType.fromDDL("file string, pos long, problem string, text string")
    if not there:
        rows = T.StructType([T.StructField("file", T.StringType()), T.StructField("pos", T.LongType()), *schema.fields])
        return spark.createDataFrame([], rows), spark.createDataFrame([], quarantine)
    arrays = json_arrays(spark, there)
    good = arrays.records.join(arrays.files.where("problem IS NULL").select("file"), "file", "left_semi")
    each = parsed(good, schema)
    files = arrays.files.where("problem IS NOT NULL").select("file", F.lit(None).cast("long").alias("pos"), "problem", F.lit(None).cast("string").alias("text"))
    records = each.where("bad IS NOT NULL").select("file", "pos", F.lit("not a record").alias("problem"), F.col("bad").alias("text"))
    return each.where("bad IS NULL").select("file", "pos", "record.*"), files.unionByName(records)
