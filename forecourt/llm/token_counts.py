"""Token counts of documents in flat token files without an index, by a scan for end-of-document ids.

A flat file is nothing but little-endian 16-bit ids, each document followed by the end id. Ranges of a file are tasks of
their own, however large the file is: each is searched in numpy and reports its separators. Prefix sums and a running
maximum over the ranges of a file stitch the documents that lie across them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import file_system, materialize
from .tokens import default_path, encoder, groups

END = 50256
#: A new file is begun beyond so many bytes, and a task reads so many at once.
FILE_BYTES, BLOCK = 256 << 20, 4 << 20


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of docs (doc_id, text; null: empty) as flat files into folder and returns rows (doc_id, file, doc_no).

    Tasks write files of names of their own, and a file counts once the rows that name it are written: a task that is lost
    or run twice leaves a file that none of them names, whole or cut off anywhere. Give the rows to count_tokens(), which reads no other."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, separator = encoder(path, "H", plain=True), end.to_bytes(2, "little")
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, no = None, "", 0, 0
        for b in batches:
            ids, k = b.column(0), 0
            for texts in groups(x.as_py() for x in b.column(1)):
                names, numbers = [], []
                for x in own.encode(texts):
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        name, at, no = f"{uuid.uuid4().hex}.bin", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}")
                    out.write(x + separator)
                    at += len(x) + 2
                    names.append(name)
                    numbers.append(no)
                    no += 1
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(names)), pa.array(names), pa.array(numbers, pa.int64())], ["doc_id", "file", "doc_no"])
                k += len(names)
        if out:
            out.close()

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, file string, doc_no long"), "flat-index")


def ranges(spark: SparkSession, folder: str, block: int = BLOCK, index: DataFrame | None = None) -> DataFrame:
    """Rows (file, block, size) of the files in folder, those that index (file) names if it is given: ranges of block bytes, the last of a file
    shorter. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).where("length > 0").select(F.col("path").alias("file"), "length")
    if index is not None:
        files = files.withColumn("name", F.regexp_extract("file", "[^/]*$", 0)).join(index.select(F.col("file").alias("name")).distinct(), "name", "left_semi").drop("name")
    each = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))))
    return each.select("file", "block", F.least(F.lit(block), F.col("length") - F.col("block") * block).cast("long").alias("size"))


def count_tokens(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK, tasks: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """A row for each document in the flat files of folder (*.bin), those that index (file) names if it is given: file, doc_no (from 0 in its file), start (ids before it in
    its file), n_tokens (without the end id), ended (false: the file ends without its end id).

    Empty files have no rows; an empty folder gives an empty table; a file of an odd number of bytes raises. block: bytes,
    an even number, that are searched at once. Memory holds one block whatever the size of a file."""
    if block % 2:
        raise ValueError("block has to be even")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, k, size in zip(*(c.to_pylist() for c in b.columns)):
                if size % 2:
                    raise ValueError(f"{file} has an odd number of bytes")
                fs, at = file_system(file)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(size, k * block), "<u2")
                ends = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "size", "ends"]
                )

    parts = ranges(spark, folder, block, index)
    own = parts.repartition(tasks or max(1, min(10_000, parts.count())), F.xxhash64("file", "block"))
    blocks = materialize(own.mapInArrow(run, "file string, block long, size long, ends array<long>"), "separators")
    # Only four numbers of each range are put in order; the separators stay where they are found.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_of_file = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    summary = blocks.select("file", "block", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end"))
    summary = summary.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    summary = summary.withColumn("at", F.when(F.col("n") > 0, F.col("base") + F.col("end")))
    summary = summary.select(
        "file", "block", "base", last_of_file.alias("last"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"), F.coalesce(F.max("at").over(before) + 1, F.lit(0)).alias("from")
    )
    joined = blocks.join(summary, ["file", "block"])
    # A document that a file ends without its end id is closed by the file's end.
    open_end = F.col("last") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)) < F.col("size") - 1)
    closed = joined.withColumn("open", open_end).withColumn("ends", F.when(F.col("open"), F.array_append("ends", F.col("size"))).otherwise(F.col("ends")))
    each = closed.select("*", F.posexplode("ends").alias("i", "to"))
    start = F.when(F.col("i") == 0, F.col("from")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    return each.select(
        "file",
        (F.col("docs") + F.col("i")).alias("doc_no"),
        start.alias("start"),
        (F.col("base") + F.col("to") - start).alias("n_tokens"),
        (~F.col("open") | (F.col("i") < F.size("ends") - 1)).alias("ended"),
    )


def document_token_counts(docs: DataFrame) -> DataFrame:
    """count_tokens() of docs (doc_id, text; further columns are ignored), written as flat files into the shared folder, with
    the doc_id of each. Null texts are empty; null ids and repeated rows are counted like others; empty in, empty out."""
    folder = new_path(docs.sparkSession, "flat")
    index = write_flat(docs, folder)
    if index.isEmpty():
        return index.select("doc_id", "file", "doc_no", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("ended"))
    found = count_tokens(docs.sparkSession, folder, index=index).withColumn("file", F.regexp_extract("file", "[^/]*$", 0))
    return index.join(found, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens", "ended")
