"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path

#: A word: a maximal run of characters other than space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and returns what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """(file system, path in it) for Python in a task: local or shared folders, HDFS, S3, GCS and others that Arrow opens."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def map_rows(docs: DataFrame, run, more: str = "") -> DataFrame:
    """docs.mapInArrow(run), with the columns of docs and those of the DDL `more`; for run, text is named so and the others are numbered.

    Column names may hold any sign."""
    inner = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    added = T.StructType.fromDDL(more).fields if more else []
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, docs.schema.fields)] + added)
    return docs.toDF(*inner).mapInArrow(run, schema).toDF(*docs.columns, *[f.name for f in added])


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where lambdas inside body use it for each of their elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for each node of edges (a long, b long); equal labels: connected. label is some node of the component.

    Each round hooks every node onto its smallest neighbour, follows these pointers to their roots and contracts the
    edges. No two roots are adjacent, so at least half of the nodes with edges go in a round, whatever the diameter.
    All steps are aggregations and joins; nothing is collected but counts."""

    def contracted(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    e, labels = materialize(contracted(edges), "edges"), None
    while labels is None or not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "up")
        while True:
            over = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            if up.join(over, "label").where("next <> label").isEmpty():
                break
            up = materialize(up.join(over, "label").select("node", F.col("next").alias("label")), "up")
        if labels is None:
            labels = up
        else:
            over = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(over, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        to_a, to_b = (up.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in "ab")
        e = materialize(contracted(e.join(to_a, "a").join(to_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
    return labels
