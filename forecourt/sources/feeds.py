"""Feed sources: JSON arrays, JSON lines, CSV, posting logs, image folders, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import strip
from . import arrays
from .schemas import FEED, POSTING_LOG


def json_array_feed(spark: SparkSession, path: str, schema: T.StructType = FEED) -> DataFrame:
    """See arrays.json_array_feed()."""
    return arrays.json_array_feed(spark, path, schema)


def seen_links(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(history, quarantine): the addresses (link, source_url) in stores of earlier runs, JSON arrays of listings, and what of them can't be
    read and doesn't count: see arrays.tolerant_feed(). Stores that aren't there have no addresses."""
    names = T.StructType([T.StructField(c, T.StringType()) for c in ("Source Link", "source_url")])
    rows, quarantine = arrays.tolerant_feed(spark, paths, names)
    return rows.select(F.col("Source Link").alias("link"), "source_url"), quarantine


def json_lines_feed(spark: SparkSession, path: str, schema: T.StructType = FEED) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Stands for null in CSV, so that an empty field stays ''.
NULL = r"\N"


def csv_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", NULL).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own listing, so that any store it can read will do."""
    try:
        spark.read.format("binaryFile").load(path).select("path")
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def feed(spark: SparkSession, csv_path: str, json_path: str, schema: T.StructType = FEED) -> DataFrame:
    """Whichever of the two exists, CSV first."""
    return csv_feed(spark, csv_path, schema) if exists(spark, csv_path) else json_lines_feed(spark, json_path, schema)


def posting_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as sinks.append_log() keeps it; the folders of its days are no column of it."""
    return csv_feed(spark, path, POSTING_LOG).select(POSTING_LOG.names)


def image_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(source_id, path, length) of the images in folder/<source_id>/; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("source_id"), "path", "length")


def image_manifest(images: DataFrame, pattern: str = r"\.jpg$") -> DataFrame:
    """(source_id, path, place) of the images (source_id, path) whose path matches; place from 1, by path."""
    paths = images.where(F.col("path").rlike(pattern)).select("source_id", "path").distinct()
    return paths.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("path")).cast("long"))


# Elements that begin a line, and references, & last.
LINE_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|html|li|main|nav|ol|p|section|table|td|th|title|tr|ul"
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAK = rf"(?i)</?({LINE_TAGS})(\s[^>]*)?/?>"


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, pos, line): a page's text as a browser would break it, without scripts, styles and blank lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", HIDDEN, ""), BREAK, "\n"), "<[^>]*>", "")
    for ref, sign in REFERENCES:
        text = F.replace(text, F.lit(ref), F.lit(sign))
    found = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return pages.select("page_id", F.posexplode(found).alias("pos", "line"))
