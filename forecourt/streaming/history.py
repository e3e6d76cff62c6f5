"""The addresses that batches have accepted, kept so that a batch reads only what may hold its own.

Accepted rows lie in folders by bucket, a hash of their address. The index beside them has one bit for each hash of an address,
in bitmaps by bucket and block. An address whose bit isn't set is new; only the buckets of the others are read, which Spark's
dynamic partition pruning sees to. The bits decide what is read, the addresses themselves decide what is seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.feeds import exists

#: Bits of one of Spark's bitmaps.
BITS = 1 << 15


@dataclass(frozen=True)
class History:
    """Rows at `path`, partitioned by bucket, run and batch; their index at `path`-index.

    buckets: folders, and rows that are broadcast at most. blocks: bitmaps of a bucket; with 16 bits for each address, one in
    sixteen new addresses reads a bucket for nothing. Both have to stay as they are once the history has rows."""

    spark: SparkSession
    path: str
    url: str = "source_url"
    buckets: int = 64
    blocks: int = 32

    @property
    def index_path(self) -> str:
        return f"{self.path}-index"

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def bit(self, url: Column) -> Column:
        """The place of an address among the bits of its bucket."""
        return F.pmod(F.xxhash64(F.lit(1), url), F.lit(self.blocks * BITS))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def index(self, run: str, batch: int) -> tuple[DataFrame | None, int]:
        """(bucket, block, bitmap) as it was before this batch, and its generation. The last two generations are kept, so that a batch that
        is repeated finds the one that it began with."""
        if not exists(self.spark, self.index_path):
            return None, 0
        index = self.spark.read.parquet(self.index_path)
        known = index.select("generation", "run", "batch").distinct().collect()  # two at most
        before = [k.generation for k in known if (k.run, k.batch) != (run, batch)]
        if not before:
            return None, 0
        return index.where(F.col("generation") == max(before)).select("bucket", "block", "bitmap"), max(before)

    def possibly_seen(self, urls: DataFrame, run: str, batch: int) -> DataFrame | None:
        """(bucket, url) of those of urls (url) whose bit is set; None if there is no index."""
        index, _ = self.index(run, batch)
        if index is None:
            return None
        url = F.col(self.url)
        placed = urls.where(url.isNotNull()).select(self.url, self.bucket(url).alias("bucket"), self.bit(url).alias("bit"))
        placed = placed.withColumns({"block": F.shiftright("bit", 15).cast("int"), "place": F.col("bit").bitwiseAND(F.lit(BITS - 1)).cast("int")})
        byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
        set_ = F.getbit(byte, F.col("place").bitwiseAND(F.lit(7))) == 1
        return placed.join(index, ["bucket", "block"]).where(set_).select("bucket", self.url).distinct()

    def seen(self, urls: DataFrame, run: str, batch: int) -> DataFrame | None:
        """(url) of those of urls that the history has from other batches; reads the buckets that possibly_seen() names."""
        maybe = self.possibly_seen(urls, run, batch)
        if maybe is None:
            return None
        touched = maybe.select("bucket").distinct()  # as many rows as there are buckets at most
        old = self.rows().where((F.col("run") != run) | (F.col("batch") != batch)).join(F.broadcast(touched), "bucket", "left_semi")
        return old.select("bucket", self.url).join(maybe, ["bucket", self.url], "left_semi").select(self.url).distinct()

    def unseen(self, rows: DataFrame, run: str, batch: int) -> DataFrame:
        """rows whose address no other batch has; null addresses stay."""
        old = self.seen(rows.select(self.url), run, batch)
        return rows if old is None else rows.join(old, self.url, "left_anti")

    def append(self, rows: DataFrame, run: str, batch: int) -> None:
        """Writes rows as those of this batch, then the index with their bits; a repeated batch replaces what it wrote."""
        placed = rows.withColumns({"bucket": self.bucket(F.col(self.url)), "run": F.lit(run), "batch": F.lit(batch).cast("long")})
        dynamic = {"partitionOverwriteMode": "dynamic"}
        placed.hint("rebalance", "bucket").write.mode("overwrite").options(**dynamic).partitionBy("bucket", "run", "batch").parquet(self.path)
        own = self.rows().where((F.col("run") == run) & (F.col("batch") == batch) & F.col(self.url).isNotNull())
        bit = self.bit(F.col(self.url))
        new = own.groupBy("bucket", F.shiftright(bit, 15).cast("int").alias("block")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(BITS - 1))).alias("bitmap"))
        base, generation = self.index(run, batch)
        both = (new if base is None else new.unionByName(base)).groupBy("bucket", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        marked = {"generation": F.lit(generation + 1).cast("long"), "run": F.lit(run), "batch": F.lit(batch).cast("long"), "slot": F.lit((generation + 1) % 2)}
        both.withColumns(marked).write.mode("overwrite").options(**dynamic).partitionBy("slot").parquet(self.index_path)
