"""Exclusions, de-duplication, gates and caps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import landed, new_path

#: Up to so many terms are broadcast and compared with every text; more are found by a gram of each.
THETA_TERMS = 1000
GRAM = 6
#: Texts with a gram above which it is dealt in so many parts by text.
HOT = 100_000
PARTS = 32


def all_grams(c: str, size: Column | int) -> Column:
    """The different pieces of `size` signs of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, size)))


def word_grams(c: str, size: int) -> Column:
    """Those of its pieces of `size` signs that begin with a blank before a word: of a text that holds a needle, all that the needle has."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=( [^ ].{{{size - 2}}}))"), F.lit(1)))


def text_grams(texts: DataFrame, sizes: list[int], words: int = 0) -> DataFrame:
    """texts (h and further columns) with gram: each of the different pieces of h of these sizes, and of those of `words` signs
    that begin a word, if it isn't 0."""
    grams = texts.select("*", F.explode(word_grams("h", words)).alias("gram")) if words else None
    for size in sizes:
        own = texts.where(F.length("h") >= size).select("*", F.explode(all_grams("h", size)).alias("gram"))
        grams = own if grams is None else grams.unionByName(own)
    return grams


def signatures(haystacks: DataFrame, needles: DataFrame, k: int, sizes: list[int], words: int = 0) -> DataFrame:
    """(n, gram, df): for each needle that may be in a haystack its rarest gram of k signs, or all of it if it is shorter, and in how many haystacks that is.

    A needle one of whose grams no haystack has is in none of them. If words isn't 0, only grams of so many signs that begin a word count
    in needles that have one."""
    size = F.least(F.length("n"), F.lit(k))
    grams = all_grams("n", size)
    if words:
        grams = F.when(F.size(word_grams("n", words)) > 0, word_grams("n", words)).otherwise(grams)
    own = needles.select("n", grams.alias("grams")).select("n", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    # Only grams that needles have are counted; few of these are broadcast.
    own = landed(own, "grams")
    seen = text_grams(haystacks.select("h"), sizes, words).join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    best = own.join(seen, "gram").groupBy("n").agg(F.min(F.struct("df", "gram")).alias("rarest"), F.count("*").alias("met"), F.first("all").alias("all"))
    return best.where("met = all").select("n", "rarest.gram", "rarest.df")


def gram_pairs(haystacks: DataFrame, needles: DataFrame, k: int = GRAM, hot: int = HOT) -> DataFrame:
    """haystacks (h and further columns) with n, for each of needles (n) that h contains, by an equi-join on the rarest gram of each needle.

    Both are read more than once: they should be tables. Where needles have grams of k signs that begin a word, haystacks are
    asked for these, a few for each text; only needles without one need every place of a text. Needles whose rarest gram is in
    over `hot` haystacks are repeated for each of PARTS parts of these, so that no task gets all of them. An empty needle is in
    every haystack but isn't paired here."""
    wanted = landed(needles.where("n <> ''").distinct(), "needles")
    kinds = wanted.select((F.size(word_grams("n", k)) > 0).alias("begins"), F.least(F.length("n"), F.lit(k)).alias("size")).distinct().collect()  # 2 k at most
    sizes, words = sorted({r.size for r in kinds if not r.begins}), k if any(r.begins for r in kinds) else 0
    if not kinds:
        return haystacks.select("*", F.lit("").alias("n")).where("false")
    if k in sizes:  # every place is looked at anyway
        words = 0
    chosen = landed(signatures(haystacks, wanted, k, sizes, words), "signatures")
    grams = text_grams(haystacks, sizes, words)
    if chosen.where(F.col("df") > hot).isEmpty():
        pairs = grams.join(chosen.select("n", "gram"), "gram")
    else:
        # One pass over the texts for both kinds: part -1 is that of needles that aren't dealt.
        own = F.pmod(F.xxhash64("h"), F.lit(PARTS)).cast("int")
        dealt = F.when(F.col("df") > hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(-1)))
        asked = F.array(own) if chosen.where(F.col("df") <= hot).isEmpty() else F.array(own, F.lit(-1))
        parts = chosen.select("n", "gram", F.explode(dealt).alias("_part"))
        pairs = grams.withColumn("_part", F.explode(asked)).join(parts, ["gram", "_part"]).drop("_part")
    return pairs.where(F.contains("h", "n")).drop("gram")


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def exclude_by_url(listings: DataFrame, terms: DataFrame, url: str = "source_url", normalize_hyphens: bool = False, theta_terms: int = THETA_TERMS) -> DataFrame:
    """Listings whose address, hyphens read as spaces, holds none of terms (term).

    Terms keep their hyphens, so that those with one never match, unless normalize_hyphens. Null addresses stay."""
    term = normal(F.replace("term", F.lit("-"), F.lit(" ")) if normalize_hyphens else F.col("term"))
    wanted = landed(terms.where("term IS NOT NULL").select(term.alias("n")).distinct(), "terms")
    text = F.replace(F.lower(url), F.lit("-"), F.lit(" "))
    if wanted.count() <= theta_terms:
        # The text is made before the join: in its condition it would be made again for every term.
        rows = listings.select(text.alias("h"), F.struct(*[F.col(f"`{c}`") for c in listings.columns]).alias("row"))
        return rows.join(F.broadcast(wanted), F.contains("h", "n"), "left_anti").select("row.*")
    if not wanted.where("n = ''").isEmpty():
        return listings.where(F.col(url).isNull())
    listings = landed(listings, "listings")
    texts = listings.where(F.col(url).isNotNull()).select(text.alias("h"))
    # A hit is known by the hash of its address and the term in it; the term is looked for again, so that equal hashes do no harm.
    hits = landed(gram_pairs(texts, wanted).select(F.xxhash64("h").alias("_hit"), F.col("n").alias("_term")).distinct(), "hits")
    rows = listings.withColumn("_hash", F.xxhash64(text))
    return rows.join(hits, (F.col("_hash") == F.col("_hit")) & F.contains(text, F.col("_term")), "left_anti").drop("_hash")


def exclude_by_title(listings: DataFrame, terms: DataFrame, title: str = "title", theta_terms: int = THETA_TERMS, hot: int = HOT) -> DataFrame:
    """Listings whose title neither holds a term nor is held by one; an empty title is held by any. Decided once per title.

    Distinct titles and excluded ones are tables, so that the listings are computed once for the titles and once for the result, and
    are only shuffled where the excluded titles are too many to be broadcast."""
    wanted = landed(terms.where("term IS NOT NULL").select(normal(F.col("term")).alias("n")).distinct(), "terms")
    titles = listings.select(F.col(title).alias("title")).distinct().withColumn("h", normal(F.coalesce("title", F.lit(""))))
    titles = landed(titles, "titles")
    if wanted.count() <= theta_terms:
        bad = titles.join(F.broadcast(wanted), F.contains("h", "n") | F.contains("n", "h"), "left_semi")
    else:
        there = gram_pairs(titles.select("h").distinct(), wanted, hot=hot).select("h")
        back = gram_pairs(wanted.select(F.col("n").alias("h")), titles.select(F.col("h").alias("n")), hot=hot).select(F.col("n").alias("h"))
        hits = there.unionByName(back).distinct()
        bad = titles.where("h = ''").unionByName(titles.where("h <> ''").join(hits, "h", "left_semi"))
    gone = landed(bad.select(F.coalesce("title", F.lit("")).alias("gone")).distinct(), "gone")
    return listings.join(gone, F.coalesce(F.col(title), F.lit("")) == F.col("gone"), "left_anti")


def first_seen(listings: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by a total order; unlike dropDuplicates, always the same one. Rows without a key all stay.

    Spark limits each group to its first row before the shuffle too, so a key that holds a third of all rows is reduced in every
    task; columns that aren't asked for later aren't shuffled. Rows without a key get a number of their own for it, so that they
    are dealt evenly."""
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy(key, "_own").orderBy(*order))
    return listings.withColumn("_own", own).withColumn("_place", place).where("_place = 1").drop("_own", "_place")


def not_seen(listings: DataFrame, history: DataFrame, key: str = "source_url") -> DataFrame:
    """Listings whose address is none of history's (link, source_url); null addresses stay."""
    seen = history.select(F.explode(F.array("link", "source_url")).alias(key)).where(F.col(key).isNotNull()).distinct()
    return listings.join(seen, key, "left_anti")


def skip_reason(images: Column, features: Column, highlights: Column, wanted: int = 5) -> Column:
    """The first rule that a record fails, or null: the number of images, features, highlights. Null lists are empty."""

    def lacking(c: Column) -> Column:
        c = F.coalesce(c, F.array().cast("array<string>"))
        return (F.size(c) == 0) | (c == F.array(F.lit(".")))

    n = F.size(F.coalesce(images, F.array().cast("array<string>")))
    return F.when(n != wanted, "images").when(lacking(features), "features").when(lacking(highlights), "highlights")


def first_accepted(listings: DataFrame, n: int, order: list, start_page: int | None = None) -> DataFrame:
    if n < 0:
        raise ValueError("a cap can't be negative")
    rows = listings if start_page is None else listings.where(F.col("page") >= start_page)
    return rows.orderBy(*order).limit(n)


@dataclass
class Harvest:
    """rows: the first accepted ones, in no order. ranges: first and last page of each range that was read, its rows and how many were accepted."""

    rows: DataFrame
    ranges: list[dict] = field(default_factory=list)


def harvest(listings: DataFrame, accept: Callable[[DataFrame], DataFrame], n: int, order: list, key: str, start_page: int = 0) -> Harvest:
    """The first n rows that accept() keeps of listings, by page and order, but only so many pages are looked at as it takes.

    Pages are taken in ranges, by how many rows each has: the first range has n rows, the next ones what should be missing at the
    rate of acceptance so far, and twice the rows before at most. accept() sees a range at a time; a key that an earlier range has
    accepted isn't accepted again, and of a range accept() should leave each key once. What a range gives is written before the next."""
    if n < 0:
        raise ValueError("a cap can't be negative")
    spark, path = listings.sparkSession, new_path(listings.sparkSession, "harvest")
    sizes = landed(listings.where(F.col("page") >= start_page).groupBy("page").agg(F.count("*").alias("n")), "pages")
    accept(listings.where("false")).write.mode("append").parquet(path)
    ranges, last, got, want = [], None, 0, n
    while got < n:
        left = sizes if last is None else sizes.where(F.col("page") > last)
        head = left.orderBy("page").limit(want).collect()  # a page has a row at least: no more pages than rows asked for
        if not head:
            break
        rows, pages = 0, []
        for p in head:
            pages.append(p.page)
            rows += p.n
            if rows >= want:
                break
        own = accept(listings.where(F.col("page").between(pages[0], pages[-1])))
        before = spark.read.parquet(path)
        own.join(before.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(own.columns).write.mode("append").parquet(path)
        now = spark.read.parquet(path).count()
        ranges.append({"first": pages[0], "last": pages[-1], "rows": rows, "accepted": now - got})
        last, got = pages[-1], now
        seen = sum(r["rows"] for r in ranges)
        want = min(2 * seen, max(1, round((n - got) * seen / max(got, 1)))) if got < n else 0
    kept = spark.read.parquet(path).orderBy("page", *order).limit(n)
    return Harvest(kept, ranges)


def batch_cap(records: DataFrame, n: int, order: list) -> DataFrame:
    """The first n records; 0 stands for all of them."""
    if n < 0:
        raise ValueError("a batch can't be negative")
    return records.orderBy(*order).limit(n) if n else records


def violated(rules: dict[str, Column]) -> Column:
    """Names of the rules that are true, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))


#: Bytes of an image at most.
IMAGE_BYTES = 50 << 20


def content_rules(title: Column, price: Column, text: Column, images: Column, image_names: Column | None = None, image_bytes: Column | None = None) -> dict[str, Column]:
    """Thresholds of an ad's content; true for a violation. image_bytes: the sizes of its images, as a manifest has them."""

    def empty(c: Column) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    rules = {
        "title_missing": empty(title),
        "price_missing": empty(price),
        "description_missing": empty(text),
        "description_short": ~empty(text) & (F.length(text) < 50),
        "too_many_images": F.coalesce(images, F.lit(0)) > 10,
    }
    if image_names is not None:
        rules["image_format"] = F.exists(image_names, lambda x: ~F.lower(x).rlike(r"[.](jpg|jpeg|png|webp)$"))
    if image_bytes is not None:
        rules["image_size"] = F.exists(image_bytes, lambda x: x > IMAGE_BYTES)
    return rules
