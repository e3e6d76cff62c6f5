"""How filters interact: what each of them removes, in every order in which they could be applied.

The filters look at one text each, but for the duplicate filter, which needs the smallest id of every text in the table. A
counting Bloom sketch goes before it: each task counts the slots of its own texts, the counts are merged, and what is left is
a bitmap of the slots that were met twice or more. A text one of whose slots was met once is the only one of its kind. Only the
other texts, the possible repeats, are shuffled, whole, and the exact minimum of their ids decides; copies of a text are
reduced to one row in every task before that. Flags are then counted by mask, and every order is a sum over masks.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialize

#: Slots of a block of the sketch, the bits of one of Spark's bitmaps, and slots of a text, all in the same block.
BLOCK_BITS = 15
SLOTS = 3
#: Slots for each row, and blocks at most: 16,384 bitmaps of 4 KB, 64 MB, are what is broadcast whatever the table. More rows fill
#: them further, so that more texts are shuffled; the result is the same.
SLOTS_A_ROW = 16
MOST_BLOCKS = 16_384

# The filters' names, in the order of their bits.
FILTERS = "ABCDE"
SIGNS = "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text, true for a text that fails."""
    w = F.array_remove(F.split(text, BLANK + "+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(w) < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(SIGNS),
    }


def blocks_of(rows: int) -> int:
    """Blocks of the sketch of a table, a power of two."""
    wanted = max(1, rows * SLOTS_A_ROW >> BLOCK_BITS)
    return min(MOST_BLOCKS, 1 << (wanted - 1).bit_length())


def block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, SLOTS * BLOCK_BITS), F.lit(blocks)).cast("int")


def slots(h: Column) -> list[Column]:
    """The slots of a text in its block, from the low bits of its hash."""
    return [F.shiftrightunsigned(h, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for i in range(SLOTS)]


def repeated_slots(hashes: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, bitmap) of the sketch of hashes (h): bit k is set if slot k was met by two texts or more, copies included.

    The partial sums of a task are its sketch; the shuffle of the sums merges the sketches."""
    each = hashes.select(block(F.col("h"), blocks).alias("block"), F.explode(F.array_distinct(F.array(*slots(F.col("h"))))).alias("slot"))
    twice = each.groupBy("block", "slot").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("slot").cast("long")).alias("bitmap"))


def bit_is_set(bitmap: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(slot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, slot.bitwiseAND(F.lit(7))) == 1


def with_possible_repeats(rows: DataFrame, text: str, blocks: int | None = None) -> DataFrame:
    """rows with h, a hash of column text, and maybe: false only for texts that no other row has."""
    rows = rows.withColumn("h", F.xxhash64(text))
    blocks = blocks or blocks_of(rows.count())
    sketch = materialize(repeated_slots(rows.select("h"), blocks), "sketch")
    joined = rows.withColumn("block", block(F.col("h"), blocks)).join(F.broadcast(sketch), "block", "left")
    maybe = F.col("bitmap").isNotNull()
    for slot in slots(F.col("h")):
        maybe = maybe & bit_is_set(F.col("bitmap"), slot)
    return joined.withColumn("maybe", maybe).drop("block", "bitmap")


def flagged(docs: DataFrame, labels: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows (part, mask, good, toxic), one for each of docs: bit k of mask is set if the row fails filter k of FILTERS.

    Null texts are empty, and equal to empty ones. A row without an id has no smaller one and is nobody's smaller one; rows with
    equal ids and texts don't make each other fail. An id has a label if any of its rows in labels says so."""
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    seen = with_possible_repeats(own, "text", blocks)
    low = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    light = seen.select("doc_id", "part", low.alias("low"), "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.when(F.col("maybe"), F.col("text")).alias("again"))
    light = materialize(light, "filter-flags")
    # Rows without an id are no key of a join: however many there are, they are only counted.
    named = light.where("doc_id IS NOT NULL")
    first = named.where("again IS NOT NULL").groupBy("again").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("h2").alias("h2"))
    first = first.select("doc_id", "h", "h2", F.lit(True).alias("first")).distinct()
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    rows = named.select("doc_id", "part", "low", "h", "h2", F.col("again").isNotNull().alias("maybe"))
    rows = rows.join(known, "doc_id", "left").join(first, ["doc_id", "h", "h2"], "left")
    copy = F.when(F.col("maybe") & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.select("part", (F.col("low") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return rows.unionByName(light.where("doc_id IS NULL").select("part", F.col("low").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def mask_counts(rows: DataFrame) -> DataFrame:
    """Rows (part, n, good, toxic): arrays of the counts of each mask, 32 numbers whatever the table."""
    sums = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by_mask = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("of"))
    masks = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))

    def numbers(k: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at("of", m)[k], F.lit(0).cast("long"))).alias(k)

    return by_mask.select("part", *[numbers(k) for k in ("n", "good", "toxic")])


def steps_table() -> list[dict]:
    """Every step of every order: before and own, the masks of the filters before it and of its own."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "own": own})
            before |= own
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row for each part (value of source; null: empty), order of the five filters and step in it: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, all long but the order and the step.

    docs (doc_id, text, source) and labels (doc_id, quality, toxic); further columns are ignored. See flagged() for nulls and
    repeated rows. An empty table gives an empty one."""
    counts = mask_counts(flagged(docs, labels, blocks))
    masks = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))

    def passing(numbers: str) -> Column:
        """For each set of filters, how many pass all of it."""

        def pass_set(s: Column) -> Column:
            kept = F.transform(numbers, lambda n, m: F.when(m.bitwiseAND(s) == 0, n).otherwise(0))
            return F.aggregate(kept, F.lit(0).cast("long"), lambda a, b: a + b)

        return F.transform(masks, pass_set)

    sums = counts.select("part", "n", *[passing(k).alias(f"pass_{k}") for k in ("n", "good", "toxic")])
    table = F.from_json(F.lit(json.dumps(steps_table())), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    each = sums.select("*", F.inline(table))
    after = F.col("before").bitwiseOR(F.col("own"))

    def lost(k: str, before: Column) -> Column:
        return F.get(f"pass_{k}", before) - F.get(f"pass_{k}", before.bitwiseOR(F.col("own")))

    # A set of filters stands before the own one in as many orders as both it and the rest can be arranged.
    weights = F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))])
    befores = F.filter(masks, lambda s: s.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(befores, F.lit(0).cast("long"), lambda total, s: total + lost("n", s) * F.get(weights, F.bit_count(s)))
    removed = lost("n", F.col("before"))
    return each.select(
        "part", "filter_order", "step",
        F.get("pass_n", after).alias("kept"), removed.alias("removed"), (lost("n", F.lit(0)) - removed).alias("redundant"), F.get("n", F.col("own")).alias("unique_fails"),
        lost("good", F.col("before")).alias("good_lost"), lost("toxic", F.col("before")).alias("toxic_lost"), shapley.alias("shapley"),
    )
