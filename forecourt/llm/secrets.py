"""Secret scans over a trigram index, in DataFrame functions only.

From each rule's regular expression follows a Boolean query of trigrams: sets, any one of which a text must hold whole for
the rule to match. The index is inverted and stored once: for the trigrams that the rules ask for, a posting list is a
bitmap over BUCKET rows of the numbered texts. A query intersects the bitmaps of each of its sets and unites the sets;
only texts whose bit is left are verified with the regular expression. Rules that have no mandatory trigram scan all texts.
Bitmaps and lengths of matches are shuffled; texts only where the candidates' bitmaps are too many to be broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """regex must mean the same in Python and Java. value: the group whose length has to be `least` code points at least."""

    kind: str
    regex: str
    value: int = 0
    least: int = 0
    base: bool = False


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In the order in which kinds stand in a digest. A long run can't hide a shorter match: access and hex runs are maximal.
RULES = (
    Rule("assign", ASSIGN, 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = frozenset[frozenset[str]]
#: Rows of a bitmap, as Spark's bitmap functions have them, and buckets of rows whose candidates are broadcast at most.
BUCKET_BITS, MOST_BUCKETS = 15, 2_000
#: More alternatives than this are not spelt out.
MANY = 64


def trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def trigram_query(regex: str) -> Query:
    """Sets of lower-case trigrams of which every matching text holds one whole. A set that is empty: no demand, scan all."""

    def both(a: Query, b: Query) -> Query:
        joined = frozenset(x | y for x in a for y in b)
        joined = frozenset(x for x in joined if not any(y < x for y in joined))
        return joined if len(joined) <= MANY else min(a, b, key=len)

    none: Query = frozenset([frozenset()])

    def walk(items) -> Query:
        """Literals are spelt out while they are few; what can't be spelt ends the run of words."""
        query, words = none, {""}

        def flush() -> None:
            nonlocal query, words
            query, words = both(query, frozenset(map(trigrams, words))), {""}

        for op, arg in items:
            spelt = spell(op, arg)
            if spelt is not None and len(words) * len(spelt) <= MANY:
                words = {a + b for a, b in product(words, spelt)}
                continue
            flush()
            if op is K.SUBPATTERN:
                query = both(query, walk(arg[3]))
            elif op is K.BRANCH:
                query = both(query, frozenset(x for b in arg[1] for x in walk(b)))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                query = both(query, walk(arg[2]))
        flush()
        return none if frozenset() in query else query

    def spell(op, arg) -> set[str] | None:
        """All strings that an item stands for, or None if they are many."""
        if op is K.LITERAL:
            return {chr(arg).lower()}
        if op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        if op is K.SUBPATTERN:
            return spell_all(arg[3])
        if op is K.BRANCH:
            parts = [spell_all(b) for b in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is K.MAX_REPEAT and arg[1] <= 1:
            one = spell_all(arg[2])
            return one if one is None or arg[0] else one | {""}
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            return {""}
        return None

    def spell_all(items) -> set[str] | None:
        parts = [spell(*x) for x in items]
        if None in parts:
            return None
        words = {"".join(p) for p in product(*parts)} if len(parts) < 40 else None
        return words if words is None or len(words) <= MANY else None

    return walk(parser.parse(regex))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for s in trigram_query(r.regex) for t in s})


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """Rows (bucket, gram, bitmap) of texts (row, text): bit k of a bitmap is set if row BUCKET * bucket + k holds trigram `gram` of grams, without case."""
    low = F.col("low")
    there = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(k)) for k, t in enumerate(grams)]))
    each = texts.select("row", F.lower("text").alias("low")).select("row", F.explode(there).alias("gram"))
    place = F.col("row").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    return each.groupBy(F.shiftright("row", BUCKET_BITS).alias("bucket"), "gram").agg(F.bitmap_construct_agg(place).alias("bitmap"))


def candidates(index: DataFrame, queries: dict[int, Query], grams: list[str]) -> DataFrame:
    """Rows (bucket, q<rank> for each query): the bitmap of the rows that satisfy it, null if there are none in the bucket."""
    number = {t: k for k, t in enumerate(grams)}
    wanted = [(rank, i, len(x), number[t]) for rank, q in queries.items() for i, x in enumerate(sorted(map(sorted, q))) for t in x]
    fields = ("rank", "alternative", "size", "gram")
    asked = F.array(*[F.struct(*[F.lit(v).alias(f) for v, f in zip(w, fields)]) for w in wanted])
    table = index.sparkSession.range(1).select(F.inline(asked))
    joined = index.join(F.broadcast(table), "gram")
    whole = joined.groupBy("bucket", "rank", "alternative", "size").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n")).where("n = size")
    return whole.groupBy("bucket").agg(*[F.bitmap_or_agg(F.when(F.col("rank") == rank, F.col("bitmap"))).alias(f"q{rank}") for rank in queries])


def is_set(bitmap: str) -> Column:
    """Whether the bit of column row is set."""
    place = F.col("row").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def with_candidates(texts: DataFrame, rules: tuple[Rule, ...], most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """texts (row, doc_id, text) with hit<rank>, whether a rule has to be verified on the text."""
    queries = {rank: q for rank, r in enumerate(rules) if frozenset() not in (q := trigram_query(r.regex))}
    hits = {rank: is_set(f"q{rank}") if rank in queries else F.lit(True) for rank in range(len(rules))}
    if queries:
        grams = vocabulary(rules)
        found = materialize(candidates(materialize(postings(texts, grams), "postings"), queries, grams), "candidates")
        found = F.broadcast(found) if found.count() <= most_buckets else found
        texts = texts.withColumn("bucket", F.shiftright("row", BUCKET_BITS)).join(found, "bucket", "left")
    return texts.select("row", "doc_id", "text", *[hit.alias(f"hit{rank}") for rank, hit in hits.items()])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """Rows (row, doc_id, spans), one for each of docs; spans: array of (start, end, rank), by start, then rank.

    rank: the rule's place in rules. Matches are leftmost and don't overlap within a rule; code points, end exclusive;
    matches whose value is too short are dropped after they have taken their place."""
    row = F.monotonically_increasing_id().alias("row")
    texts = materialize(docs.select(row, "doc_id", F.coalesce("text", F.lit("")).alias("text")), "numbered-texts")
    found = [F.when(F.col(f"hit{rank}"), F.regexp_extract_all("text", F.lit(r.regex), F.lit(0))).alias(f"found{rank}") for rank, r in enumerate(rules)]
    verified = with_candidates(texts, rules, most_buckets).select("row", "doc_id", "text", *found)
    pieces = []
    for rank, r in enumerate(rules):
        hits = F.col(f"found{rank}")
        between = F.transform(F.split("text", r.regex, -1), F.length)
        short = F.transform(hits, lambda m: F.length(F.regexp_extract(m, r.regex, r.value)) >= r.least)
        each = F.arrays_zip(
            F.transform(hits, F.length).alias("size"),
            F.slice(between, 1, F.size(hits)).alias("gap"),
            short.alias("valid"),
        )
        pieces.append(F.when(F.size(hits) > 0, each).alias(f"at{rank}"))
    sizes = materialize(verified.select("row", "doc_id", *pieces), "matches")
    flat = None
    for rank in range(len(rules)):
        own = sizes.where(F.col(f"at{rank}").isNotNull()).select("row", F.lit(rank).alias("rank"), F.posexplode(f"at{rank}").alias("nth", "at"))
        flat = own if flat is None else flat.unionByName(own)
    before = Window.partitionBy("row", "rank").orderBy("nth")
    end = F.sum(F.col("at.gap") + F.col("at.size")).over(before).cast("int")
    spans = flat.withColumn("end", end).where("at.valid").select("row", F.struct((F.col("end") - F.col("at.size")).alias("start"), "end", "rank").alias("span"))
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    empty = F.array().cast(by_row.schema["spans"].dataType)
    return sizes.select("row", "doc_id").join(by_row, "row", "left").withColumn("spans", F.coalesce("spans", empty))


def ordered_spans(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    by_kind = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c"))))
    return F.array_join(F.transform(by_kind, lambda s: F.concat_ws(":", F.get(kinds, s["b"]), s["a"], s["c"])), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each of docs: doc_id, n_<kind> of the base rules (long), base_sha256, spans.

    docs (doc_id, text; further columns are ignored). Null text counts as empty: no spans, the digest of the empty string.
    Null ids and repeated rows are reported as they come; an empty table gives an empty one."""
    base = [i for i, r in enumerate(rules) if r.base]
    count = [F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    own = F.filter("spans", lambda s: s["rank"].isin(base))
    digest = F.sha2(ordered_spans(own, rules).cast("binary"), 256).alias("base_sha256")
    return scan(docs, rules).select("doc_id", *count, digest, ordered_spans(F.col("spans"), rules).alias("spans"))
