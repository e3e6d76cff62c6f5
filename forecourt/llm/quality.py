"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column that is true for a text to reject. On a sample, costs are measured by repeated evaluation,
net of what the same job takes without the rule, and rejections are counted among the texts that the rules before leave.
The cascade is a CASE whose branches stand in the order of rejections per second, so that a text leaves at the first rule
that rejects it and the dear rules see only what the cheap ones left. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, let, materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda x: x != "")


def repeated_words(w: Column) -> Column:
    """How many words lie in a window of five words that is found twice or more in the array w, the first included.

    Hashes only tell the texts without any repeat, for which equal windows are impossible; the rest compare the words."""
    count = F.size(w)
    starts = F.sequence(F.lit(0), count - WINDOW)
    at = [lambda i, k=k: F.get(w, i + k) for k in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*(f(i) for f in at)))
    unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.get(p, k + 1) - x)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    return F.when(count < WINDOW, 0).when(unique, 0).otherwise(let(F.sort_array(windows), covered))


def kept_chars(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", pattern, ""))


def prepared(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, text, w, its words, and lines, those with a word. Null text: empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("lines"))


def metrics() -> dict[str, Column]:
    """On the columns of prepared()."""
    return {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": kept_chars(f"[^{SYMBOLS}]+").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": let(F.col("w"), repeated_words).cast("long"),
    }


def base_rules(m: dict[str, Column]) -> dict[str, Column]:
    return {"short": m["n_words"] < 10, "repeats": 100 * m["n_repeat_words"] > 20 * m["n_words"]}


# The commonest words of German, English, Spanish and French.
STOP_WORDS = "der die und in von the of and to a de la que el en les et le des un".split()


def rules(m: dict[str, Column] | None = None) -> dict[str, Column]:
    """name → true for a text to reject, on the columns of prepared(); m: the columns or expressions of metrics()."""
    m = m or {name: F.col(name) for name in metrics()}
    n, signs = m["n_words"], F.length("text")

    def share(array: str, test) -> Column:
        return F.size(F.filter(array, test))

    return {
        "symbols": 4 * m["n_symbols"] > n,
        "dup_lines": 2 * m["n_dup_lines"] > F.size("lines"),
        "shouting": 2 * kept_chars("[^A-Z]+") > kept_chars("[^A-Za-z]+"),
        "word_length": (m["word_chars"] > 25 * n) | (m["word_chars"] < 2 * n),
        "few_letters": 2 * share("w", lambda x: x.rlike(r"\p{L}")) < n,
        "bullets": 10 * share("lines", lambda x: x.rlike(r"^\s*[-*•‣●]")) > 9 * F.size("lines"),
        "ellipses": 10 * share("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*\z")) > 3 * F.size("lines"),
        "no_stop_words": (n >= 50) & (2 * kept_chars("[^A-Za-z]+") > signs) & (share("w", lambda x: F.lower(x).isin(STOP_WORDS)) < 2),
        "few_distinct": (n >= 100) & (5 * F.size(F.array_distinct("w")) < n),
        "digits": 2 * kept_chars("[^0-9]+") > m["word_chars"],
        "long_run": F.col("text").rlike("[!-~]{1000,}"),
        "no_sentence": (n >= 100) & ~F.col("text").rlike("[.!?…。！？؟।]"),
        "placeholder": F.contains(F.lower("text"), F.lit("lorem ipsum")),
        "markup": 20 * kept_chars(r"[^{}\[\];=]+") > signs,
    }


def costs(sample: DataFrame, rules: dict[str, Column], rows: int = 100, repeats: int = 10) -> dict[str, float]:
    """Seconds of each rule over some rows of sample, evaluated `repeats` times in one job, less those of a job without a rule."""
    some = materialize(sample.limit(rows).coalesce(1), "cost-sample")
    many = some.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def took(rule: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count_if(rule & (F.col("_again") > 0))).first()
        return time.perf_counter() - began

    idle = F.length("text") >= 0
    took(idle)
    empty = min(took(idle) for _ in range(3))
    return {name: max(min(took(rule), took(rule)) - empty, 1e-4) / repeats for name, rule in rules.items()}


#: Costs of rules, measured once by a driver: they belong to its machines, not to a table.
MEASURED: dict[tuple[str, ...], dict[str, float]] = {}


def ordered(sample: DataFrame, rules: dict[str, Column], cost: dict[str, float] | None = None) -> list[str]:
    """Names of rules in the order of the cascade: always the one with the most rejections per second among the rows of
    sample that are left. Rules that reject nothing more come last, the cheaper first."""
    key = tuple(rules)
    if cost is None:
        cost = MEASURED[key] = MEASURED.get(key) or costs(sample, rules)
    rows = sample.select(*[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()]).collect()  # as few as the sample has
    order: list[str] = []
    while len(order) < len(rules):
        rest = [name for name in rules if name not in order]
        hits = {name: sum(r[name] for r in rows) for name in rest}
        best = min(rest, key=lambda name: (-hits[name] / cost[name], cost[name]))
        order.append(best)
        rows = [r for r in rows if not r[best]]
    return order


def sampled(docs: DataFrame, sample_rows: int) -> DataFrame:
    rows = docs.count()
    return docs.sample(fraction=min(1.0, sample_rows / max(1, rows)), seed=1)


def base_metrics(docs: DataFrame) -> DataFrame:
    """prepared(docs) with the columns of metrics() and base_failed."""
    base = base_rules({name: F.col(name) for name in metrics()})
    return prepared(docs).select("*", *[c.alias(name) for name, c in metrics().items()]).withColumn("base_failed", base["short"] | base["repeats"])


def cascade(docs: DataFrame, rules: dict[str, Column], sample_rows: int = 1000) -> DataFrame:
    """base_metrics(docs) with kept, and failed_rule: 'base', or the first rule of the cascade that rejected the text, else null.

    Costs and rejections are estimated on about `sample_rows` rows, drawn from all of docs. The verdict is the same in any
    order; a rule that gives null doesn't reject. Empty tables come back empty; repeated rows are judged each; further
    columns are ignored."""
    order = ordered(materialize(base_metrics(sampled(docs, sample_rows)).where("NOT base_failed"), "rule-sample"), rules)
    verdict = F.when(F.col("base_failed"), "base")
    for name in order:
        verdict = verdict.when(rules[name], name)
    return base_metrics(docs).withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each of docs: doc_id, the metrics of base_metrics(), base_failed, kept, in production parameters."""
    return cascade(docs, rules()).drop("text", "w", "lines", "failed_rule")


def keep_good(docs: DataFrame, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Only the verdict is asked for, so the base rules are rules among others and every metric is computed where the cascade
    first needs it: a text that a cheap rule rejects is never searched for repeated words."""
    columns = docs.columns
    all_rules = base_rules(metrics()) | rules(metrics())
    order = ordered(materialize(prepared(sampled(docs, sample_rows)), "rule-sample"), all_rules)
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(all_rules[name], False).otherwise(verdict)
    wrapped = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"))
    # A filter isn't moved below a number of the partition; below prepared() it would split the text anew for every rule.
    ready = prepared(wrapped).withColumn("part", F.spark_partition_id())
    return ready.where(verdict & (F.col("part") >= 0)).select(*[F.col("doc_id").getField(c).alias(c) for c in columns])
