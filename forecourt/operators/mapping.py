"""Mapping onto the options of a form, audits and verdicts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import filled, match_key, strip
from .filters import GRAM, gram_pairs, text_grams

# The fields of a vehicle in the order in which they are audited, and the messages for its images.
MAPPED = ["condition", "transmission", "fuel", "drive_type", "colour", "country"]
COPIED = ["title", "description", "price", "mileage", "source_url"]
FORM = ["source_url", "title", "description", "price"]
WRONG_NUMBER, NOT_UNIQUE = "Exactly five listing images are required", "Form requires five unique images"


def schema_org_condition(c: Column) -> Column:
    """https://schema.org/UsedCondition → Used; others as they are."""
    return F.when(c.startswith("https://schema.org/"), F.replace(F.substring_index(c, "/", -1), F.lit("Condition"), F.lit(""))).otherwise(c)


def option_keys(options: DataFrame) -> DataFrame:
    """(field, key, label): the first label, by pos, of each key of options (field, pos, label)."""
    return options.groupBy("field", match_key(F.col("label")).alias("key")).agg(F.min_by("label", "pos").alias("label"))


#: Options of a form that are broadcast at most.
MOST_OPTIONS = 10_000


def few(options: DataFrame) -> bool:
    return options.limit(MOST_OPTIONS + 1).count() <= MOST_OPTIONS


def map_option(records: DataFrame, options: DataFrame, field: str, value: Column, to: str) -> DataFrame:
    """records with column `to`: the option's own spelling for value, null if there is none. Up to MOST_OPTIONS options are broadcast; more are joined as Spark sees fit."""
    own = option_keys(options.where(F.col("field") == field)).select(F.col("key").alias("_key"), F.col("label").alias(to))
    own = F.broadcast(own) if few(options) else own
    return records.withColumn("_key", match_key(value)).join(own, "_key", "left").drop("_key")


def missing(value: Column) -> Column:
    """Null or ''; "." passes."""
    return F.coalesce(value, F.lit("")) == ""


def source_errors(values: dict[str, Column], mapped: dict[str, Column]) -> Column:
    """Messages for fields without a value, and for values of mapped fields without an option, in order."""
    out = []
    for field, value in values.items():
        message = F.when(missing(value), F.lit(f"Missing source field: {field}"))
        if field in mapped:
            message = message.when(mapped[field].isNull(), F.concat(F.lit(f"No target option for {field}: "), value))
        out.append(message)
    return filled(*out)


#: Options of a form that are looked up in a map, whose keys are compared one by one.
MOST_IN_MAP = 300


def option_map(options: DataFrame) -> dict[str, dict[str, str]] | None:
    """field → key → label of options (field, pos, label), for MAPPED; None if they are over MOST_IN_MAP."""
    rows = option_keys(options.where(F.col("field").isin(MAPPED))).limit(MOST_IN_MAP + 1).collect()
    if len(rows) > MOST_IN_MAP:
        return None
    found: dict[str, dict[str, str]] = {}
    for r in rows:
        found.setdefault(r["field"], {})[r["key"]] = r["label"]
    return found


def mapped(ads: DataFrame, options: DataFrame) -> DataFrame:
    """ads with _value_<field> and _mapped_<field> for MAPPED: the value, and the option for it. country is read from location.

    A field of which options (field, pos, label) has no row passes through. Few options are a constant of one projection
    over all fields; more are joined field by field."""
    values = {f: schema_org_condition(F.col(f)) if f == "condition" else F.col("location" if f == "country" else f) for f in MAPPED}
    rows = ads.withColumns({f"_value_{f}": c for f, c in values.items()})
    known = option_map(options)
    if known is not None:
        table = F.from_json(F.lit(json.dumps(known)), "map<string,map<string,string>>")
        found = {f: F.try_element_at(F.element_at(table, F.lit(f)), match_key(F.col(f"_value_{f}"))) if f in known else F.col(f"_value_{f}") for f in MAPPED}
        return rows.withColumns({f"_mapped_{f}": c for f, c in found.items()})
    listed = {r[0] for r in options.where(F.col("field").isin(MAPPED)).select("field").distinct().collect()}  # six at most
    for f in MAPPED:
        rows = map_option(rows, options, f, F.col(f"_value_{f}"), f"_mapped_{f}") if f in listed else rows.withColumn(f"_mapped_{f}", F.col(f"_value_{f}"))
    return rows


def audit_of_mapped() -> Column:
    """Messages for MAPPED, then COPIED, in order, on the columns of mapped()."""
    values = {f: F.col(f"_value_{f}") for f in MAPPED} | {f: F.col(f) for f in COPIED}
    return source_errors(values, {f: F.col(f"_mapped_{f}") for f in MAPPED})


def source_audit(ads: DataFrame, options: DataFrame, to: str = "source_errors") -> DataFrame:
    """ads with column `to`, the messages for MAPPED, then COPIED, in order."""
    return mapped(ads, options).withColumn(to, audit_of_mapped()).drop(*[f"_{kind}_{f}" for kind in ("value", "mapped") for f in MAPPED])


def form_errors(values: dict[str, Column]) -> Column:
    return filled(*[F.when(missing(v), F.lit(f"Missing form field: {f}")) for f, v in values.items()])


def image_errors(n: Column, n_distinct: Column, wanted: int = 5) -> Column:
    """The mapper asks for five images, the validator for five different ones."""
    return filled(F.when(n != wanted, F.lit(WRONG_NUMBER)), F.when((n != wanted) | (n_distinct != wanted), F.lit(NOT_UNIQUE)))


def verdict(errors: Column) -> Column:
    return F.when(F.size(errors) == 0, "FORM_FILLED").otherwise("BLOCKED")


def dry_run(ads: DataFrame, options: DataFrame) -> DataFrame:
    """ads with status, dry_run (true), mapped, a struct of what goes into the form, and errors.

    Errors are the audit's, then those for images and for the form, each once. A field without a value or an option is null
    in mapped. Where ads have no column images, these aren't judged."""
    rows = mapped(ads, options)
    errors = [audit_of_mapped(), form_errors({f: F.col(f) for f in FORM})]
    images = []
    if "images" in ads.columns:
        n, distinct = F.size(F.coalesce("images", F.array().cast("array<string>"))), F.size(F.array_distinct(F.coalesce("images", F.array().cast("array<string>"))))
        found = image_errors(n, distinct)
        errors = [errors[0], F.filter(found, lambda x: x == WRONG_NUMBER), errors[1], F.filter(found, lambda x: x == NOT_UNIQUE)]
        images = [F.coalesce("images", F.array().cast("array<string>")).alias("images")]
    own = [F.when(~missing(F.col(f"_value_{f}")), F.col(f"_mapped_{f}")).alias(f) for f in MAPPED] + [F.nullif(F.col(f), F.lit("")).alias(f) for f in COPIED]
    rows = rows.withColumn("errors", F.array_distinct(F.concat(*errors))).withColumn("mapped", F.struct(*own, *images))
    return rows.withColumns({"status": verdict(F.col("errors")), "dry_run": F.lit(True)}).drop(*[f"_{kind}_{f}" for kind in ("value", "mapped") for f in MAPPED])


def loose_option(records: DataFrame, options: DataFrame, key: list[str], targets: Column, to: str = "label") -> DataFrame:
    """key and, as `to`, the first option (pos, label and, if there is one, value) whose label holds one of targets or whose
    value equals one, without case; null if none.

    Distinct targets are matched with distinct labels by a gram and with values by equality, so neither has to be few. Targets
    shorter than a gram are grams of labels themselves: the first option of each gram is theirs, without a pair being made. An
    empty target is in every option."""
    first = F.min(F.struct("pos", "label")).alias("_first")
    known = options.where("pos IS NOT NULL AND label IS NOT NULL")
    of = known.groupBy(F.lower("label").alias("h")).agg(first)
    wanted = records.select(*key, F.explode_outer(F.transform(targets, F.lower)).alias("_n"))
    needles = wanted.where("_n IS NOT NULL").select(F.col("_n").alias("n")).distinct()
    best = gram_pairs(of, needles.where(F.length("n") >= GRAM)).groupBy(F.col("n").alias("_n")).agg(F.min("_first").alias("_first"))
    short = needles.where((F.length("n") < GRAM) & (F.col("n") != ""))
    sizes = sorted(r[0] for r in short.select(F.length("n")).distinct().collect())  # GRAM numbers at most
    if sizes:
        grams = text_grams(of, sizes).groupBy("gram").agg(F.min("_first").alias("_first"))
        best = best.unionByName(grams.join(short, F.col("gram") == F.col("n")).select(F.col("n").alias("_n"), "_first"))
    best = best.unionByName(of.agg(F.min("_first").alias("_first")).select(F.lit("").alias("_n"), "_first"))
    if "value" in options.columns:
        best = best.unionByName(known.where("value IS NOT NULL").groupBy(F.lower("value").alias("_n")).agg(first))
    best = best.groupBy("_n").agg(F.min("_first").alias("_first"))
    return wanted.join(best, "_n", "left").groupBy(*key).agg(F.min("_first").alias("_first")).select(*key, F.col("_first.label").alias(to))


# How a form may name the rand, in a label or a value.
RAND_TEXTS, RAND_EXACT, RAND_VALUES = ["rand", "zar", "r ("], ["r"], ["rand", "zar"]


def currency_option(options: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by and label: the first currency option (pos, label, value) of each form that is the rand, by pos; a form without one has no row."""
    text, value = F.lower(strip(F.col("label"))), F.lower(F.coalesce("value", F.lit("")))
    hit = text.isin(RAND_EXACT)
    for t in RAND_TEXTS:
        hit = hit | text.contains(t)
    for t in RAND_VALUES:
        hit = hit | value.contains(t)
    return options.where(hit).groupBy(*(by or [])).agg(F.min_by("label", "pos").alias("label"))
