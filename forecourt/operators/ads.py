"""Canonical ads, their images and the payload of the target form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import UNKNOWN, clean, first_filled, price_digits, strip, without_rand

# Constants of an ad, and the category it is filed under.
CONSTANTS = {"currency": "R (Rand)", "tag": "Sale", "location": "South Africa"}
CATEGORIES = ["Vehicles", "Cars - Parts", "Used cars in South Africa"]
HIGHLIGHTS = ["vehicle highlights", "highlights"]
#: Field → (its names in a feed, the fallback). Of two names, the first that is filled counts.
FIELDS: dict[str, tuple[list[str], str]] = {
    "source_id": (["id", "source_id"], UNKNOWN),
    "source_url": (["Source Link", "source_url"], UNKNOWN),
    "title": (["title"], "Used Car"),
    "condition": (["condition"], UNKNOWN),
    "year": (["year"], UNKNOWN),
    "mileage": (["Kilometers driven", "mileage"], UNKNOWN),
    "transmission": (["transmission"], UNKNOWN),
    "fuel": (["fuel"], UNKNOWN),
    "drive_type": (["4x2 / 4x4", "drive_type"], UNKNOWN),
    "colour": (["body colour", "colour"], UNKNOWN),
    "seats": (["seats"], UNKNOWN),
    "pricing_summary": (["price summary", "pricing_summary"], UNKNOWN),
    "dealer_name": (["dealer_name"], UNKNOWN),
    "address": (["dealer_address", "address"], UNKNOWN),
    "dealer_rating": (["Dealer average rating", "dealer_rating"], UNKNOWN),
    "contact_phone": (["contact_number", "contact_phone"], UNKNOWN),
}
#: Further spellings under which an ad shows a field.
SPELLINGS = {
    "Source Link": "source_url", "Kilometers driven": "mileage", "4x2 / 4x4": "drive_type", "body colour": "colour", "price summary": "pricing_summary",
    "dealer_address": "address", "Dealer average rating": "dealer_rating", "contact_number": "contact_phone", "title description": "variant",
}


def alias(ads: DataFrame, names: list[str], fallback: Column | str = UNKNOWN) -> Column:
    """The first filled of the columns that there are, cleaned."""
    own = [F.col(f"`{c}`") for c in names if c in ads.columns]
    return clean(first_filled(*own) if own else F.lit(None).cast("string"), fallback)


def flatten(texts: Column) -> Column:
    """Stripped, without blanks, a line each; no list: ''."""
    return F.array_join(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), strip), lambda x: x != ""), "\n")


def as_text(c: str, kind: str) -> Column:
    """A list as lines, a text cleaned."""
    return flatten(F.col(f"`{c}`")) if kind.startswith("array") else clean(F.col(f"`{c}`"))


def as_highlights(listings: DataFrame) -> Column:
    """The first of the two columns that is filled in the row, a list or a text; of neither, the last one as it is. No such column: ''."""
    own = [(c, kind) for c, kind in listings.dtypes if c in HIGHLIGHTS]
    own.sort(key=lambda x: HIGHLIGHTS.index(x[0]))
    if not own:
        return F.lit("")
    filled = [F.when((F.size(f"`{c}`") > 0) if kind.startswith("array") else (F.col(f"`{c}`") != ""), as_text(c, kind)) for c, kind in own]
    return F.coalesce(*filled, as_text(*own[-1]))


def canonical(listings: DataFrame) -> DataFrame:
    """Raw listings under any of their field names as ads: 34 columns, all text but images. A list that no listing has is ''.

    Fields are cleaned in one projection; those for which the title stands in, and the spellings under which fields are shown again, are another one
    on it, so that no title is cleaned twice."""
    has = dict(listings.dtypes)
    fields = {name: alias(listings, names, fallback) for name, (names, fallback) in FIELDS.items()}
    none = F.lit(None).cast("string")
    fields["variant"] = alias(listings, ["title description", "title_description", "variant"], none)
    fields["description"] = alias(listings, ["description"], none)
    fields["price"] = price_digits(F.col("price").cast("string")) if "price" in has else F.lit("0")
    fields["features"] = as_text("features", has["features"]) if "features" in has else F.lit("")
    fields["vehicle highlights"] = as_highlights(listings)
    images = F.slice("images", 1, 5) if "images" in has else F.array().cast("array<string>")
    cleaned = listings.select(*[c.alias(name) for name, c in fields.items()], images.alias("images"))
    names = {name: name for name in fields} | SPELLINGS
    shown = {of: F.coalesce(of, "title") if of in ("variant", "description") else F.col(f"`{of}`") for of in fields}
    return cleaned.select(*[shown[of].alias(name) for name, of in names.items()], *[F.lit(v).alias(k) for k, v in CONSTANTS.items()], "images")


def with_categories(ads: DataFrame) -> DataFrame:
    """ads with category_1 to category_3, the path under which they are filed."""
    return ads.withColumns({f"category_{i}": F.lit(c) for i, c in enumerate(CATEGORIES, 1)})


def typed(ads: DataFrame) -> DataFrame:
    """ads with numbers beside the texts: price_amount, year_num, mileage_km."""
    km = F.regexp_replace("mileage", "[^0-9]", "")
    return ads.withColumns(
        {
            "price_amount": F.col("price").try_cast("decimal(12,0)"),
            "year_num": F.col("year").try_cast("int"),
            "mileage_km": km.try_cast("int"),
        }
    )


def resolve_images(listed: DataFrame, manifest: DataFrame, most: int = 5) -> DataFrame:
    """(source_id, images) for each id of listed (source_id, pos, path): its listed paths that manifest (source_id, path)
    has, in order; if none, all that manifest has for the id, by path. The first five."""
    files = manifest.select("source_id", "path").distinct()
    there = listed.join(files.select(F.col("path").alias("path")).distinct(), "path", "left_semi")
    own = there.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("own"))
    all_of = files.join(listed.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_list("path")).alias("rest"))
    joined = listed.select("source_id").distinct().join(own, "source_id", "left").join(all_of, "source_id", "left")
    paths = F.coalesce(F.transform("own", lambda x: x["path"]), F.col("rest"), F.array().cast("array<string>"))
    return joined.select("source_id", F.slice(paths, 1, most).alias("images"))


def preferred_images(sources: DataFrame, most: int = 5) -> DataFrame:
    """(source_id, images) of sources (source_id, rank, pos, path): only each id's lowest rank counts, by pos and path."""
    lowest = F.min("rank").over(Window.partitionBy("source_id"))
    best = sources.withColumn("lowest", lowest).where("rank = lowest")
    return best.groupBy("source_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "path"))), 1, most), lambda x: x["path"]).alias("images"))


# The form's fields in order, 17 inputs, then its areas and single fields, with the column of an ad or a constant that fills each.
SLOTS = [
    ("title", "title"), ("variant", "variant"), ("top_condition", None), ("year", "year"), ("km", "mileage"), ("transmission", "transmission"),
    ("fuel", "fuel"), ("drive_type", "drive_type"), ("colour", "colour"), ("bottom_condition", "condition"), ("seats", "seats"),
    ("pricing_summary", "pricing_summary"), ("dealer_name", "dealer_name"), ("dealer_address", "address"), ("dealer_rating", "dealer_rating"),
    ("contact_number", "contact_phone"), ("source_link", "source_url"), ("features", "features"), ("highlights", "vehicle highlights"),
    ("price", "price"), ("address", "address"), ("description", "description"),
]
TOP_CONDITION = "Used"


def payload(ads: DataFrame) -> DataFrame:
    """(source_id, slot, name, value): what the form is filled with, in order; what is empty is ".", but a price and a
    description, for which the title stands in. The first condition is always Used, the second the ad's own."""

    def value(name: str, c: str | None) -> Column:
        if c is None:
            return F.lit(TOP_CONDITION)
        if name == "price":
            plain = without_rand(F.col("price"))
            return F.when(plain.rlike(r"^[0-9]+\z"), plain).otherwise(strip(plain))
        return F.coalesce(F.nullif(F.col(f"`{c}`"), F.lit("")), F.col("title") if name == "description" else F.lit(UNKNOWN))

    slots = ads.select("source_id", F.posexplode(F.array(*[value(name, c) for name, c in SLOTS])).alias("slot", "value"))
    return slots.select("source_id", "slot", F.get(F.array(*[F.lit(name) for name, _ in SLOTS]), F.col("slot")).alias("name"), "value")
