"""Schemas of listing feeds and logs."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the fields of a feed and of a log.
TEXTS = [
    "id", "source_id", "Source Link", "source_url", "title", "title description", "variant", "condition", "year", "Kilometers driven",
    "transmission", "fuel", "4x2 / 4x4", "body colour", "seats", "price", "price summary", "dealer_name", "dealer_address",
    "Dealer average rating", "contact_number", "description",
]
LISTS = ["features", "vehicle highlights", "images"]
ALIASES = ["contact_phone", "address", "dealer_rating", "mileage", "drive_type", "colour", "highlights", "pricing_summary", "title_description"]

RAW_LISTING = T.StructType([T.StructField(c, T.StringType()) for c in TEXTS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in LISTS])
#: Raw listings and everything that a feed may call their fields.
FEED = T.StructType(RAW_LISTING.fields + [T.StructField(c, T.StringType()) for c in ALIASES])
POSTING_LOG = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("ad_number", "vehicle_id", "source_url", "year", "make", "model", "variant", "status", "reason")]
)
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
