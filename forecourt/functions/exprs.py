"""Column expressions of listing feeds, built from Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "."
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space of any script at the ends (trim() takes only U+0020)."""
    return F.regexp_replace(c, ENDS, "")


#: All of a blank text or of one that is only a dot; else the white space at the ends.
NOTHING_OR_ENDS = r"(?U)^[\s\x1c-\x1f]*\.?[\s\x1c-\x1f]*\z|^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"

#: Begins and ends with signs of ASCII and isn't only a dot: nothing to strip, as with most texts. Tried at the first place only.
PLAIN = r"(?s)^(?!\.\z)[!-~](?:.*[!-~])?\z"


def clean(c: Column, fallback: Column | str = UNKNOWN) -> Column:
    """Stripped; null, blank and "." give fallback. NOTHING_OR_ENDS runs only where PLAIN doesn't hold."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(F.when(c.rlike(PLAIN), c).otherwise(F.regexp_replace(c, NOTHING_OR_ENDS, "")), F.lit("")), fallback)


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or '', else the last as it is. "." counts as filled."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def capitalize(c: Column) -> Column:
    """First letter upper, all others lower, unlike initcap."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def match_key(c: Column) -> Column:
    """For comparisons: no case (ß is ss), white space collapsed; null is ''."""
    folded = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))


def without_rand(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("R"), F.lit("")), F.lit(" "), F.lit(""))


def price_digits(c: Column) -> Column:
    """All digits once R and spaces are gone, else "0": also for null, separators, decimals and words."""
    plain = without_rand(c)
    return F.when(plain.rlike(r"^[0-9]+\z"), plain).otherwise(F.coalesce(F.regexp_replace(strip(plain), r"(?s)^(?![0-9]+\z).*\z", "0"), F.lit("0")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank, in order; of null, none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), strip), lambda x: x != "")


def first_where(array: Column, test) -> Column:
    """The first element that passes, else null."""
    return F.get(F.filter(array, test), F.lit(0))


def filled(*messages: Column) -> Column:
    """The messages that aren't null, in order."""
    return F.array_compact(F.array(*messages))
