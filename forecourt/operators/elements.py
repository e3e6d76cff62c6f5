"""Elements of pages by their own extents, from an opening tag to the closing tag that belongs to it.

Tags are rows with their place in the page. The depth of a tag among those of its name is a prefix sum over the places, and
an opening tag ends at the next tag of its name and depth. All windows are over the tags of one page, so that these
are shuffled once; the text of the pages isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feeds import HIDDEN

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)
AFTER = (1, Window.unboundedFollowing)
#: Beyond every place of a page.
END = (1 << 31) - 1


def by_place(*more: str):
    """The tags of a page, or of a page and further columns, by place."""
    return Window.partitionBy("row", *more).orderBy("pos")


def tags(pages: DataFrame, names: list[str]) -> DataFrame:
    """(row, page_id, url, pos, tag, name, closing): the tags of these names, each with the text up to the next tag of any name.

    row tells pages apart whose page_id is null or repeated. Comments, scripts and styles have no tags."""
    pattern = rf"(?i)</?(?:{'|'.join(names)})(?=[\s/>])[^>]*>[^<]*"
    found = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(pattern), F.lit(0))
    # In a step of its own: beside the explode, every tag would get a number.
    each = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html").select("row", "page_id", "url", F.posexplode(found).alias("pos", "tag"))
    name = F.lower(F.regexp_extract("tag", "^</?([a-zA-Z0-9]+)", 1))
    return each.withColumns({"name": name, "closing": F.col("tag").startswith("</")})


def with_extents(tags: DataFrame) -> DataFrame:
    """tags with depth, the number of elements of its name that are open with it, and stop, the place of an opening tag's own closing tag.

    A closing tag has the depth of its opening one. Without a closing tag, stop is null."""
    step = F.when(F.col("closing"), -1).otherwise(1)
    # Depths change by one: between two opening tags of a name and depth stands the closing tag of the first.
    deep = tags.withColumn("depth", F.sum(step).over(by_place("name")) + F.col("closing").cast("int"))
    return deep.withColumn("stop", F.when(~F.col("closing"), F.lead("pos").over(by_place("name", "depth"))))


def following(value: Column) -> Column:
    """The first value after the tag that isn't null."""
    return F.first(value, ignorenulls=True).over(by_place().rowsBetween(*AFTER))


def within_any(stop: Column) -> Column:
    """Whether the tag lies in an element before it; stop: where such an element ends, else null."""
    return F.coalesce(F.max(stop).over(by_place().rowsBetween(*BEFORE)) > F.col("pos"), F.lit(False))


def cards(pages: DataFrame, opening: str, names: list[str], sponsored_class: str, sponsored_mark: str, within: str) -> DataFrame:
    """tags() of the cards' names, of spans and of anchors, with card, whether a card opens here, card_no, its number in the page, anchor_no,
    that of an anchor with an address, href, and own, for a card that counts: its first anchor whose address contains `within`, (pos, href).

    A card ends at its own closing tag; one without such a tag at the next card. It is paid for if its class says so, or if a
    span with the mark is in it and in no card inside it. A card that is paid for goes with all that is in it; one that holds
    such a mark deeper inside goes alone, so that a frame around all cards doesn't take them with it."""
    html_class, marked = F.col("tag").rlike(sponsored_class), F.col("tag").rlike(sponsored_mark)
    rows = tags(pages, [*names, "span", "a"]).where("name NOT IN ('span', 'a') OR NOT closing" if not {"span", "a"} & set(names) else "true")
    rows = rows.withColumns(
        {
            "card": ~F.col("closing") & F.col("tag").rlike(f"^(?:{opening})"),
            "mark": ~F.col("closing") & (F.col("name") == "span") & marked,
            "href": F.when(~F.col("closing") & (F.col("name") == "a"), F.nullif(F.regexp_extract("tag", '^<[^>]*href="([^"]*)"', 1), F.lit(""))),
        }
    )
    # Windows over whole pages come first: what they are dealt by serves the narrower ones too.
    rows = rows.withColumns(
        {
            "card_no": F.sum(F.col("card").cast("int")).over(by_place()) - 1,
            "anchor_no": F.sum(F.col("href").isNotNull().cast("int")).over(by_place()) - 1,
            "next_card": following(F.when(F.col("card"), F.col("pos"))),
            "next_mark": following(F.when(F.col("mark"), F.col("pos"))),
        }
    )
    rows = with_extents(rows)
    closes = F.col("closing") & F.lag("card").over(by_place("name", "depth"))
    rows = rows.withColumns({"ended": F.col("card") & F.col("stop").isNotNull(), "closes": F.coalesce(closes, F.lit(False))})
    rows = rows.withColumn("stop", F.when(F.col("card"), F.coalesce("stop", "next_card", F.lit(END))))
    # The card that a mark is in: an unended one if that is the last to open, else the last one to open at the mark's depth of cards.
    last = F.last(F.when(F.col("card"), F.struct("pos", "ended")), ignorenulls=True).over(by_place().rowsBetween(*UPTO))
    rows = rows.withColumns({"last": last, "nested": F.sum(F.when(F.col("ended"), 1).when(F.col("closes"), -1).otherwise(0)).over(by_place())})
    at_depth = F.last(F.when(F.col("ended"), F.col("pos")), ignorenulls=True).over(by_place("nested").rowsBetween(*UPTO))
    owner = F.when(F.col("card"), F.col("pos")).when(F.col("mark"), F.when(~F.col("last.ended"), F.col("last.pos")).when(F.col("nested") > 0, at_depth))
    rows = rows.withColumn("owner", owner)
    own_mark = F.max(F.col("mark")).over(Window.partitionBy("row", "owner"))
    rows = rows.withColumn("paid", F.col("card") & (html_class | own_mark))
    rows = rows.withColumn("gone", within_any(F.when(F.col("paid"), F.col("stop"))))
    usable = ~F.col("gone") & F.col("href").contains(within)
    rows = rows.withColumn("link", following(F.when(usable, F.struct("pos", "href"))))
    counts = F.col("card") & ~F.col("paid") & ~F.col("gone") & ~F.coalesce(F.col("next_mark") < F.col("stop"), F.lit(False))
    return rows.withColumn("own", F.when(counts & (F.col("link.pos") < F.col("stop")), F.col("link")))


def outside(tags: DataFrame, noise: Column) -> DataFrame:
    """The opening tags of with_extents() for which noise doesn't hold, and that are in no element for which it does."""
    paid = ~F.col("closing") & noise
    rows = tags.withColumn("_paid", paid)
    rows = rows.withColumn("_gone", within_any(F.when(F.col("_paid"), F.col("stop"))))
    return rows.where("NOT closing AND NOT _paid AND NOT _gone").drop("_paid", "_gone")
