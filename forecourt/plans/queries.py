"""One query for each operator of the listing engine, on the driver's tables, and its SQL for DuckDB.

The SQL is written from the surveyed behaviour: it takes no pattern, list or constant from the code that it checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import capitalize, clean, lines, price_digits
from ..operators import ads, extract, filters, mapping, queue, report
from ..sources import feeds, shared, sinks
from ..streaming import ingest
from .standins import IMAGE_ORDER, LISTING_ORDER, load, queue_order, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = with_views(sql.strip())
        return f

    return register


# DuckDB forms of the shared expressions.
def d_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def d_clean(c: str, fallback: str = "'.'") -> str:
    return f"CASE WHEN {c} IS NULL OR {d_strip(c)} IN ('', '.') THEN {fallback} ELSE {d_strip(c)} END"


def d_price(c: str) -> str:
    plain = d_strip(f"regexp_replace({c}, '[R ]', '', 'g')")
    return f"CASE WHEN regexp_full_match({plain}, '[0-9]+') THEN {plain} ELSE '0' END"


def d_key(c: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '\s+', ' ', 'g'))"


def d_lines(c: str) -> str:
    return rf"list_filter(list_transform(string_split(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: {d_strip('x')}), lambda x: x <> '')"


def d_capitalize(c: str) -> str:
    return f"(upper(left({c}, 1)) || lower(substr({c}, 2)))"


def d_condition(c: str) -> str:
    return f"CASE WHEN starts_with({c}, 'https://schema.org/') THEN replace(regexp_extract({c}, '[^/]*$'), 'Condition', '') ELSE {c} END"


LISTED = ["source_id", "source_url", "title", "variant", "title_description", "price"]


def texts(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


# Sources and sinks


@query(f"SELECT {', '.join(LISTED)} FROM v_listing")
def feed_json_roundtrip(spark, d):
    path = shared.new_path(spark, "feed")
    load(spark, d, "v_listing").select(LISTED).write.json(path)
    return feeds.json_lines_feed(spark, path, texts(LISTED))


@query(f"SELECT {', '.join(LISTED)} FROM v_listing")
def feed_csv_roundtrip(spark, d):
    path = shared.new_path(spark, "feed")
    sinks.write_csv(load(spark, d, "v_listing").select(LISTED), f"{path}/cars.csv")
    return feeds.feed(spark, f"{path}/cars.csv", f"{path}/cars.json", texts(LISTED))


@query("SELECT coalesce(nullif(title, ''), 'Unknown Title') AS value FROM v_queue WHERE lower(trim(decision)) IN ('y', 'yes')")
def posted_titles(spark, d):
    cars = load(spark, d, "v_queue")
    return sinks.posted_titles(cars.where(queue.route(F.col("decision")) == "posted"))


@query("""
WITH p AS (SELECT DISTINCT source_id, image AS path FROM v_listing_image WHERE image LIKE '%.jpg')
SELECT source_id, path, row_number() OVER (PARTITION BY source_id ORDER BY path) AS place FROM p""")
def image_manifest(spark, d):
    return feeds.image_manifest(load(spark, d, "v_listing_image").withColumnRenamed("image", "path"))


#: Titles with braces, quotes and backslashes, so that records can't be told apart by these signs alone.
ODD_TITLE = "concat(title, CASE l_linenumber % 4 WHEN 0 THEN ' }, {' WHEN 1 THEN ' \"}{\"' WHEN 2 THEN ' \\\\' ELSE '' END)"
D_ODD_TITLE = ODD_TITLE.replace("\\\\", "\\")


def write_arrays(rows: DataFrame, path: str, of: str, record) -> None:
    """rows as JSON arrays, a folder with one file for each value of column `of`, in LISTING_ORDER."""
    own = Window.partitionBy(of).orderBy(*LISTING_ORDER)
    opens, closes = F.row_number().over(own) == 1, F.lead("l_orderkey").over(own).isNull()
    line = F.concat(F.when(opens, "[").otherwise(","), record, F.when(closes, "]").otherwise(""))
    rows.select(of, *LISTING_ORDER, line.alias("value")).repartition(of).sortWithinPartitions(of, *LISTING_ORDER).select(of, "value").write.partitionBy(of).text(path)


@query(f"""
SELECT source_id, {D_ODD_TITLE} AS title, row_number() OVER (PARTITION BY l_orderkey // 5000 ORDER BY {', '.join(LISTING_ORDER)}) - 1 AS pos FROM v_listing""")
def feed_json_array(spark, d):
    """An array for the listings of every 5,000 orders, read in splits and put together."""
    rows, path = load(spark, d, "v_listing").withColumn("array", F.floor(F.col("l_orderkey") / 5000)), shared.new_path(spark, "arrays")
    write_arrays(rows, path, "array", F.to_json(F.struct("source_id", F.expr(ODD_TITLE).alias("title"))))
    return feeds.json_array_feed(spark, f"{path}/*", texts(["source_id", "title"])).select("source_id", "title", "pos")


PAGE_TEXT = "html"
for _pattern, _to in (
    ("(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "''"),
    (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|html|li|main|nav|ol|p|section|table|td|th|title|tr|ul)(\s[^>]*)?/?>", "chr(10)"),
    ("<[^>]*>", "''"),
):
    PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '{_pattern}', {_to}, 'g')"
for _name, _sign in ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&"):
    PAGE_TEXT = f"replace({PAGE_TEXT}, '&{_name};', '{_sign}')"


@query(f"""
WITH p AS (SELECT page_id, list_filter(list_transform(string_split({PAGE_TEXT}, chr(10)), lambda x: {d_strip('x')}), lambda x: x <> '') AS found FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, found[i] AS line FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM p)""")
def page_lines(spark, d):
    return feeds.page_lines(load(spark, d, "pages"))


# Page fields

PAGE_LINKS = """p AS (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS found FROM pages),
e AS (SELECT page_id, url, i - 1 AS pos, found[i] AS href FROM (SELECT page_id, url, found, unnest(range(1, len(found) + 1)) AS i FROM p))"""


@query(f"""WITH {PAGE_LINKS}
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || href END AS url FROM e""")
def page_links(spark, d):
    """No page of the table has a card, so all anchors count."""
    return extract.listing_links(load(spark, d, "pages"), pattern="/", within="/")


#: Pages whose menu items are cards: every fourth letter's are paid for, and addresses end in the number of a page or in none.
CARD_PAGES = r'''regexp_replace(regexp_replace(html, '<li><a href="/([a-dA-D])', '<li class="sponsored"><a href="/\1', 'g'), '<a href="/([^"]*)"', concat('<a href="/for-sale/used/\1/', CASE WHEN page_id % 3 = 0 THEN 'x' ELSE CAST(page_id AS VARCHAR) END, '"'), 'g')'''


@query(rf"""
WITH p AS (SELECT page_id, url, {CARD_PAGES} AS html FROM pages),
c AS (SELECT page_id, url, i - 2 AS pos, parts[i] AS card FROM (SELECT page_id, url, string_split(html, '<li') AS parts, unnest(range(2, len(string_split(html, '<li')) + 1)) AS i FROM p)),
f AS (SELECT page_id, url, pos, regexp_extract(card, 'href="([^"]*/for-sale/used/[^"]*)"', 1) AS href FROM c WHERE NOT starts_with(card, ' class="sponsored') AND contains(card, '/for-sale/used/')),
own AS (SELECT * FROM f WHERE regexp_matches(href, '/\d+/?$')),
a AS (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS found FROM p WHERE page_id NOT IN (SELECT page_id FROM own)),
e AS (SELECT page_id, url, i - 1 AS pos, found[i] AS href FROM (SELECT page_id, url, found, unnest(range(1, len(found) + 1)) AS i FROM a)),
u AS (SELECT * FROM own UNION ALL SELECT * FROM e WHERE contains(href, '/for-sale/used/') AND regexp_matches(href, '/\d+/?$'))
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url FROM u""")
def card_links(spark, d):
    html = F.regexp_replace("html", '<li><a href="/([a-dA-D])', '<li class="sponsored"><a href="/$1')
    number = F.when(F.col("page_id") % 3 == 0, "x").otherwise(F.col("page_id").cast("string"))
    html = F.regexp_replace(html, F.lit('<a href="/([^"]*)"'), F.concat(F.lit('<a href="/for-sale/used/$1/'), number, F.lit('"')))
    return extract.listing_links(load(spark, d, "pages").withColumn("html", html), opening=r"<li\b")


#: Menus as frames of cards: by their first letter, paid for by a span, paid for by class, without a link, or plain; all with an inner card. A mark and a link stand below.
CARD_STEPS = [
    ("<nav><ul>", '<div class="cards">'),
    ("</ul></nav>", '</div><aside><span>Sponsored</span></aside>'),
    ('<li><a href="/([a-dA-D][^"]*)">', '<div class="card"><span> sponsored </span><div class="card-body"><a href="/for-sale/used/{1}/1">'),
    ('<li><a href="/([e-kE-K][^"]*)">', '<div class="card sponsored"><div><a href="/for-sale/used/{1}/2">'),
    ('<li><a href="/([l-nL-N][^"]*)">', '<div class="card"><div><a href="/other/{1}/3">'),
    ('<li><a href="/([^"]*)">', '<div class="card"><b>x</b><div class="card-foot"><a href="/for-sale/used/{1}/4">'),
    ("</a></li>", "</a></div></div>"),
    ("</body>", '<a href="/for-sale/used/99">all</a></body>'),
]


def d_steps(c: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('{1}', chr(92) + '1')}', 'g')"
    return c


def s_steps(c: str, steps: list[tuple[str, str]]):
    column = F.col(c)
    for pattern, to in steps:
        column = F.regexp_replace(column, pattern, to.replace("{1}", "$1"))
    return column


def d_tags(html: str, names: str) -> str:
    """CTEs t: the tags of these names in order, i; d: with their depth among those of their name."""
    shown = rf"regexp_replace({html}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
    return rf"""x AS (SELECT page_id, url, regexp_extract_all({shown}, '</?(?:{names})(?:\s[^>]*)?>[^<]*', 0) AS found FROM pages),
t AS (SELECT page_id, url, i, found[i] AS tag, regexp_extract(found[i], '^</?([a-z]+)', 1) AS name, starts_with(found[i], '</') AS closing
  FROM (SELECT page_id, url, found, unnest(range(1, len(found) + 1)) AS i FROM x)),
d AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) AS d FROM t)"""


D_INSIDE = "EXISTS (SELECT 1 FROM s WHERE s.page_id = {0}.page_id AND s.a < {0}.{1} AND {0}.{1} < s.z)"


D_CARDS = rf"""{d_tags(d_steps('html', CARD_STEPS), 'div|span|a')},
c AS (SELECT o.page_id, o.i AS a, o.tag, min(k.i) AS z FROM d o JOIN d k ON k.page_id = o.page_id AND k.name = 'div' AND k.closing AND k.i > o.i AND k.d = o.d - 1
  WHERE NOT o.closing AND o.name = 'div' AND contains(regexp_extract(o.tag, '\sclass="([^"]*)"', 1), 'card') GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS no FROM c),
m AS (SELECT t.page_id, t.i, max(n.a) AS owner FROM t LEFT JOIN n ON n.page_id = t.page_id AND n.a < t.i AND t.i < n.z WHERE name = 'span' AND NOT closing AND contains(lower(t.tag), 'sponsored') GROUP BY ALL),
s AS (SELECT * FROM n WHERE contains(regexp_extract(tag, '\sclass="([^"]*)"', 1), 'sponsored') OR EXISTS (SELECT 1 FROM m WHERE m.page_id = n.page_id AND m.owner = n.a)),
l AS (SELECT page_id, url, i, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS no, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM t WHERE name = 'a' AND NOT closing),
w AS (SELECT n.page_id, n.no AS pos, any_value(l.url) AS url, arg_min(l.href, l.i) AS href FROM n JOIN l ON l.page_id = n.page_id AND n.a < l.i AND l.i < n.z
  WHERE contains(l.href, '/for-sale/used/') AND NOT {D_INSIDE.format('l', 'i')} AND NOT {D_INSIDE.format('n', 'a')} AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = n.page_id AND s.a = n.a)
    AND NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = n.page_id AND n.a < m.i AND m.i < n.z) GROUP BY ALL),
g AS (SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url FROM w WHERE regexp_matches(href, '/\d+/?$')),
h AS (SELECT page_id, no AS pos, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url FROM l WHERE contains(href, '/for-sale/used/') AND regexp_matches(href, '/\d+/?$'))"""


@query(f"""
WITH {D_CARDS}
SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM g UNION ALL SELECT page_id, CAST(pos AS INTEGER), url FROM h WHERE page_id NOT IN (SELECT page_id FROM g)""")
def card_extents(spark, d):
    """Cards in a frame and in each other, marks and links inside and outside of them."""
    return extract.listing_links(load(spark, d, "pages").withColumn("html", s_steps("html", CARD_STEPS)))


@query(f"""
WITH {D_CARDS}, old AS (SELECT DISTINCT url FROM g WHERE regexp_matches(url, '^https?://[^/]*-')),
gone AS (SELECT DISTINCT lower(substr(href, 16)) AS term FROM l WHERE contains(href, '/for-sale/used/') AND regexp_matches(lower(href), '^/for-sale/used/(the|und|les)/')),
kept AS (SELECT *, 1 AS card FROM g UNION ALL SELECT *, 0 FROM h),
fresh AS (SELECT * FROM kept WHERE url NOT IN (SELECT url FROM old) AND NOT EXISTS (SELECT 1 FROM gone WHERE contains(replace(lower(url), '-', ' '), term)))
SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM fresh WHERE card = (SELECT max(f.card) FROM fresh f WHERE f.page_id = fresh.page_id)""")
def fresh_card_links(spark, d):
    """The same pages with terms that exclude some links and a history that has those of some hosts: where no card is left, anchors are."""
    pages = load(spark, d, "pages").withColumn("html", s_steps("html", CARD_STEPS))
    history = extract.link_candidates(pages).where("of_card").where(F.col("url").rlike("^https?://[^/]*-")).select(F.col("url").alias("link"), F.lit(None).cast("string").alias("source_url"))
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="(/for-sale/used/[^"]*)"'), F.lit(1))).alias("href"))
    terms = hrefs.where(F.lower("href").rlike("^/for-sale/used/(the|und|les)/")).select(F.lower(F.substring("href", 16, 1000)).alias("term")).distinct()
    return extract.fresh_links(pages, history, terms)


#: Adverts that hold a block of their own, and a paragraph that only says that it is paid for, with one inside.
AD_STEPS = [('<div class="ad">', '<div class="ad"><div><p>paid for</p></div>'), ("<article>", "<div>Sponsored <p>by</p></div><p> sponsored</p><article>")]


@query(rf"""
WITH {d_tags(d_steps('html', AD_STEPS), 'div|li|p')},
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS no, lower(regexp_extract(tag, '\sclass="([^"]*)"', 1)) AS class FROM d WHERE NOT closing),
b AS (SELECT *, contains(class, 'sponsored') OR list_contains(regexp_split_to_array(class, '[^a-z0-9_]+'), 'ad') OR trim(lower(regexp_extract(tag, '>([^<]*)$', 1)), chr(32) || chr(10)) = 'sponsored' AS paid FROM n),
s AS (SELECT b.page_id, b.i AS a, min(k.i) AS z FROM b JOIN d k ON k.page_id = b.page_id AND k.name = b.name AND k.closing AND k.i > b.i AND k.d = b.d - 1 WHERE paid GROUP BY ALL)
SELECT page_id, CAST(no AS INTEGER) AS pos, tag AS block FROM b WHERE NOT paid AND NOT {D_INSIDE.format('b', 'i')}""")
def drop_ad_blocks(spark, d):
    return extract.blocks(load(spark, d, "pages").withColumn("html", s_steps("html", AD_STEPS)))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\d+)/?$', 1), ''), md5(url)) AS listing_id FROM pages")
def page_listing_id(spark, d):
    return load(spark, d, "pages").select("page_id", extract.listing_id(F.col("url")).alias("listing_id"))


@query(rf"""
WITH p AS (SELECT page_id, {d_lines("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")} AS own,
  {d_strip("regexp_replace(regexp_extract(html, '(?s)<h2[^>]*>(.*?)</h2>', 1), '<[^>]*>', '', 'g')")} AS sub FROM pages)
SELECT page_id, coalesce(own[1], '.') AS title,
  coalesce(own[2], CASE WHEN length(sub) < 80 AND NOT regexp_matches(sub, '^(19|20)\d{{2}}$') AND NOT contains(lower(sub), 'km') THEN nullif(sub, '') END, '.') AS variant FROM p""")
def page_title_variant(spark, d):
    return extract.title_variant(load(spark, d, "pages"))


@query(r"SELECT source_id, coalesce(nullif(regexp_extract(source_url, '-R(\d+)-', 1), ''), '0') AS price FROM v_listing")
def price_from_url(spark, d):
    return load(spark, d, "v_listing").select("source_id", extract.price_from_url(F.col("source_url")).alias("price"))


@query(rf"""
WITH p AS (SELECT doc_id, n_chars, list_filter({d_lines('text')}, lambda x: NOT regexp_matches(x, '(?i)track price|recalculate|fair deal|good deal|great deal')) AS own FROM documents),
q AS (SELECT doc_id, n_chars, own, list_filter(own, lambda x: regexp_matches(x, 'R\s*[\d\s]+') AND NOT contains(x, 'Est.') AND NOT contains(x, 'Summary') AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 4) AS priced FROM p)
SELECT doc_id, coalesce(regexp_replace(priced[1], '[^0-9]', '', 'g'), CASE WHEN n_chars >= 1000 THEN CAST(n_chars AS VARCHAR) END, '0') AS price,
  coalesce(nullif(array_to_string(own, chr(10)), ''), '.') AS summary FROM q""")
def price_block(spark, d):
    text, element = F.col("text"), F.concat(F.lit("R "), F.col("n_chars").cast("string"))
    return load(spark, d, "documents").select("doc_id", extract.price_of_block(text, element=element).alias("price"), extract.price_summary(text).alias("summary"))


SPEC_TOKENS = [
    "CASE WHEN l_linenumber % 2 = 0 THEN '5 seats 100 km' ELSE 'airbag manual' END", "'Heated seats'", "CAST(year(l_shipdate) AS STRING)", "mileage",
    "CASE WHEN l_linenumber % 3 = 0 THEN 'AUTOMATIC' ELSE 'manual' END", "colour", "CASE WHEN l_partkey % 4 = 0 THEN '4X4' WHEN l_partkey % 4 = 1 THEN 'awd' END",
    "CASE WHEN l_suppkey % 3 = 0 THEN 'Petrol' WHEN l_suppkey % 3 = 1 THEN 'frozen white' END", "'7 Seater'", "condition",
    "CASE WHEN l_linenumber = 4 THEN 'Condition report: twenty points checked' ELSE 'good condition' END",
]
D_SEATS = r"regexp_matches(x, '(?i)\b([1-9]|10|12)\s*(seats|seater|seat)\b')"
D_KM = r"regexp_matches(x, '(?i)\b\d+[\d\s,]*\s*km\b')"


@query(rf"""
WITH a AS (SELECT source_id, list_filter([{', '.join(SPEC_TOKENS)}], lambda x: x IS NOT NULL) AS every FROM v_listing),
p AS (SELECT source_id, list_filter(every, lambda x: contains(x, 'condition') OR contains(x, 'Condition'))[1] AS stated,
  list_filter(every, lambda x: length(x) <= 40 AND NOT contains(x, chr(10)) AND NOT regexp_matches(x, '(?i)bluetooth|aircon|airbag|steering|abs')) AS t FROM a),
f AS (SELECT source_id, stated, t, list_filter(t, lambda x: {D_SEATS})[1] AS seats FROM p),
g AS (SELECT source_id, stated, seats, list_filter(t, lambda x: regexp_matches(x, '^(19|20)\d{{2}}$'))[1] AS year,
  list_filter(t, lambda x, i: {D_KM} AND i <> coalesce(list_position(t, seats), 0))[1] AS mileage,
  list_filter(t, lambda x: lower(x) IN ('manual', 'automatic', 'auto'))[1] AS transmission,
  list_filter(t, lambda x: lower(x) IN ('petrol', 'diesel', 'hybrid', 'electric'))[1] AS fuel,
  list_filter(t, lambda x: lower(x) IN ('4x2', '4x4', 'awd', 'fwd', 'rwd'))[1] AS drive,
  list_filter(t, lambda x: lower(x) IN ('white', 'black', 'silver', 'grey', 'gray', 'red', 'blue', 'brown', 'gold', 'orange', 'beige', 'green', 'yellow', 'frozen white'))[1] AS colour FROM f)
SELECT source_id, coalesce(seats, '.') AS seats, coalesce(year, '.') AS year, coalesce(mileage, '.') AS mileage, coalesce({d_capitalize('transmission')}, '.') AS transmission,
  coalesce({d_capitalize('fuel')}, '.') AS fuel_type, coalesce(CASE WHEN starts_with(lower(drive), '4x') THEN lower(drive) ELSE {d_capitalize('drive')} END, '.') AS drive,
  coalesce({d_capitalize('colour')}, '.') AS colour, CASE WHEN length(stated) < 35 THEN stated ELSE '.' END AS condition FROM g""")
def spec_first_match(spark, d):
    tokens = load(spark, d, "v_listing").select("source_id", F.array_compact(F.array(*map(F.expr, SPEC_TOKENS))).alias("tokens"))
    return extract.specs(tokens, "tokens").drop("tokens")


@query(r"SELECT source_id, coalesce(nullif(regexp_extract(source_url, '/((?:19|20)\d{2})-', 1), ''), '.') AS year FROM v_listing")
def year_from_url(spark, d):
    return load(spark, d, "v_listing").select("source_id", extract.year_from_url(F.col("source_url")).alias("year"))


@query("""
SELECT source_id, CASE WHEN contains(u, '4x4') OR contains(t, '4x4') THEN '4x4' WHEN contains(u, '4x2') OR contains(t, '4x2') THEN '4x2' ELSE '.' END AS drive
FROM (SELECT source_id, lower(source_url) AS u, lower(title || CASE l_partkey % 4 WHEN 0 THEN ' 4X4' WHEN 1 THEN ' 4x2' ELSE '' END) AS t FROM v_listing)""")
def drive_from_url(spark, d):
    title = F.concat("title", F.when(F.col("l_partkey") % 4 == 0, " 4X4").when(F.col("l_partkey") % 4 == 1, " 4x2").otherwise(""))
    return load(spark, d, "v_listing").select("source_id", extract.drive_from(F.col("source_url"), title).alias("drive"))


@query(r"""
SELECT source_id, CASE WHEN regexp_matches(source_url, '-(AFRICA|AMERICA|ASIA|EUROPE|MIDDLE-EAST)-([A-Za-z]+)/\d+/?$')
  THEN regexp_extract(source_url, '-(AFRICA|AMERICA|ASIA|EUROPE|MIDDLE-EAST)-([A-Za-z]+)/\d+/?$', 2) || ', '
    || replace(regexp_extract(source_url, '-(AFRICA|AMERICA|ASIA|EUROPE|MIDDLE-EAST)-([A-Za-z]+)/\d+/?$', 1), '-', ' ') ELSE '.' END AS location
FROM (SELECT source_id, replace(source_url, 'MIDDLE EAST', 'MIDDLE-EAST') AS source_url FROM v_listing)""")
def location_from_url(spark, d):
    url = F.replace("source_url", F.lit("MIDDLE EAST"), F.lit("MIDDLE-EAST"))
    return load(spark, d, "v_listing").select("source_id", extract.location_from_url(url, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE-EAST"]).alias("location"))


@query(rf"""
SELECT doc_id, CASE WHEN length({d_strip('text')}) < 100 THEN coalesce({d_lines('text')}[1], 'beside ' || source) ELSE 'beside ' || source END AS dealer,
  CASE WHEN {d_strip("replace(replace(text, 'Distance From You', ''), 'Location', '')")} IN ('', '.') THEN 'Benoni, Gauteng' ELSE coalesce({d_strip("replace(replace(text, 'Distance From You', ''), 'Location', '')")}, 'Benoni, Gauteng') END AS address
FROM (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN ' Location ' WHEN 1 THEN 'Distance From You ' || text WHEN 2 THEN left(text, 60) ELSE text END AS text FROM documents)""")
def seller_fields(spark, d):
    k, text = F.col("doc_id") % 5, F.col("text")
    shown = F.when(k == 0, " Location ").when(k == 1, F.concat(F.lit("Distance From You "), text)).when(k == 2, F.left(text, F.lit(60))).otherwise(text)
    rows = load(spark, d, "documents").select("doc_id", "source", shown.alias("text"))
    found = {"dealer": extract.dealer(F.col("text"), F.concat(F.lit("beside "), F.col("source"))), "address": extract.address(F.col("text"), F.lit("https://x/a-Gauteng-Benoni/9"))}
    return rows.select("doc_id", *[c.alias(name) for name, c in found.items()])


D_RATED = """coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' 4.8 (630 Reviews)' WHEN 1 THEN chr(10) || '4.8 (1 630 reviews)' WHEN 2 THEN chr(10) || '3.2 litre / 4.8' || chr(10) || ' 1 630 REVIEWS'
  WHEN 3 THEN ' 6.1 of 12 reviews' WHEN 4 THEN ' 2.5 and later 7,001 review' ELSE '' END"""


D_PAIR = r"(?i)\b([1-5]\.\d)[\s\n]*\(?([\d\s,]+[\s\n]*reviews?)\)?"


@query(rf"""
WITH t AS (SELECT doc_id, {D_RATED} AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '{D_PAIR}') THEN regexp_extract(text, '{D_PAIR}', 1) || ' (' || trim(regexp_extract(text, '{D_PAIR}', 2), chr(32) || chr(10) || chr(9)) || ')'
  WHEN regexp_matches(text, '\b([1-5]\.\d)\b') AND regexp_matches(text, '(?i)\d+[\d\s,]*\s*reviews?')
    THEN regexp_extract(text, '\b([1-5]\.\d)\b', 1) || ' (' || regexp_extract(text, '(?i)\d+[\d\s,]*\s*reviews?') || ')'
  ELSE '.' END AS rating FROM t""")
def rating_extract(spark, d):
    return load(spark, d, "documents").select("doc_id", extract.rating(F.expr(D_RATED)).alias("rating"))


@query(rf"""
WITH t AS (SELECT doc_id, {D_RATED} AS text FROM documents),
p AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{D_PAIR}') THEN [regexp_extract(text, '{D_PAIR}', 1), regexp_extract(text, '{D_PAIR}', 2)]
  WHEN regexp_matches(text, '\b([1-5]\.\d)\b') AND regexp_matches(text, '(?i)\d+[\d\s,]*\s*reviews?')
    THEN [regexp_extract(text, '\b([1-5]\.\d)\b', 1), regexp_extract(text, '(?i)\d+[\d\s,]*\s*reviews?')] END AS found FROM t)
SELECT doc_id, CAST(found[1] AS DOUBLE) AS rating, TRY_CAST(regexp_replace(found[2], '[^0-9]', '', 'g') AS BIGINT) AS review_count FROM p""")
def rating_numbers(spark, d):
    shown = load(spark, d, "documents").select("doc_id", extract.rating(F.expr(D_RATED)).alias("shown"))
    return shown.select("doc_id", *[c.alias(name) for name, c in extract.rating_numbers(F.col("shown")).items()])


PHONE = r"\+?\d[\d ()-]{4,}\d"


@query(f"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}', 0)) AS found FROM documents)
SELECT doc_id, found, CASE WHEN length(regexp_replace(found, '[^0-9]', '', 'g')) >= 10 THEN left(regexp_replace(found, '[^0-9]', '', 'g'), 10) ELSE '.' END AS phone FROM p""")
def phone_digits(spark, d):
    found = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("found"))
    return found.withColumn("phone", extract.phone(F.col("found")))


@query(rf"SELECT doc_id, array_to_string(list_filter({d_lines('text')}, lambda x: NOT regexp_matches(x, '(?i)^show\s*(more|less)$')), chr(10)) AS description FROM documents")
def description_clean(spark, d):
    return load(spark, d, "documents").select("doc_id", extract.description(F.col("text")).alias("description"))


@query(f"SELECT doc_id, array_to_string({d_lines('text')}, ' | ') AS highlights, CAST(len({d_lines('text')}) > 0 AS BIGINT) AS n FROM documents")
def highlights_join(spark, d):
    rows = load(spark, d, "documents").select("doc_id", extract.highlights(F.col("text")).alias("h"))
    return rows.select("doc_id", F.array_join("h", "").alias("highlights"), F.size("h").cast("long").alias("n"))


LINK_TEXT = "<a[^>]*>([^<]*)</a>"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '{LINK_TEXT}', 1) AS found FROM pages),
e AS (SELECT page_id, min(i) AS i, t FROM (SELECT page_id, i, trim(found[i]) AS t FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM p))
      WHERE length(t) > 2 AND NOT contains(t, chr(10)) AND lower(t) NOT IN ('features', 'summary', 'engine', 'economy', 'safety', 'specifications') GROUP BY page_id, t)
SELECT page_id, coalesce((SELECT string_agg(t, '|' ORDER BY i) FROM e WHERE e.page_id = p.page_id), '') AS features FROM p""")
def feature_set(spark, d):
    found = F.regexp_extract_all("html", F.lit(LINK_TEXT), F.lit(1))
    return load(spark, d, "pages").select("page_id", F.array_join(extract.features(found), "|").alias("features"))


@query("""
WITH p AS (SELECT source_id, image, min((pos, pos2, pos3)) AS spot FROM v_listing_image WHERE image NOT LIKE '%.svg' GROUP BY source_id, image),
q AS (SELECT source_id, image, spot, row_number() OVER (PARTITION BY source_id ORDER BY spot) AS n FROM p)
SELECT source_id, coalesce((SELECT string_agg('http://i/' || image, ',' ORDER BY spot) FROM q WHERE n <= 5 AND q.source_id = o.source_id), '') AS images
FROM (SELECT DISTINCT source_id FROM v_listing_image) o""")
def image_pick5(spark, d):
    """An order's lines are its images, in order; the page field picks them from an array of addresses."""
    at = F.struct(*IMAGE_ORDER, F.concat(F.lit("http://i/"), F.col("image")).alias("image"))
    listed = load(spark, d, "v_listing_image").groupBy("source_id").agg(F.array_sort(F.collect_list(at)).alias("all"))
    return listed.select("source_id", F.array_join(extract.images(F.transform("all", lambda x: x["image"])), ",").alias("images"))


@query("""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS found FROM pages),
e AS (SELECT page_id, min(i) AS i, 'http://i' || found[i] AS image FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM p) WHERE i % 4 <> 0 GROUP BY page_id, found[i]),
q AS (SELECT page_id, i, image, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM e)
SELECT page_id, coalesce((SELECT string_agg(image, ',' ORDER BY i) FROM q WHERE n <= 5 AND q.page_id = p.page_id), '') AS images FROM p""")
def page_images(spark, d):
    """Links turned into img elements: by turns src, data-src, an empty src beside data-src, and a drawing."""
    found = F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))

    def tag(href, i):
        url = F.concat(F.lit('http://i'), href)
        plain = F.concat(F.lit('<img src="'), url, F.lit('">'))
        late = F.concat(F.lit('<img class="image" data-src="'), url, F.lit('">'))
        both = F.concat(F.lit('<img src="" data-src="'), url, F.lit('"/>'))
        return F.when(i % 4 == 0, plain).when(i % 4 == 1, late).when(i % 4 == 2, both).otherwise(F.concat(F.lit('<img src="'), url, F.lit('.svg">')))

    return load(spark, d, "pages").select("page_id", F.array_join(extract.page_images(F.array_join(F.transform(found, tag), "\n")), ",").alias("images"))


# Filters, joins, caps

KEPT = ["source_id", "source_url", "title"]
D_TERM = "trim(lower(term))"
BAD_TITLE = f"EXISTS (SELECT 1 FROM v_exclusion WHERE contains(lower(title), {D_TERM}) OR contains({D_TERM}, lower(title)))"


@query(f"SELECT {', '.join(KEPT)} FROM v_listing WHERE NOT EXISTS (SELECT 1 FROM v_exclusion WHERE contains(replace(lower(source_url), '-', ' '), {D_TERM}))")
def exclude_by_url(spark, d):
    return filters.exclude_by_url(load(spark, d, "v_listing"), load(spark, d, "v_exclusion")).select(KEPT)


@query(f"SELECT {', '.join(KEPT)} FROM v_listing WHERE NOT EXISTS (SELECT 1 FROM v_exclusion WHERE contains(replace(lower(source_url), '-', ' '), {D_TERM}))")
def exclude_by_url_grams(spark, d):
    """The way of long lists."""
    return filters.exclude_by_url(load(spark, d, "v_listing").select(KEPT), load(spark, d, "v_exclusion"), theta_terms=0)


@query(f"SELECT {', '.join(KEPT)} FROM v_listing WHERE NOT {BAD_TITLE}")
def exclude_by_title(spark, d):
    return filters.exclude_by_title(load(spark, d, "v_listing"), load(spark, d, "v_exclusion")).select(KEPT)


@query(f"SELECT {', '.join(KEPT)} FROM v_listing WHERE NOT {BAD_TITLE}")
def exclude_by_title_grams(spark, d):
    return filters.exclude_by_title(load(spark, d, "v_listing"), load(spark, d, "v_exclusion"), theta_terms=0).select(KEPT)


D_SERIES = "EXISTS (SELECT 1 FROM v_exclusion WHERE contains(lower(title) || ' series', trim(lower(term)) || ' series') OR contains(trim(lower(term)) || ' series', lower(title) || ' series'))"


@query(f"SELECT {', '.join(KEPT)} FROM v_listing WHERE NOT {D_SERIES}")
def exclude_common_endings(spark, d):
    """The way of long lists where all titles and all terms end alike, and some grams are dealt in parts."""
    rows = load(spark, d, "v_listing").withColumn("shown", F.concat("title", F.lit(" series")))
    terms = load(spark, d, "v_exclusion").select(F.concat("term", F.lit(" series")).alias("term"))
    return filters.exclude_by_title(rows, terms, title="shown", theta_terms=0, hot=20).select(KEPT)


@query(f"""
SELECT source_id, source_url, title, l_partkey, l_suppkey FROM v_listing
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {', '.join(LISTING_ORDER)}) = 1""")
def dedupe_first_seen(spark, d):
    return filters.first_seen(load(spark, d, "v_listing"), "source_id", LISTING_ORDER).select("source_id", "source_url", "title", "l_partkey", "l_suppkey")


@query(f"""
WITH k AS (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE source_id END AS id, title, {', '.join(LISTING_ORDER)} FROM v_listing)
SELECT id, title, l_partkey FROM k QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY {', '.join(LISTING_ORDER)}) = 1""")
def dedupe_null_keys(spark, d):
    """Rows without a key are nobody's repeats."""
    rows = load(spark, d, "v_listing").withColumn("id", F.when(F.col("l_linenumber") != 3, F.col("source_id")))
    return filters.first_seen(rows, "id", LISTING_ORDER).select("id", "title", "l_partkey")


@query("""
SELECT source_id, source_url FROM v_listing WHERE source_url NOT IN (SELECT source_url FROM v_listing WHERE l_orderkey % 3 = 0)
  AND source_url NOT IN (SELECT source_url || '/' FROM v_listing WHERE l_linenumber = 2)""")
def anti_join_seen(spark, d):
    rows = load(spark, d, "v_listing")
    old = rows.where("l_orderkey % 3 = 0").select(F.lit(None).cast("string").alias("link"), "source_url")
    old = old.unionByName(rows.where("l_linenumber = 2").select(F.concat("source_url", F.lit("/")).alias("link"), F.lit(None).cast("string").alias("source_url")))
    return filters.not_seen(rows, old).select("source_id", "source_url")


@query("""
SELECT source_id, source_url, 'kept' AS what FROM v_listing WHERE source_url NOT IN (SELECT source_url FROM v_listing WHERE l_linenumber = 1) AND source_url NOT IN (SELECT source_url FROM v_listing WHERE l_linenumber = 2)
UNION ALL SELECT NULL, file, problem FROM (VALUES ('cut', 'not closed'), ('none', 'empty'), ('object', 'not an array'), ('odd', 'not a record')) v(file, problem)""")
def seen_in_stores(spark, d):
    """Addresses of earlier runs in two stores, either field; a store that was cut off, an empty one, one that isn't a list and a record that isn't
    one are set aside, and what they name counts as new."""
    rows, path = load(spark, d, "v_listing").withColumn("array", F.floor(F.col("l_orderkey") / 5000)), shared.new_path(spark, "stores")
    rows = shared.landed(rows.select("array", "source_id", "source_url", *LISTING_ORDER), "listings")  # read five times
    write_arrays(rows.where("l_linenumber = 1"), f"{path}/cars", "array", F.to_json(F.struct(F.col("source_url").alias("Source Link"))))
    write_arrays(rows.where("l_linenumber = 2"), f"{path}/inventory", "array", F.to_json(F.struct("source_url")))
    third = rows.where("l_linenumber = 3").agg(F.min("source_url").alias("url")).select(F.to_json(F.struct(F.col("url").alias("source_url"))).alias("record"))
    for name, form in ("cut", '[%s, {"source_url": "x'), ("none", "[]"), ("object", "%s"), ("odd", '[{"source_url" "z"}]'):
        third.select(F.format_string(form, "record").alias("value")).write.text(f"{path}/{name}")
    names = ["cars/*", "inventory/*", "cut", "none", "object", "odd"]
    history, quarantine = feeds.seen_links(spark, [f"{path}/{n}" for n in [*names, "missing"]])
    kept = filters.not_seen(rows, history).select("source_id", "source_url", F.lit("kept").alias("what"))
    return kept.unionByName(quarantine.select(F.lit(None).cast("string").alias("source_id"), F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("source_url"), F.col("problem").alias("what")))


@query("""
WITH o AS (SELECT source_id, count(*) AS n, count_if(image LIKE '%.jpg') AS jpgs, min(pos3) % 10 AS m FROM v_listing_image GROUP BY source_id)
SELECT CASE WHEN n <> 5 THEN 'images' WHEN jpgs = 0 THEN 'features' WHEN m = 0 THEN 'highlights' ELSE 'accepted' END AS reason, count(*) AS n FROM o GROUP BY 1""")
def completeness_gate(spark, d):
    orders = load(spark, d, "v_listing_image").groupBy("source_id").agg(
        F.collect_list("image").alias("images"), F.collect_list(F.when(F.col("image").like("%.jpg"), F.col("image"))).alias("features"), (F.min("pos3") % 10).alias("m")
    )
    marks = F.when(F.col("m") == 0, F.array(F.lit("."))).otherwise(F.array(F.lit("low mileage")))
    reason = F.coalesce(filters.skip_reason(F.col("images"), F.col("features"), marks), F.lit("accepted"))
    return orders.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT source_id, source_url FROM v_listing WHERE NOT {BAD_TITLE} AND l_linenumber >= 2 ORDER BY {', '.join(LISTING_ORDER)} LIMIT 1000")
def first_n_accepted(spark, d):
    """Lines of an order are pages; the harvest begins on the second."""
    kept = filters.exclude_by_title(load(spark, d, "v_listing"), load(spark, d, "v_exclusion")).withColumn("page", F.col("l_linenumber"))
    return filters.first_accepted(kept, 1000, LISTING_ORDER, start_page=2).select("source_id", "source_url")


@query(f"""
WITH k AS (SELECT source_id, source_url, title, l_orderkey // 100 AS page, {', '.join(LISTING_ORDER)} FROM v_listing WHERE NOT {BAD_TITLE} AND l_orderkey // 100 >= 2),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {', '.join(LISTING_ORDER)}) = 1)
SELECT source_id, source_url FROM f ORDER BY {', '.join(LISTING_ORDER)} LIMIT 1000""")
def harvest_pages(spark, d):
    """The first thousand listings that are neither excluded nor repeated; pages after those aren't looked at."""
    rows, terms = load(spark, d, "v_listing").withColumn("page", F.floor(F.col("l_orderkey") / 100)), load(spark, d, "v_exclusion")

    def accept(part: DataFrame) -> DataFrame:
        return filters.first_seen(filters.exclude_by_title(part, terms), "source_id", LISTING_ORDER)

    return filters.harvest(rows, accept, 1000, LISTING_ORDER, "source_id", start_page=2).rows.select("source_id", "source_url")


@query("SELECT source_id, title FROM v_queue ORDER BY enqueued_at, CAST(source_id AS BIGINT) LIMIT 50")
def batch_cap(spark, d):
    return filters.batch_cap(load(spark, d, "v_queue"), 50, queue_order()).select("source_id", "title")


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(source, '')) = '' THEN 'title_missing' END, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'price_missing' END,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'description_missing' END, CASE WHEN trim(coalesce(text, '')) <> '' AND length(text) < 50 THEN 'description_short' END,
  CASE WHEN n_chars % 13 > 10 THEN 'too_many_images' END, CASE WHEN doc_id % 4 IN (1, 3) THEN 'image_format' END,
  CASE WHEN n_chars * 100000 > 52428800 THEN 'image_size' END) AS violations FROM documents""")
def threshold_audit(spark, d):
    names = F.array(F.lit("a.JPG"), F.element_at(F.array(*map(F.lit, ["b.png", "b.gif", "b.webp", "b"])), (F.col("doc_id") % 4 + 1).cast("int")))
    sizes = F.array(F.lit(1), F.col("n_chars") * 100_000)
    rules = filters.content_rules(F.col("source"), F.col("lang"), F.col("text"), F.col("n_chars") % 13, names, sizes)
    return load(spark, d, "documents").select("doc_id", F.array_join(filters.violated(rules), ",").alias("violations"))


# Normalisation and projection


@query(f"SELECT source_id, {d_clean('variant')} AS variant, {d_clean('colour')} AS colour, {d_clean('condition')} AS condition FROM v_listing")
def clean_sentinel(spark, d):
    return load(spark, d, "v_listing").select("source_id", *[clean(F.col(c)).alias(c) for c in ("variant", "colour", "condition")])


D_VARIANT = d_clean("coalesce(nullif(title_description, ''), variant)", d_clean("title", "'Used Car'"))


@query(f"SELECT source_id, {D_VARIANT} AS variant FROM v_listing")
def alias_coalesce(spark, d):
    rows = load(spark, d, "v_listing")
    return rows.select("source_id", ads.alias(rows, ["title description", "title_description", "variant"], clean(F.col("title"), "Used Car")).alias("variant"))


@query(f"SELECT source_id, {d_price('price')} AS price, TRY_CAST({d_price('price')} AS BIGINT) AS amount FROM v_listing", name="price_digits")
def normal_price(spark, d):
    return load(spark, d, "v_listing").select("source_id", price_digits(F.col("price")).alias("price")).withColumn("amount", F.col("price").try_cast("long"))


@query(f"""
SELECT l_orderkey, string_agg({d_strip('title')}, chr(10) ORDER BY {', '.join(LISTING_ORDER[1:])}) AS features FROM v_listing GROUP BY l_orderkey""")
def features_flatten(spark, d):
    rows = load(spark, d, "v_listing").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LISTING_ORDER[1:], "title"))).alias("all"))
    return rows.select("l_orderkey", ads.flatten(F.transform("all", lambda x: x["title"])).alias("features"))


D_AD = {
    "source_id": d_clean("source_id"), "source_url": d_clean("source_url"), "title": d_clean("title", "'Used Car'"), "variant": D_VARIANT, "condition": d_clean("condition"),
    "mileage": d_clean("mileage"), "colour": d_clean("colour"), "dealer_name": d_clean("dealer_name"), "address": d_clean("dealer_address"), "price": d_price("price"),
    "description": d_clean("title", "'Used Car'"), "features": "''", "vehicle highlights": "''", "currency": "'R (Rand)'", "tag": "'Sale'", "location": "'South Africa'",
} | {c: "'.'" for c in ("year", "transmission", "fuel", "drive_type", "seats", "pricing_summary", "dealer_rating", "contact_phone")}
D_AGAIN = [
    ("Source Link", "source_url"), ("title description", "variant"), ("Kilometers driven", "mileage"), ("4x2 / 4x4", "drive_type"), ("body colour", "colour"),
    ("price summary", "pricing_summary"), ("dealer_address", "address"), ("Dealer average rating", "dealer_rating"), ("contact_number", "contact_phone"),
]
D_SHOWN = D_AD | {k: D_AD[v] for k, v in D_AGAIN}


@query(f"SELECT {', '.join(f'{v} AS \"{k}\"' for k, v in D_SHOWN.items())}, '' AS images FROM v_listing")
def canonical_ad(spark, d):
    return ads.canonical(load(spark, d, "v_listing")).withColumn("images", F.array_join("images", ","))


@query(f"""
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'id' || source_id ELSE source_id END AS source_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'h1' || chr(10) || 'h2' WHEN l_linenumber % 3 = 1 THEN {d_clean('variant')} ELSE '.' END AS highlights,
  CASE WHEN l_linenumber % 3 = 0 THEN '.' ELSE {d_clean('variant')} END AS features,
  'Vehicles' AS category_1, 'Cars - Parts' AS category_2, 'Used cars in South Africa' AS category_3 FROM v_listing""")
def ad_aliases(spark, d):
    """Both ids, highlights that stand in either column of a row, features as a text, and the category path."""
    k = F.col("l_linenumber")
    lists = F.when(k % 3 == 0, F.array(F.lit(" h1 "), F.lit(""), F.lit("h2"))).when(k % 3 == 1, F.array().cast("array<string>"))
    rows = load(spark, d, "v_listing").select(
        F.when(k % 2 == 0, F.concat(F.lit("id"), "source_id")).alias("id"), "source_id", lists.alias("vehicle highlights"),
        F.when(k % 3 == 2, "").otherwise(F.col("variant")).alias("highlights"), F.when(k % 3 == 0, " . ").otherwise(F.col("variant")).alias("features"), "title",
    )
    return ads.with_categories(ads.canonical(rows)).select("source_id", F.col("vehicle highlights").alias("highlights"), "features", "category_1", "category_2", "category_3")


@query(f"""
SELECT source_id, TRY_CAST({d_price('price')} AS DECIMAL(12, 0)) AS price_amount, CAST(NULL AS INTEGER) AS year_num,
  TRY_CAST(nullif(regexp_replace(mileage, '[^0-9]', '', 'g'), '') AS INTEGER) AS mileage_km FROM v_listing""")
def typed_ad(spark, d):
    return ads.typed(ads.canonical(load(spark, d, "v_listing"))).select("source_id", "price_amount", "year_num", "mileage_km")


@query(f"""
WITH listed AS (SELECT source_id, (pos, pos2, pos3) AS pos, image AS path FROM v_listing_image),
manifest AS (SELECT DISTINCT source_id, image AS path FROM v_listing_image WHERE image LIKE '%.jpg' AND pos3 % 3 = 0),
own AS (SELECT source_id, pos, path FROM listed WHERE path IN (SELECT path FROM manifest)),
both_kinds AS (SELECT source_id, pos, path FROM own UNION ALL
  SELECT source_id, (0, 0, 0), path FROM manifest WHERE source_id NOT IN (SELECT source_id FROM own)),
n AS (SELECT source_id, path, pos, row_number() OVER (PARTITION BY source_id ORDER BY pos, path) AS n FROM both_kinds)
SELECT a.source_id, coalesce(string_agg(path, ',' ORDER BY n), '') AS images FROM (SELECT DISTINCT source_id FROM listed) a LEFT JOIN n ON a.source_id = n.source_id AND n <= 5 GROUP BY 1""")
def resolve_images(spark, d):
    rows = load(spark, d, "v_listing_image").withColumnRenamed("image", "path")
    manifest = feeds.image_manifest(rows.where("pos3 % 3 = 0"))
    listed = rows.select("source_id", F.struct(*IMAGE_ORDER).alias("pos"), "path")
    return ads.resolve_images(listed, manifest).select("source_id", F.array_join("images", ",").alias("images"))


@query("""
WITH s AS (SELECT source_id, CASE WHEN image LIKE '%.jpg' AND pos3 % 3 = 0 THEN 0 WHEN pos3 % 3 = 1 THEN 1 ELSE 2 END AS rank, (pos, pos2, pos3) AS pos, image AS path FROM v_listing_image),
m AS (SELECT *, min(rank) OVER (PARTITION BY source_id) AS lowest FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos, path) AS n FROM m WHERE rank = lowest)
SELECT source_id, string_agg(path, ',' ORDER BY n) AS images FROM n WHERE n <= 5 GROUP BY source_id""")
def image_precedence(spark, d):
    rows = load(spark, d, "v_listing_image")
    rank = F.when(F.col("image").like("%.jpg") & (F.col("pos3") % 3 == 0), 0).when(F.col("pos3") % 3 == 1, 1).otherwise(2)
    ranked = rows.select("source_id", rank.alias("rank"), F.struct(*IMAGE_ORDER).alias("pos"), F.col("image").alias("path"))
    return ads.preferred_images(ranked).select("source_id", F.array_join("images", ",").alias("images"))


D_SLOTS = [
    ("title", "title"), ("variant", "variant"), ("top_condition", "'Used'"), ("year", "year"), ("km", "mileage"), ("transmission", "transmission"), ("fuel", "fuel"),
    ("drive_type", "drive_type"), ("colour", "colour"), ("bottom_condition", "condition"), ("seats", "seats"), ("pricing_summary", "pricing_summary"), ("dealer_name", "dealer_name"),
    ("dealer_address", "address"), ("dealer_rating", "dealer_rating"), ("contact_number", "contact_phone"), ("source_link", "source_url"), ("features", "'.'"), ("highlights", "'.'"),
    ("price", "price"), ("address", "address"), ("description", "description"),
]


@query("WITH ad AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in D_AD.items()) + " FROM v_listing) " + " UNION ALL ".join(
    f"SELECT source_id, {i} AS slot, '{name}' AS name, {value} AS value FROM ad" for i, (name, value) in enumerate(D_SLOTS)))
def ad_payload_long(spark, d):
    return ads.payload(ads.canonical(load(spark, d, "v_listing")))


# Options and audits

D_OPTIONS = f"opt AS (SELECT field, {d_key('label')} AS key, arg_min(label, pos) AS label FROM v_form_option GROUP BY ALL)"


@query(f"""
WITH {D_OPTIONS} SELECT source_id, colour, o.label AS mapped FROM v_listing LEFT JOIN opt o ON o.field = 'colour' AND o.key = {d_key('colour')}""")
def option_lookup(spark, d):
    rows = load(spark, d, "v_listing").select("source_id", "colour")
    return mapping.map_option(rows, load(spark, d, "v_form_option"), "colour", F.col("colour"), "mapped")


@query(f"""
WITH opt AS (SELECT {d_key("title || ' ' || l_orderkey")} AS key, arg_min(title || ' ' || l_orderkey, l_orderkey * 10 + l_linenumber) AS label FROM v_listing GROUP BY 1),
v AS (SELECT source_id, upper(title) || '  ' || (l_orderkey + l_linenumber % 2) AS named FROM v_listing)
SELECT source_id, named, o.label AS mapped FROM v LEFT JOIN opt o ON o.key = {d_key('named')}""")
def option_lookup_many(spark, d):
    """As many options as listings: too many to be broadcast."""
    rows = load(spark, d, "v_listing")
    label = F.concat_ws(" ", "title", "l_orderkey")
    options = rows.select(F.lit("title").alias("field"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), label.alias("label"))
    named = F.concat_ws("  ", F.upper("title"), F.col("l_orderkey") + F.col("l_linenumber") % 2)
    return mapping.map_option(rows.select("source_id", named.alias("named")), options, "title", F.col("named"), "mapped")


@query(f"SELECT source_id, {d_condition('condition')} AS condition FROM v_listing")
def schema_org_condition(spark, d):
    return load(spark, d, "v_listing").select("source_id", mapping.schema_org_condition(F.col("condition")).alias("condition"))


def d_missing(field: str, value: str, kind: str) -> str:
    return f"CASE WHEN coalesce({value}, '') = '' THEN 'Missing {kind} field: {field}' END"


def d_mapped(field: str, value: str, mapped: str) -> str:
    return f"CASE WHEN coalesce({value}, '') = '' THEN 'Missing source field: {field}' WHEN {mapped} IS NULL THEN 'No target option for {field}: ' || {value} END"


def d_option(field: str, value: str) -> str:
    return f"LEFT JOIN opt {field}_o ON {field}_o.field = '{field}' AND {field}_o.key = {d_key(value)}"


D_MAPPED = f"""{D_OPTIONS}, rec AS (SELECT v.*, {d_condition('condition')} AS cond FROM v_vehicle v),
mapped AS (SELECT r.*, condition_o.label AS m_condition, transmission_o.label AS m_transmission, drive_type_o.label AS m_drive_type, colour_o.label AS m_colour, country_o.label AS m_country FROM rec r
  {d_option('condition', 'cond')} {d_option('transmission', 'transmission')} {d_option('drive_type', 'drive_type')} {d_option('colour', 'colour')} {d_option('country', 'location')})"""
D_SOURCE = [
    d_mapped("condition", "cond", "m_condition"), d_mapped("transmission", "transmission", "m_transmission"), d_missing("fuel", "fuel", "source"),
    d_mapped("drive_type", "drive_type", "m_drive_type"), d_mapped("colour", "colour", "m_colour"), d_mapped("country", "location", "m_country"),
    *[d_missing(f, f, "source") for f in ("title", "description", "price", "mileage", "source_url")],
]
D_FORM = [d_missing(f, f, "form") for f in ("source_url", "title", "description", "price")]


def audited(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """rows of v_vehicle, all unless given, with status, dry_run, mapped and errors."""
    return mapping.dry_run(load(spark, d, "v_vehicle") if rows is None else rows, load(spark, d, "v_form_option"))


@query(f"WITH {D_MAPPED} SELECT source_id, concat_ws('; ', {', '.join(D_SOURCE)}) AS errors FROM mapped")
def source_audit(spark, d):
    rows = mapping.source_audit(load(spark, d, "v_vehicle"), load(spark, d, "v_form_option"))
    return rows.select("source_id", F.array_join("source_errors", "; ").alias("errors"))


@query("""
WITH o AS (SELECT source_id, count(*) AS n, count(DISTINCT image) AS u FROM v_listing_image GROUP BY source_id)
SELECT source_id, concat_ws('; ', CASE WHEN n <> 5 THEN 'Exactly five listing images are required' END, CASE WHEN n <> 5 OR u <> 5 THEN 'Form requires five unique images' END) AS errors FROM o""")
def image_audit(spark, d):
    counts = load(spark, d, "v_listing_image").groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("image").alias("u"))
    return counts.select("source_id", F.array_join(mapping.image_errors(F.col("n"), F.col("u")), "; ").alias("errors"))


@query(f"SELECT source_id, concat_ws('; ', {', '.join(D_FORM)}) AS errors FROM v_vehicle")
def form_audit(spark, d):
    values = {c: F.col(c) for c in mapping.FORM}
    return load(spark, d, "v_vehicle").select("source_id", F.array_join(mapping.form_errors(values), "; ").alias("errors"))


@query(f"""
WITH {D_MAPPED}, kept AS (SELECT * FROM mapped WHERE NOT {BAD_TITLE} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {', '.join(LISTING_ORDER)}) = 1)
SELECT CASE WHEN concat_ws('; ', {', '.join(D_SOURCE + D_FORM)}) = '' THEN 'FORM_FILLED' ELSE 'BLOCKED' END AS status,
  concat_ws('; ', {', '.join(D_SOURCE + D_FORM)}) AS errors, count(*) AS n FROM kept GROUP BY ALL""")
def ad_verdict(spark, d):
    """The flagship: exclusion and de-duplication first, then option mapping and both audits of what is left, verdict counts."""
    kept = filters.first_seen(filters.exclude_by_title(load(spark, d, "v_vehicle"), load(spark, d, "v_exclusion")), "source_id", LISTING_ORDER)
    return audited(spark, d, kept).groupBy("status", F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n"))


D_IMAGES = ["CASE WHEN n <> 5 THEN 'Exactly five listing images are required' END"], ["CASE WHEN n <> 5 OR u <> 5 THEN 'Form requires five unique images' END"]


@query(f"""
WITH {D_MAPPED}, i AS (SELECT source_id AS k, count(*) AS n, count(DISTINCT image) AS u FROM v_listing_image GROUP BY 1),
m AS (SELECT * FROM mapped JOIN i ON k = CAST(l_orderkey AS VARCHAR))
SELECT source_id, CASE WHEN concat_ws('; ', {', '.join(D_SOURCE + D_IMAGES[0] + D_FORM + D_IMAGES[1])}) = '' THEN 'FORM_FILLED' ELSE 'BLOCKED' END AS status, true AS dry_run, source_url,
  concat_ws('; ', {', '.join(D_SOURCE + D_IMAGES[0] + D_FORM + D_IMAGES[1])}) AS errors, m_condition AS condition, m_transmission AS transmission, nullif(fuel, '') AS fuel, m_drive_type AS drive_type,
  m_colour AS colour, m_country AS country, nullif(title, '') AS title, nullif(description, '') AS description, nullif(price, '') AS price, nullif(mileage, '') AS mileage, n AS n_images FROM m""")
def verdict_record(spark, d):
    """The whole record of a dry run; an order's lines are the images of each of its ads."""
    images = load(spark, d, "v_listing_image").groupBy(F.col("source_id").cast("long").alias("l_orderkey")).agg(F.collect_list("image").alias("images"))
    rows = audited(spark, d, load(spark, d, "v_vehicle").join(images, "l_orderkey"))
    shown = [F.col(f"mapped.{f}").alias(f) for f in mapping.MAPPED + mapping.COPIED[:-1]]
    return rows.select("source_id", "status", "dry_run", "source_url", F.array_join("errors", "; ").alias("errors"), *shown, F.size("mapped.images").cast("long").alias("n_images"))


@query("""
WITH v AS (SELECT DISTINCT l_partkey, trim(coalesce(variant, '')) AS target, title_description AS other FROM v_listing),
o AS (SELECT p_partkey AS pos, p_type AS label, p_brand AS value FROM part),
f AS (SELECT DISTINCT target FROM v), g AS (SELECT target, min((pos, label)) AS spot FROM f JOIN o ON contains(lower(label), lower(target)) OR lower(value) = lower(target) GROUP BY 1),
b AS (SELECT lower(value) AS other, min((pos, label)) AS spot FROM o GROUP BY 1)
SELECT l_partkey, target, v.other, coalesce(least(g.spot, b.spot), g.spot, b.spot)[2] AS label FROM v LEFT JOIN g USING (target) LEFT JOIN b ON b.other = lower(v.other)""")
def option_contains(spark, d):
    rows = load(spark, d, "v_listing").select("l_partkey", F.trim(F.coalesce("variant", F.lit(""))).alias("target"), F.col("title_description").alias("other")).distinct()
    options = load(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("label"), F.col("p_brand").alias("value"))
    targets = F.array_compact(F.array("target", "other"))
    # Keys of a join don't match nulls: the brand is shown from a key that has none.
    rows = rows.withColumn("key", F.struct("l_partkey", "target", F.coalesce("other", F.lit("")).alias("other"), F.col("other").isNull().alias("none")))
    found = mapping.loose_option(rows, options, ["key"], targets)
    return found.select("key.l_partkey", "key.target", F.when(~F.col("key.none"), F.col("key.other")).alias("other"), "label")


@query("""
SELECT form, arg_min(label, pos) AS label FROM v_currency_option
WHERE contains(lower(label), 'rand') OR contains(lower(label), 'zar') OR trim(lower(label)) = 'r' OR contains(lower(label), 'r (') OR contains(lower(value), 'rand') OR contains(lower(value), 'zar') GROUP BY form""")
def currency_option(spark, d):
    return mapping.currency_option(load(spark, d, "v_currency_option"), ["form"])


# Queue and reports


@query("""
WITH q AS (SELECT *, CASE WHEN CAST(source_id AS BIGINT) % 4 = 0 THEN '' ELSE source_id END AS own FROM v_queue)
SELECT coalesce(nullif(own, ''), 'id' || source_id) AS queue_id, CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN 'l' || source_id WHEN CAST(source_id AS BIGINT) % 3 = 1 THEN 'u' ELSE '.' END AS link, title
FROM q ORDER BY enqueued_at, CAST(source_id AS BIGINT) LIMIT 10""")
def queue_head(spark, d):
    k = F.col("source_id").cast("bigint")
    rows = load(spark, d, "v_queue").withColumns({"at": k, "id": F.concat(F.lit("id"), "source_id"), "Source Link": F.when(k % 3 == 0, F.concat(F.lit("l"), "source_id")), "source_url": F.when(k % 3 == 1, "u")})
    rows = queue.identified(rows.withColumn("source_id", F.when(k % 4 == 0, "").otherwise(F.col("source_id"))))
    return queue.head(rows, 10, ["enqueued_at", "at"]).select("queue_id", "link", "title")


@query("SELECT row_number() OVER (ORDER BY enqueued_at, CAST(source_id AS BIGINT)) AS pos, source_id, title FROM v_queue")
def queue_positions(spark, d):
    return queue.with_position(load(spark, d, "v_queue"), queue_order()).select("pos", "source_id", "title")


@query("""
SELECT row_number() OVER (ORDER BY enqueued_at) AS pos, enqueued_at FROM v_queue""")
def queue_positions_of_ties(spark, d):
    """Many rows of a day: their places are the day's, in any order."""
    return queue.with_position(load(spark, d, "v_queue").select("enqueued_at"), ["enqueued_at"]).select("pos", "enqueued_at")


@query("SELECT count(*) AS remaining FROM v_queue WHERE decision IS NULL")
def queue_left(spark, d):
    rows = load(spark, d, "v_queue")
    return queue.left(queue.remaining(rows, rows.where(queue.route(F.col("decision")) != "waiting")))


@query("""
SELECT source_id, CASE WHEN decision IS NULL THEN 'waiting' WHEN lower(trim(decision)) IN ('y', 'yes') THEN 'posted' ELSE 'cancelled' END AS outcome FROM v_queue""")
def route_decisions(spark, d):
    return load(spark, d, "v_queue").select("source_id", queue.route(F.col("decision")).alias("outcome"))


@query("SELECT source_id, title FROM v_queue WHERE decision IS NULL")
def queue_remaining(spark, d):
    rows = load(spark, d, "v_queue")
    return queue.remaining(rows, rows.where(queue.route(F.col("decision")) != "waiting")).select("source_id", "title")


@query("""
SELECT source_id, title FROM v_queue WHERE decision IS NULL AND CAST(source_id AS BIGINT) % 5 <> 0""")
def queue_resume(spark, d):
    """Three runs on one queue and one table of outcomes: decisions, the same decisions again, then those of another day."""
    rows, path = load(spark, d, "v_queue"), shared.new_path(spark, "outcomes")
    done = rows.where("false").select("source_id")
    later = rows.where(F.col("source_id").cast("bigint") % 5 == 0).withColumn("decision", F.lit("no"))
    for decisions in (rows, rows, later):
        left = queue.remaining(rows, done).select("source_id").join(decisions.select("source_id", "decision"), "source_id")
        left.where(queue.route(F.col("decision")) != "waiting").select("source_id", "decision").write.mode("append").parquet(path)
        done = spark.read.parquet(path)
    return queue.remaining(rows, done).select("source_id", "title")


D_LOG = """
SELECT date_trunc('second', timestamp) AS timestamp, CAST(coalesce(CAST(ad_number AS VARCHAR), '') AS VARCHAR) AS ad_number, coalesce(source_id, '') AS vehicle_id, '' AS source_url,
  '' AS year, '' AS make, '' AS model, '' AS variant, coalesce(status, '') AS status, coalesce(reason, '') AS reason FROM v_posting_log"""


@query(D_LOG)
def posting_log_roundtrip(spark, d):
    """Appended as CSV by day, read back."""
    path = shared.new_path(spark, "posting-log")
    sinks.append_log(report.log_rows(load(spark, d, "v_posting_log").withColumn("ad_number", F.col("ad_number").cast("string"))), path)
    return feeds.posting_log(spark, path)


@query("""
SELECT 'r1' AS run_id, source_id, title FROM v_listing UNION ALL SELECT 'r2', source_id, title FROM v_listing WHERE l_linenumber > 1""")
def snapshot_sink(spark, d):
    """Two runs, the second written twice: the first stays, the second replaces itself."""
    path = shared.new_path(spark, "snapshots")
    rows = load(spark, d, "v_listing").select("source_id", "title", "l_linenumber")
    for run, kept in (("r1", rows), ("r2", rows), ("r2", rows.where("l_linenumber > 1"))):
        sinks.write_snapshot(kept.drop("l_linenumber"), path, run)
    return spark.read.parquet(path).select("run_id", "source_id", "title")


@query("""
SELECT 'r1' AS run_id, source_id, variant FROM v_listing UNION ALL SELECT 'r2', source_id, variant FROM v_listing WHERE l_linenumber > 2""")
def snapshot_json(spark, d):
    """The same as JSON lines; a field without a value comes back as null."""
    path, rows = shared.new_path(spark, "snapshots-json"), load(spark, d, "v_listing").select("source_id", "variant", "l_linenumber")
    for run, kept in (("r1", rows), ("r2", rows), ("r2", rows.where("l_linenumber > 2"))):
        sinks.write_json(kept.drop("l_linenumber"), path, run)
    return feeds.json_lines_feed(spark, path, texts(["source_id", "variant", "run_id"])).select("run_id", "source_id", "variant")


@query(rf"""
WITH f AS (SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url),
p AS (SELECT url, {d_lines("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")} AS own FROM f)
SELECT url AS source_url, coalesce(nullif(regexp_extract(url, '/(\d+)/?$', 1), ''), md5(url)) AS source_id, coalesce(own[1], '.') AS title, coalesce(own[2], '.') AS variant FROM p""")
def ingest_stream(spark, d):
    """Pages as a stream of files, in two runs over the same files: the second adds nothing."""
    source, target, at = (shared.new_path(spark, name) for name in ("pages-in", "pages-out", "pages-checkpoint"))
    load(spark, d, "pages").repartitionByRange(8, "page_id").write.parquet(source)
    for _ in range(2):
        ingest.ingest_pages(spark, source, target, at, files_per_batch=100).awaitTermination()
    return spark.read.parquet(target).select("source_url", "source_id", "title", "variant")


@query("""
SELECT count(*) AS total, count_if(upper(status) = 'POSTED') AS posted, count_if(upper(status) = 'SKIPPED') AS skipped, count_if(upper(status) = 'REJECTED') AS rejected,
  count_if(upper(status) = 'FAILED') AS failed FROM v_posting_log""")
def log_stream(spark, d):
    """The log as a stream of files; its running summary is kept in a table."""
    source, target, at = (shared.new_path(spark, name) for name in ("log-in", "log-out", "log-checkpoint"))
    sinks.write_csv(report.log_rows(load(spark, d, "v_posting_log").withColumn("ad_number", F.col("ad_number").cast("string"))), source)
    ingest.keep_summary(ingest.log_stream(spark, source), target, at).awaitTermination()
    return spark.read.parquet(target)


#: Hosts with a hyphen, as terms that exclude addresses.
D_HOST_TERMS = r"SELECT DISTINCT replace(regexp_extract(url, '^https?://(?:m\.|www\.)?([a-z]+-[a-z]+)\.', 1), '-', ' ') AS term FROM pages WHERE regexp_matches(url, '^https?://(m\.|www\.)?[a-z]+-[a-z]+\.')"


@query(rf"""
WITH terms AS ({D_HOST_TERMS}),
every AS (SELECT url, html, page_id FROM pages UNION ALL SELECT url || '/again', html, page_id FROM pages),
f AS (SELECT url, arg_min(html, page_id) AS html FROM every GROUP BY url),
p AS (SELECT url, {d_lines("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")} AS own FROM f)
SELECT url AS source_url, coalesce(nullif(regexp_extract(url, '/(\d+)/?$', 1), ''), md5(url)) AS source_id, coalesce(own[1], '.') AS title, coalesce(own[2], '.') AS variant FROM p
WHERE NOT EXISTS (SELECT 1 FROM terms WHERE contains(replace(lower(url), '-', ' '), term))""")
def ingest_history(spark, d):
    """Two runs with exclusion terms: the pages, then the pages again beside as many new addresses; old ones are known from the history."""
    pages, target = load(spark, d, "pages"), shared.new_path(spark, "pages-out")
    host = F.regexp_extract("url", r"^https?://(?:m\.|www\.)?([a-z]+-[a-z]+)\.", 1)
    terms = pages.select(F.replace(host, F.lit("-"), F.lit(" ")).alias("term")).where("term <> ''").distinct()
    again = pages.withColumn("url", F.concat("url", F.lit("/again")))
    for run, rows in (("first", pages), ("second", pages.unionByName(again))):
        source, at = shared.new_path(spark, "pages-in"), shared.new_path(spark, "pages-checkpoint")
        rows.repartitionByRange(4, "page_id").write.parquet(source)
        ingest.ingest_pages(spark, source, target, at, terms, run=run).awaitTermination()
    return spark.read.parquet(target).select("source_url", "source_id", "title", "variant")


@query(r"""
SELECT DISTINCT url AS source_url, coalesce(nullif(regexp_extract(url, '/(\d+)/?$', 1), ''), md5(url)) AS source_id, (SELECT count(DISTINCT url) FROM pages) AS state_rows FROM pages WHERE url IS NOT NULL""")
def ingest_recent(spark, d):
    """Every page delivered twice, de-duplicated within a bounded time, with the rows that the state held at most."""
    source, target, at = (shared.new_path(spark, name) for name in ("pages-in", "pages-out", "pages-checkpoint"))
    for _ in range(2):
        load(spark, d, "pages").repartition(4).write.mode("append").parquet(source)
    running = ingest.keep(ingest.recent_pages(spark, source, files_per_batch=3), target, at)
    running.awaitTermination()
    held = max(s["state_rows"] for s in ingest.state_sizes(running))
    return spark.read.parquet(target).select("source_url", "source_id", F.lit(held).cast("long").alias("state_rows"))


#: When log rows arrive: five days at a time, one row in ten two deliveries late.
D_ARRIVED = """r AS (SELECT date_trunc('second', timestamp) AS seen, CAST(ad_number AS VARCHAR) AS ad_number, upper(coalesce(status, '')) AS status,
  (day(timestamp) - 1) // 5 + CASE WHEN ad_number % 10 = 0 THEN 2 ELSE 0 END AS g FROM v_posting_log),
h AS (SELECT g, max(seen) AS high FROM r GROUP BY g),
e AS (SELECT r.*, date_trunc('day', seen) AS began, coalesce(date_trunc('day', seen) + INTERVAL 1 DAY <= (SELECT max(high) FROM h WHERE h.g <= r.g - 2) - INTERVAL 1 DAY, false) AS late FROM r)"""


def delivered(spark: SparkSession, d: str) -> str:
    """The log as a folder of files, one for each delivery, in their order."""
    rows, source = load(spark, d, "v_posting_log"), shared.new_path(spark, "log-in")
    late = F.when(F.col("ad_number") % 10 == 0, 2).otherwise(0)
    rows = rows.withColumn("g", F.floor((F.day("timestamp") - 1) / 5) + late).withColumn("ad_number", F.col("ad_number").cast("string"))
    for g in range(8):
        sinks.csv_writer(report.log_rows(rows.where(F.col("g") == g)).coalesce(1)).mode("append").csv(source)
    return source


@query(f"""
WITH {D_ARRIVED}
SELECT CAST(began AS TIMESTAMP) AS day, count(*) AS total, {', '.join(f"count_if(status = '{s.upper()}') AS {s}" for s in ('posted', 'skipped', 'rejected', 'failed'))} FROM e
WHERE NOT late AND began + INTERVAL 1 DAY <= (SELECT max(seen) FROM r) - INTERVAL 1 DAY GROUP BY began""")
def log_daily(spark, d):
    """The log replayed out of order: days that the watermark has passed, each once and final."""
    target, at = shared.new_path(spark, "days"), shared.new_path(spark, "days-checkpoint")
    ingest.keep(ingest.daily_summary(ingest.log_stream(spark, delivered(spark, d), 1)), target, at).awaitTermination()
    return spark.read.parquet(target)


@query(f"WITH {D_ARRIVED} SELECT ad_number, seen AS timestamp, status, CAST(g AS BIGINT) AS batch FROM e WHERE late")
def log_late(spark, d):
    """The rows of the same replay that came after their day was closed."""
    target, at = shared.new_path(spark, "late"), shared.new_path(spark, "late-checkpoint")
    ingest.keep_late(ingest.log_stream(spark, delivered(spark, d), 1), target, at).awaitTermination()
    return ingest.late_rows(spark, target).select("ad_number", "timestamp", F.upper("status").alias("status"), "batch")


@query("""
SELECT date_trunc('second', timestamp) AS timestamp, CAST(coalesce(CAST(ad_number AS VARCHAR), '') AS VARCHAR) AS ad_number, coalesce(source_id, '') AS vehicle_id, '' AS source_url,
  '' AS year, '' AS make, '' AS model, '' AS variant, coalesce(status, '') AS status, coalesce(reason, '') AS reason FROM v_posting_log""")
def log_row(spark, d):
    rows = load(spark, d, "v_posting_log")
    return report.log_rows(rows.withColumn("ad_number", F.col("ad_number").cast("string")))


@query("""
SELECT count(*) AS total, count_if(upper(status) = 'POSTED') AS posted, count_if(upper(status) = 'SKIPPED') AS skipped, count_if(upper(status) = 'REJECTED') AS rejected,
  count_if(upper(status) = 'FAILED') AS failed FROM v_posting_log""")
def posting_summary(spark, d):
    return report.summary(load(spark, d, "v_posting_log"))


@query(f"""
WITH {D_MAPPED}, tagged AS (SELECT concat_ws('; ', {', '.join(D_SOURCE + D_FORM)}) <> '' AS bad,
  row_number() OVER (PARTITION BY source_id ORDER BY {', '.join(LISTING_ORDER)}) > 1 AS duplicate, l_linenumber % 3 AS k FROM mapped),
c AS (SELECT count(*) AS total, count_if(NOT duplicate AND NOT bad) AS valid, count_if(NOT duplicate AND bad) AS invalid, count_if(duplicate) AS duplicates,
  count_if(NOT duplicate AND NOT bad AND k = 0) AS successful, count_if(NOT duplicate AND NOT bad AND k = 1) AS failed, count_if(NOT duplicate AND NOT bad AND k = 2) AS skipped FROM tagged)
SELECT 'validate' AS run_id, total, valid, invalid, duplicates, 0 AS processed, 0 AS successful, 0 AS failed, 0 AS skipped FROM c
UNION ALL SELECT 'prepare', total, valid, invalid, duplicates, valid, 0, 0, 0 FROM c UNION ALL SELECT 'run', total, valid, invalid, duplicates, valid, successful, failed, skipped FROM c""")
def batch_report(spark, d):
    """The reports of all three modes, counted while the outcomes are written, as the report sink keeps them."""
    w = Window.partitionBy("source_id").orderBy(*LISTING_ORDER)
    outcome = F.when(F.col("l_linenumber") % 3 == 0, "posted").when(F.col("l_linenumber") % 3 == 1, "failed").otherwise("cancelled")
    tagged = audited(spark, d).select("source_id", (F.row_number().over(w) > 1).alias("duplicate"), F.size("errors").alias("errors"), outcome.alias("outcome"))
    path = shared.new_path(spark, "reports")
    reports = report.observed_reports(tagged, lambda rows: rows.write.parquet(shared.new_path(spark, "outcomes")))
    for mode in report.MODES:
        sinks.write_report(reports.where(F.col("run_id") == mode).drop("run_id"), path, mode)
    return spark.read.parquet(path).where("runtime >= 0").drop("runtime")


@query(f"""
SELECT doc_id, array_to_string({d_lines('text')}[1:3], ', ') AS first_features, CAST(len({d_lines('text')}) AS BIGINT) AS n_features,
  array_to_string(string_split(lang, '-')[1:2], ', ') AS first_highlights, CAST(1 AS BIGINT) AS n_images FROM documents""")
def record_preview(spark, d):
    shown = report.preview(lines(F.col("text")), F.split("lang", "-"), F.array("source"))
    return load(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in shown.items()])
