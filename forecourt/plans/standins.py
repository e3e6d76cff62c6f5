"""Listing data made from the driver's tables: SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

VIEWS = {
    "v_listing": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS source_id,
       concat('https://feed.example.com/for-sale/used/', CAST(year(l_shipdate) AS STRING), '-', replace(p_name, ' ', '-'), '-R',
              CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), '-', replace(r_name, ' ', '-'), '-', p_type, '/',
              CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS source_url,
       concat(CAST(year(l_shipdate) AS STRING), ' ', p_name) AS title,
       CASE WHEN l_linenumber = 1 THEN '.' WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN NULL ELSE concat('  ', p_type, ' ') END AS variant,
       CASE WHEN l_returnflag = 'R' THEN p_brand END AS title_description,
       CASE WHEN l_linenumber = 7 THEN 'POA' WHEN l_linenumber = 6 THEN NULL
            ELSE concat('R ', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) END AS price,
       concat(CAST(CAST(l_quantity * 1000 AS BIGINT) AS STRING), ' km') AS mileage,
       CASE WHEN l_linestatus = 'O' THEN 'https://schema.org/UsedCondition' ELSE ' used ' END AS condition,
       CASE l_returnflag WHEN 'A' THEN 'White' WHEN 'N' THEN '.' END AS colour,
       s_name AS dealer_name, n_name AS dealer_address, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_exclusion": "SELECT concat(CAST(1992 + min(p_partkey) % 10 AS STRING), ' ', p_name) AS term FROM part GROUP BY p_name",
    "v_vehicle": """
SELECT source_id, condition, CASE l_linenumber % 3 WHEN 0 THEN 'AUTOMATIC' WHEN 1 THEN ' manual' END AS transmission,
       CASE l_suppkey % 3 WHEN 0 THEN 'Petrol' WHEN 1 THEN '' ELSE 'diesel' END AS fuel,
       CASE l_partkey % 4 WHEN 0 THEN '4x4' WHEN 1 THEN 'AWD' WHEN 2 THEN '4X2' END AS drive_type, colour,
       CASE WHEN l_suppkey % 5 = 0 THEN 'Elsewhere' WHEN l_suppkey % 7 = 0 THEN NULL ELSE dealer_address END AS location,
       title, variant AS description, price, mileage, source_url, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM v_listing""",
    "v_listing_image": """
SELECT CAST(l_orderkey AS STRING) AS source_id, l_linenumber AS pos, l_suppkey AS pos2, l_partkey AS pos3,
       concat(CAST(l_partkey AS STRING), CASE WHEN l_returnflag = 'R' THEN '.svg' ELSE '.jpg' END) AS image FROM lineitem""",
    "v_posting_log": """
SELECT ts AS timestamp, event_id AS ad_number, CAST(user_id AS STRING) AS source_id,
       CASE event_type WHEN 'purchase' THEN 'POSTED' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'Rejected' WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END AS status,
       props AS reason FROM events""",
    "v_form_option": """
SELECT * FROM (VALUES ('condition', 0, 'New'), ('condition', 1, 'Used'), ('colour', 0, 'WHITE'), ('colour', 1, 'white '), ('tag', 0, 'Wanted'),
                      ('tag', 1, 'For Sale'), ('transmission', 0, 'Manual'), ('transmission', 1, 'Automatic'), ('drive_type', 0, '4x4'),
                      ('drive_type', 1, '4x2')) AS t(field, pos, label) UNION ALL SELECT 'country', n_nationkey, n_name FROM nation""",
    "v_currency_option": """
SELECT s_nationkey AS form, s_suppkey AS pos, CASE s_suppkey % 6 WHEN 0 THEN 'Rs' WHEN 1 THEN 'Rupee' WHEN 2 THEN 'Rand (R)' WHEN 3 THEN ' R ' WHEN 4 THEN 'Euro' ELSE 'Other' END AS label,
       CASE s_suppkey % 11 WHEN 0 THEN 'zaR' WHEN 1 THEN NULL ELSE 'x' END AS value FROM supplier""",
    "v_queue": """
SELECT CAST(o_orderkey AS STRING) AS source_id, o_orderdate AS enqueued_at, o_orderpriority AS title,
       CASE o_orderstatus WHEN 'F' THEN 'y' WHEN 'O' THEN ' NO ' END AS decision FROM orders""",
}

#: Order keys, as positions carry meaning.
LISTING_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
IMAGE_ORDER = ["pos", "pos2", "pos3"]
QUEUE_ORDER = [("enqueued_at",), ("source_id", "bigint")]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of VIEWS."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in [*TABLES, *VIEWS] if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
    sql = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], VIEWS[name])
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})


def queue_order() -> list:
    return [F.col("enqueued_at"), F.col("source_id").cast("bigint")]


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names as CTEs."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    used = sorted({v for n in named for v in [n, *(w for w in VIEWS if re.search(rf"\b{w}\b", VIEWS[n]))]}, key=list(VIEWS).index)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in used]
    if not ctes:
        return sql
    head = "WITH " + ", ".join(ctes)
    return f"{head}, {sql[4:].lstrip()}" if sql.lstrip().startswith("WITH") else f"{head} {sql}"
