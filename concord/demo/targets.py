"""Target sides derived from the given tables, as SQL that Spark and DuckDB both run.

Source is the table as it is; the target of the same name has moved, changed, missing and extra rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = {
    "orders": ("o_orderkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "nation": ("n_nationkey",),
    "region": ("r_regionkey",),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "lineitem": (),
}

#: Buckets of the queries that compare by digests.
DIGEST_BUCKETS = 512

ORDERS = """
SELECT CASE WHEN o_orderkey % 101 = 3 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey,
       o_custkey,
       CASE WHEN o_orderkey % 31 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 37 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 41 = 9 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 53 <> 11
UNION ALL
SELECT o_orderkey + 200000000, o_custkey, o_orderstatus, o_totalprice * 2, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 211 = 1
"""

# A table that is the same but for a stretch of its keys.
ORDERS_LOCAL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey BETWEEN 700 AND 900 AND o_orderkey % 3 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey <> 801
"""

# The same with dates that moved by a day, as after a load at another time.
ORDERS_REDATED = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 31 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice,
       o_orderdate + INTERVAL 1 DAY AS o_orderdate,
       o_orderpriority
FROM {orders} WHERE o_orderkey % 53 <> 11
"""

LINEITEM = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_partkey % 97 = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem} WHERE l_orderkey % 89 <> 2
UNION ALL
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM {lineitem} WHERE l_orderkey % 173 = 4
"""

DOCUMENTS = """
SELECT doc_id,
       CASE WHEN doc_id % 7 = 2 THEN concat('inserted line', chr(10), text)
            WHEN doc_id % 7 = 4 THEN replace(text, 'the', 'THE')
            ELSE text END AS text,
       lang, CASE WHEN doc_id % 13 = 5 THEN 'moved' ELSE source END AS source, n_chars
FROM {documents} WHERE doc_id % 29 <> 3
"""

# Lines that moved: the first one to the end, the second one repeated in front.
DOCUMENT_LINES = """
SELECT doc_id,
       CASE WHEN doc_id % 5 = 1
            THEN substr(text, length(split_part(text, chr(10), 1)) + 2) || chr(10) || split_part(text, chr(10), 1)
            WHEN doc_id % 5 = 3 THEN split_part(text, chr(10), 2) || chr(10) || text
            WHEN doc_id % 7 = 4 THEN replace(text, 'the', 'THE')
            ELSE text END AS text,
       lang, source, n_chars
FROM {documents} WHERE doc_id % 29 <> 3
"""

EVENTS = """
SELECT event_id + 1000000 AS event_id, ts, user_id, event_type,
       CASE WHEN event_id % 50 = 7 THEN value + 1 ELSE value END AS value, props
FROM {events} WHERE event_id % 97 <> 3
"""

CUSTOMER = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, 'x' AS c_segment_code FROM {customer}
"""

# Customers from a system that writes names in its own case.
CUSTOMER_NAMES = """
SELECT c_custkey + 7 AS c_custkey,
       CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE c_name END AS c_name,
       c_nationkey, CASE WHEN c_custkey % 41 = 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
FROM {customer} WHERE c_custkey % 29 <> 3
"""

# Pages as reports: both sides have a flag and a body whose leading bytes tell its type.
PAGES_SOURCE = """
SELECT page_id, (page_id % 5 = 0 OR page_id % 35 = 2) AS is_pdf,
       CASE WHEN page_id % 5 = 0 THEN concat('%PDF-1.4 ', url)
            WHEN page_id % 5 = 1 THEN concat(chr(80), chr(75), chr(3), chr(4), url)
            ELSE html END AS body
FROM {pages}
"""

PAGES_TARGET = """
SELECT page_id, (page_id % 5 = 0 OR page_id % 35 = 2) AS is_pdf,
       CASE WHEN page_id % 5 = 0 AND page_id % 3 = 0 THEN html
            WHEN page_id % 5 = 0 THEN concat('%PDF-1.4 ', url)
            WHEN page_id % 5 = 1 THEN concat(chr(80), chr(75), chr(3), chr(4), url)
            ELSE html END AS body
FROM {pages} WHERE page_id % 23 <> 7
"""

# Documents as a store of schema objects with definitions.
OBJECTS_SOURCE = """
SELECT lang AS schema_name, concat('object_', CAST(doc_id AS STRING)) AS name,
       CASE WHEN doc_id % 4 = 0 THEN 'Table' WHEN doc_id % 4 = 1 THEN 'View'
            WHEN doc_id % 4 = 2 THEN 'Function' ELSE 'Stored procedure' END AS kind,
       CAST(NULL AS TIMESTAMP) AS modified_at,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS definition
FROM {documents} WHERE doc_id % 31 <> 6
"""

OBJECTS_TARGET = """
SELECT lang AS schema_name,
       CASE WHEN doc_id % 11 = 4 THEN upper(concat('object_', CAST(doc_id AS STRING)))
            ELSE concat('object_', CAST(doc_id AS STRING)) END AS name,
       CASE WHEN doc_id % 4 = 0 THEN 'Table' WHEN doc_id % 4 = 1 THEN 'View'
            WHEN doc_id % 4 = 2 THEN 'Function' ELSE 'Stored procedure' END AS kind,
       CAST(NULL AS TIMESTAMP) AS modified_at,
       CASE WHEN doc_id % 4 = 0 THEN NULL
            WHEN doc_id % 7 = 2 THEN concat('inserted line', chr(10), text)
            ELSE text END AS definition
FROM {documents} WHERE doc_id % 29 <> 3
"""

TARGETS = {
    "orders": ORDERS,
    "lineitem": LINEITEM,
    "documents": DOCUMENTS,
    "events": EVENTS,
    "customer": CUSTOMER,
}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def derive(spark: SparkSession, folder: str, table: str, sql: str) -> DataFrame:
    """The result of ``sql`` over one given table."""
    return spark.sql(sql, **{table: load(spark, folder, table)})
