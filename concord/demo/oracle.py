"""The demo queries as plain SQL for another engine, written from the definitions rather than from the Spark code."""

from __future__ import annotations

from concord.demo import targets
from concord.demo.targets import DIGEST_BUCKETS

TABLES = ("orders", "lineitem", "documents", "events", "customer", "pages")

ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
#: Values of customers that are matched by name.
NAMED = ["c_nationkey", "c_acctbal"]
EVENT_VALUES = ["event_type", "value", "props"]
LINE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_VALUES = [name for name in LINE_COLUMNS if name not in LINE_KEY]


def _sql(text: str) -> str:
    return text.format(**{name: name for name in TABLES})


ORDERS = _sql(targets.ORDERS)
LINEITEM = _sql(targets.LINEITEM)


def _list(names: list[str], prefix: str = "") -> str:
    return ", ".join(prefix + name for name in names)


def _changed(values: list[str], left: str = "s.", right: str = "t.") -> str:
    """Changed columns as sorted, comma-joined text."""
    parts = [
        f"CASE WHEN {left}{name} IS DISTINCT FROM {right}{name} THEN '{name}' END" for name in sorted(values)
    ]
    return f"concat_ws(',', {', '.join(parts)})"


def _aligned(source: str, target: str, keys: list[str], values: list[str], extra_key: str | None = None) -> str:
    """CTEs s, t and d: the full outer join with category, changed columns and both sides."""
    join_keys = keys + ([extra_key] if extra_key else [])
    on = " AND ".join(f"s.{name} IS NOT DISTINCT FROM t.{name}" for name in join_keys)
    same = " AND ".join(f"s.{name} IS NOT DISTINCT FROM t.{name}" for name in values)
    return f"""
s AS (SELECT *, TRUE AS here FROM ({source})),
t AS (SELECT *, TRUE AS here FROM ({target})),
d AS (
  SELECT {', '.join(f'coalesce(s.{name}, t.{name}) AS {name}' for name in keys)},
         CASE WHEN s.here IS NULL THEN 'only_in_target' WHEN t.here IS NULL THEN 'only_in_source'
              WHEN {same} THEN 'matched' ELSE 'changed' END AS category,
         CASE WHEN s.here IS NULL OR t.here IS NULL THEN '' ELSE {_changed(values)} END AS changed_columns,
         {', '.join(f's.{name} AS source_{name}' for name in values)},
         {', '.join(f't.{name} AS target_{name}' for name in values)}
  FROM s FULL OUTER JOIN t ON {on}
)"""


ORDERS_DIFF = "WITH " + _aligned("SELECT * FROM orders", ORDERS, ["o_orderkey"], ORDER_VALUES)

COUNTS = """
count(*) FILTER (WHERE category <> 'only_in_target') AS source_rows,
count(*) FILTER (WHERE category <> 'only_in_source') AS target_rows,
count(*) FILTER (WHERE category = 'matched') AS matched,
count(*) FILTER (WHERE category = 'changed') AS changed,
count(*) FILTER (WHERE category = 'only_in_source') AS only_in_source,
count(*) FILTER (WHERE category = 'only_in_target') AS only_in_target
"""

# Orphans numbered by key inside their content, and the moved rows among them.
MOVED = f""",
o AS (
  SELECT category, o_orderkey, {', '.join(f'coalesce(source_{n}, target_{n}) AS {n}' for n in ORDER_VALUES)},
         row_number() OVER (PARTITION BY category,
           {', '.join(f'coalesce(source_{n}, target_{n})' for n in ORDER_VALUES)} ORDER BY o_orderkey) AS n
  FROM d WHERE category IN ('only_in_source', 'only_in_target')
),
m AS (
  SELECT a.o_orderkey AS source_key, b.o_orderkey AS target_key, {_list(ORDER_VALUES, 'a.')}
  FROM o a JOIN o b ON a.category = 'only_in_source' AND b.category = 'only_in_target' AND a.n = b.n
   AND {' AND '.join(f'a.{n} IS NOT DISTINCT FROM b.{n}' for n in ORDER_VALUES)}
),
r AS (
  SELECT o_orderkey, category, changed_columns, NULL::BIGINT AS target_o_orderkey,
         {_list(ORDER_VALUES, 'source_')}, {_list(ORDER_VALUES, 'target_')}
  FROM d
  WHERE category = 'changed'
     OR (category = 'only_in_source' AND o_orderkey NOT IN (SELECT source_key FROM m))
     OR (category = 'only_in_target' AND o_orderkey NOT IN (SELECT target_key FROM m))
  UNION ALL
  SELECT source_key, 'reassigned', '', target_key, {_list(ORDER_VALUES)}, {_list(ORDER_VALUES)} FROM m
)"""

VERDICT = """
changed + missing_from_target + missing_from_source + reassigned > 0 AS has_differences,
CASE WHEN source_rows = 0 THEN 0.0::DOUBLE
     ELSE (changed + missing_from_target + missing_from_source + reassigned) * 100.0::DOUBLE / source_rows
END AS percent_differs
"""

ORDERS_COUNTS = f"""
SELECT 'dbo.orders' AS table_name, 'keyed' AS comparison, FALSE AS keys_only, source_rows, target_rows, matched, changed,
       only_in_source - moved AS missing_from_target, only_in_target - moved AS missing_from_source, moved AS reassigned
FROM (SELECT {COUNTS} FROM d), (SELECT count(*) AS moved FROM m)
"""


def _text(name: str, kind: str = "plain") -> str:
    """Canonical text of a column: NULL marker, escaped separator."""
    if kind == "text":
        inner = f"replace(replace({name}, '\\', '\\\\'), chr(31), '\\s')"
    elif kind == "time":
        inner = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
    else:
        inner = f"CAST({name} AS VARCHAR)"
    return f"coalesce({inner}, '\\N')"


def _hash(columns: list[tuple[str, str]]) -> str:
    return f"upper(sha256(concat_ws(chr(31), {', '.join(_text(name, kind) for name, kind in columns)})))"


ORDER_HASH = _hash(
    [
        ("o_custkey", "plain"),
        ("o_orderstatus", "text"),
        ("o_totalprice", "plain"),
        ("o_orderdate", "time"),
        ("o_orderpriority", "text"),
    ]
)

LINE_KINDS = [(name, {"l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}.get(name, "plain")) for name in LINE_COLUMNS]

PART_CONTENT = ["l_partkey", "l_returnflag", "l_linestatus"]
PART_HASH = _hash([("l_partkey", "plain"), ("l_returnflag", "text"), ("l_linestatus", "text")])


def _multiset(columns: list[str]) -> str:
    names = _list(columns)
    return f"""WITH c AS (
  SELECT {names}, sum(in_source)::BIGINT AS source_count, sum(in_target)::BIGINT AS target_count
  FROM (SELECT {names}, 1 AS in_source, 0 AS in_target FROM lineitem
        UNION ALL SELECT {names}, 0, 1 FROM ({LINEITEM}))
  GROUP BY {names}
)"""


MULTISET_TOTALS = """
SELECT sum(source_count)::BIGINT AS source_rows, sum(target_count)::BIGINT AS target_rows,
       sum(least(source_count, target_count))::BIGINT AS matched,
       sum(greatest(source_count - target_count, 0))::BIGINT AS missing_from_target,
       sum(greatest(target_count - source_count, 0))::BIGINT AS missing_from_source,
       count(*) FILTER (WHERE source_count <> target_count) AS differing_contents
FROM c"""

BOUNDARIES = """
boundaries AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS boundary_no, o_orderkey AS boundary
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)
  WHERE position > 0 AND position % CAST(ceil(n / 5.0) AS BIGINT) = 0
)"""


def _composite(table: str, names: list[str]) -> str:
    """Boundaries over several key columns, by their place in the sorted table."""
    order = ", ".join(names)
    return f"""WITH boundaries AS (
  SELECT row_number() OVER (ORDER BY {order}) AS boundary_no, {order} FROM (
    SELECT DISTINCT {order} FROM (
      SELECT {order}, row_number() OVER (ORDER BY {order}) - 1 AS position, count(*) OVER () AS n FROM {table})
    WHERE position > 0 AND position % CAST(ceil(n / 5.0) AS BIGINT) = 0))"""


RANGES = (
    BOUNDARIES
    + """,
ranges AS (
  SELECT boundary_no AS bucket, lag(boundary) OVER (ORDER BY boundary_no) AS lower, boundary AS upper FROM boundaries
  UNION ALL SELECT max(boundary_no) + 1, max(boundary), NULL FROM boundaries
),
labelled AS (
  SELECT CAST(bucket AS INTEGER) AS bucket, lower, upper,
         'Chunk ' || bucket || ' of ' || (SELECT count(*) FROM ranges) || ' (' ||
         CASE WHEN lower IS NULL THEN 'o_orderkey ≤ ' || format('{:,}', upper)
              WHEN upper IS NULL THEN 'o_orderkey > ' || format('{:,}', lower)
              ELSE 'o_orderkey ' || format('{:,}', lower) || ' – ' || format('{:,}', upper) END || ')' AS label
  FROM ranges
)"""
)

# Column lists of the given tables: name, type as reported, whether the type has a length.
SOURCE_COLUMNS = {
    "orders": [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "varchar"),
        ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "varchar"),
    ],
    "customer": [
        ("c_custkey", "bigint"),
        ("c_name", "varchar"),
        ("c_nationkey", "int"),
        ("c_acctbal", "double"),
        ("c_mktsegment", "varchar"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"),
        ("l_partkey", "bigint"),
        ("l_suppkey", "bigint"),
        ("l_linenumber", "int"),
        ("l_quantity", "double"),
        ("l_extendedprice", "double"),
        ("l_discount", "double"),
        ("l_tax", "double"),
        ("l_returnflag", "varchar"),
        ("l_linestatus", "varchar"),
        ("l_shipdate", "timestamp_ntz"),
    ],
    "part": [
        ("p_partkey", "bigint"),
        ("p_name", "varchar"),
        ("p_brand", "varchar"),
        ("p_type", "varchar"),
        ("p_size", "int"),
        ("p_retailprice", "double"),
    ],
    "supplier": [
        ("s_suppkey", "bigint"),
        ("s_name", "varchar"),
        ("s_nationkey", "int"),
        ("s_acctbal", "double"),
    ],
    "nation": [("n_nationkey", "int"), ("n_name", "varchar"), ("n_regionkey", "int")],
}
TARGET_COLUMNS = {name: SOURCE_COLUMNS[name] for name in ("orders", "lineitem", "part", "supplier")}
TARGET_COLUMNS["customer"] = [
    ("c_custkey", "bigint"),
    ("c_name", "varchar"),
    ("c_nationkey", "bigint"),
    ("c_acctbal", "double"),
    ("c_segment_code", "varchar"),
]


def _columns(tables: dict[str, list[tuple[str, str]]], rows: dict[str, str]) -> str:
    """One SELECT per column, with length and nullability measured on the rows."""
    parts = []
    for table, columns in tables.items():
        key = targets.KEYS[table]
        for ordinal, (name, kind) in enumerate(columns, start=1):
            length = f"CAST(coalesce(max(octet_length(encode({name}))), 0) AS INTEGER)" if kind == "varchar" else "0"
            is_key = name in key
            parts.append(
                f"SELECT 'dbo' AS schema_name, '{table}' AS table_name, 'Table' AS kind, '{name}' AS column_name, "
                f"{ordinal} AS ordinal, '{kind}' AS data_type, {length} AS max_length, 0 AS precision, 0 AS scale, "
                f"count(*) > count({name}) AS is_nullable, FALSE AS is_identity, {str(is_key).upper()} AS is_primary_key, "
                f"{key.index(name) + 1 if is_key else 0} AS primary_key_ordinal FROM ({rows[table]})"
            )
    return "\nUNION ALL ".join(parts)


SOURCE_ROWS = {name: f"SELECT * FROM {name}" for name in SOURCE_COLUMNS}
TARGET_ROWS = {
    **{name: f"SELECT * FROM {name}" for name in ("part", "supplier")},
    "orders": ORDERS,
    "lineitem": LINEITEM,
    "customer": _sql(targets.CUSTOMER),
}
SOURCE_SCHEMA = _columns(SOURCE_COLUMNS, SOURCE_ROWS)
TARGET_SCHEMA = _columns(TARGET_COLUMNS, TARGET_ROWS)

DDL_LINE = """'[' || column_name || '] [' || data_type || ']' ||
CASE WHEN data_type = 'varchar' THEN '(' || max_length || ')' ELSE '' END ||
CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END"""

SCHEMAS = f"WITH sc AS (SELECT *, {DDL_LINE} AS line FROM ({SOURCE_SCHEMA})), tc AS (SELECT *, {DDL_LINE} AS line FROM ({TARGET_SCHEMA}))"

OBJECTS = f"WITH so AS ({_sql(targets.OBJECTS_SOURCE)}), ob AS ({_sql(targets.OBJECTS_TARGET)})" + """,
oc AS (
  SELECT coalesce(so.schema_name || '.' || so.name, ob.schema_name || '.' || ob.name) AS full_name,
         coalesce(so.kind, ob.kind) AS kind,
         CASE WHEN ob.name IS NULL THEN 'Only in Source' WHEN so.name IS NULL THEN 'Only in Target'
              WHEN so.definition IS DISTINCT FROM ob.definition THEN 'Different' ELSE 'Identical' END AS object_class,
         so.schema_name AS source_schema, so.name AS source_name, so.kind AS source_kind,
         ob.schema_name AS target_schema, ob.name AS target_name, ob.kind AS target_kind
  FROM so FULL OUTER JOIN ob
    ON lower(so.schema_name || '.' || so.name) = lower(ob.schema_name || '.' || ob.name)
   AND (so.kind IN ('Table', 'View')) = (ob.kind IN ('Table', 'View'))
)"""



def _docs(target: str) -> str:
    return f"""
p AS (SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, replace(s.text, chr(13) || chr(10), chr(10)) AS a, replace(t.text, chr(13) || chr(10), chr(10)) AS b
      FROM documents s FULL OUTER JOIN ({_sql(target)}) t ON s.doc_id = t.doc_id WHERE s.text IS DISTINCT FROM t.text),
la AS (SELECT doc_id, unnest(string_split(a, chr(10))) AS line, unnest(range(1, len(string_split(a, chr(10))) + 1)) AS n FROM p),
lb AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, unnest(range(1, len(string_split(b, chr(10))) + 1)) AS n FROM p)
"""


DOCS = _docs(targets.DOCUMENTS)


def _alignment(rounds: int) -> str:
    """Rounds of patience alignment: levels of the longest increasing run by recursion, then its trace from the end."""
    steps = [
        f"""{_docs(targets.DOCUMENT_LINES)},
o0 AS MATERIALIZED (SELECT doc_id, 0 AS g, TRUE AS src, n, line FROM la UNION ALL SELECT doc_id, 0, FALSE, n, line FROM lb)"""
    ]
    for r in range(rounds):
        steps.append(f"""
n{r} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, line, src ORDER BY n) AS k,
                count(*) OVER (PARTITION BY doc_id, g, line, src) AS times FROM o{r}),
e{r} AS MATERIALIZED (
  SELECT doc_id, g, s, t FROM (
    SELECT doc_id, g, line, k, max(n) FILTER (src) AS s, max(n) FILTER (NOT src) AS t, max(times) = 1 AS alone
    FROM n{r} GROUP BY ALL) WHERE s IS NOT NULL AND t IS NOT NULL
  QUALIFY alone = bool_or(alone) OVER (PARTITION BY doc_id, g)),
v{r} AS (SELECT doc_id, g, s, t, 1 AS lvl FROM e{r} UNION
  SELECT b.doc_id, b.g, b.s, b.t, v.lvl + 1 FROM v{r} v JOIN e{r} b ON b.doc_id = v.doc_id AND b.g = v.g AND b.s > v.s AND b.t > v.t),
l{r} AS MATERIALIZED (SELECT doc_id, g, s, t, max(lvl) AS lvl FROM v{r} GROUP BY ALL),
b{r} AS MATERIALIZED (SELECT a.doc_id, a.g, a.s, a.t, a.lvl, max(b.s) AS before FROM l{r} a
  LEFT JOIN l{r} b ON a.doc_id = b.doc_id AND a.g = b.g AND b.lvl = a.lvl - 1 AND b.s < a.s GROUP BY ALL),
w{r} AS (SELECT * FROM (FROM b{r} QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY lvl DESC, s DESC) = 1) UNION ALL
  SELECT b.* FROM w{r} w JOIN b{r} b ON b.doc_id = w.doc_id AND b.g = w.g AND b.s = w.before),
x{r} AS MATERIALIZED (SELECT o.doc_id, o.src, o.n, o.line, w.s, w.t,
    coalesce(max(w.s) OVER (PARTITION BY o.doc_id, o.g, o.src ORDER BY o.n), o.g) AS g
  FROM o{r} o LEFT JOIN w{r} w ON o.doc_id = w.doc_id AND o.g = w.g AND o.n = IF(o.src, w.s, w.t)),
o{r + 1} AS MATERIALIZED (SELECT doc_id, g, src, n, line FROM x{r} WHERE s IS NULL)""")
    same = " UNION ALL ".join(f"SELECT doc_id, s AS g, 0 AS kind, s, t, line FROM x{r} WHERE src AND s IS NOT NULL" for r in range(rounds))
    return f"""WITH RECURSIVE {','.join(steps)}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, kind, coalesce(s, t)) AS INTEGER) AS position,
       CAST(s AS INTEGER) AS source_line_no, CAST(t AS INTEGER) AS target_line_no, line,
       CASE kind WHEN 0 THEN 'same' WHEN 1 THEN 'only_source' ELSE 'only_target' END AS status
FROM ({same} UNION ALL SELECT doc_id, g, IF(src, 1, 2), IF(src, n, NULL), IF(src, NULL, n), line FROM o{rounds})"""


PAGES = f"WITH s AS ({_sql(targets.PAGES_SOURCE)}), t AS ({_sql(targets.PAGES_TARGET)})"
BODY_TYPE = """CASE WHEN {0} IS NULL THEN NULL WHEN left({0}, 4) = '%PDF' THEN '.pdf'
WHEN left({0}, 4) = 'PK' || chr(3) || chr(4) THEN '.xlsx' ELSE '.bin' END"""


def _keyed_totals(source: str, target: str, keys: list[str], values: list[str]) -> str:
    return f"WITH {_aligned(source, target, keys, values)} SELECT {COUNTS} FROM d"


def _run() -> str:
    """The summary rows of the five compared tables."""
    customer_equal = "s.c_name IS NOT DISTINCT FROM t.c_name AND s.c_acctbal IS NOT DISTINCT FROM t.c_acctbal"
    return f"""{ORDERS_DIFF}{MOVED},
c AS ({_multiset(LINE_COLUMNS)} SELECT * FROM c),
cu AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE s.c_nationkey IS NULL AND t.c_nationkey IS NULL AND {customer_equal}) AS same,
         count(*) FILTER (WHERE {customer_equal} AND s.c_nationkey IS NOT DISTINCT FROM t.c_nationkey) AS same_value
  FROM customer s JOIN ({_sql(targets.CUSTOMER)}) t ON s.c_custkey = t.c_custkey
),
run AS (
  {ORDERS_COUNTS}
  UNION ALL SELECT 'dbo.customer', 'keyed', FALSE, n, n, same, n - same, 0, 0, 0 FROM cu
  UNION ALL SELECT 'dbo.lineitem', 'multiset', FALSE, source_rows, target_rows, matched, 0, missing_from_target,
                   missing_from_source, 0 FROM ({MULTISET_TOTALS})
  UNION ALL SELECT 'dbo.part', 'keyed', FALSE, count(*), count(*), count(*), 0, 0, 0, 0 FROM part
  UNION ALL SELECT 'dbo.supplier', 'keyed', FALSE, count(*), count(*), count(*), 0, 0, 0, 0 FROM supplier
)"""


RUN = _run()


def _json(prefix: str) -> str:
    def text(name: str) -> str:
        column = prefix + name
        if name == "o_orderdate":
            value = f"'\"' || strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') || '\"'"
        elif name in ("o_orderstatus", "o_orderpriority"):
            value = f"'\"' || {column} || '\"'"
        else:
            value = f"CAST({column} AS VARCHAR)"
        return f"'\"{name}\":' || coalesce({value}, 'null')"

    return "'{' || " + " || ',' || ".join(text(name) for name in ORDER_VALUES) + " || '}'"


def _cells() -> str:
    parts = [
        """SELECT category, 'o_orderkey=' || o_orderkey AS row_key, 0 AS column_no, 'o_orderkey' AS column_name,
  CASE WHEN category = 'only_in_target' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS source_value,
  CASE category WHEN 'only_in_source' THEN '' WHEN 'reassigned' THEN CAST(target_o_orderkey AS VARCHAR)
       ELSE CAST(o_orderkey AS VARCHAR) END AS target_value,
  CASE category WHEN 'reassigned' THEN 'ExpectedDifference' WHEN 'changed' THEN 'Matched' ELSE 'RealDifference' END AS cell_kind
FROM r"""
    ]
    for number, name in enumerate(ORDER_VALUES, start=1):
        parts.append(
            f"""SELECT category, 'o_orderkey=' || o_orderkey, {number}, '{name}',
  CASE WHEN category = 'only_in_target' THEN '' ELSE coalesce(CAST(source_{name} AS VARCHAR), 'NULL') END,
  CASE WHEN category = 'only_in_source' THEN '' ELSE coalesce(CAST(target_{name} AS VARCHAR), 'NULL') END,
  CASE WHEN category = 'reassigned' OR (category = 'changed' AND source_{name} IS NOT DISTINCT FROM target_{name})
       THEN 'Matched' ELSE 'RealDifference' END
FROM r"""
        )
    return f"{ORDERS_DIFF}{MOVED}\n" + "\nUNION ALL ".join(parts)


def _dup_keys() -> str:
    def numbered(rows: str) -> str:
        order = ", ".join(f"{name} ASC NULLS FIRST" for name in LINE_VALUES)
        return f"SELECT *, row_number() OVER (PARTITION BY {_list(LINE_KEY)} ORDER BY {order}) AS n FROM ({rows})"

    aligned = _aligned(numbered("SELECT * FROM lineitem"), numbered(LINEITEM), LINE_KEY, LINE_VALUES, "n")
    return f"WITH {aligned} SELECT * FROM d"


def _excluded(target: str, values: list[str]) -> str:
    return f"WITH {_aligned('SELECT * FROM orders', target, ['o_orderkey'], values)} SELECT * FROM d"


def _key_range() -> str:
    bounds = "o_orderkey > (SELECT min(boundary) FROM boundaries) AND o_orderkey <= (SELECT max(boundary) FROM boundaries)"
    aligned = _aligned(
        f"SELECT * FROM orders WHERE {bounds}", f"SELECT * FROM ({ORDERS}) WHERE {bounds}", ["o_orderkey"], ORDER_VALUES
    )
    return f"WITH {BOUNDARIES}, {aligned} SELECT * FROM d"


def _large_text() -> str:
    source, target = (
        f"SELECT doc_id, sha256(text) AS text, lang, source, n_chars FROM ({rows})"
        for rows in ("SELECT * FROM documents", _sql(targets.DOCUMENTS))
    )
    return f"WITH {_aligned(source, target, ['doc_id'], ['text', 'lang', 'source', 'n_chars'])} SELECT * FROM d"


def _samples() -> str:
    order = ", ".join(f"x.{name} ASC NULLS FIRST" for name in LINE_COLUMNS)
    same = " AND ".join(f"x.{name} IS NOT DISTINCT FROM w.{name}" for name in PART_CONTENT)

    def side(rows: str, name: str, condition: str) -> str:
        return f"""SELECT * FROM (
  SELECT {_hash([('x.l_partkey', 'plain'), ('x.l_returnflag', 'text'), ('x.l_linestatus', 'text')])} AS content_hash,
         source_count, target_count, '{name}' AS sampled_side,
         row_number() OVER (PARTITION BY {_list(PART_CONTENT, 'x.')} ORDER BY {order}) AS sample_no, {_list(LINE_COLUMNS, 'x.')}
  FROM ({rows}) x JOIN c w ON {same} WHERE {condition}
) WHERE sample_no <= 3"""

    return (
        _multiset(PART_CONTENT)
        + side("SELECT * FROM lineitem", "source", "source_count > target_count")
        + "\nUNION ALL "
        + side(LINEITEM, "target", "target_count > source_count")
    )


def _percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE ({part}) * 100.0::DOUBLE / ({whole}) END"


def _accepted() -> str:
    taken = "r.category = 'reassigned' OR r.changed_columns = 'o_orderpriority'"
    return f"""{ORDERS_DIFF}{MOVED}, b AS ({ORDERS_COUNTS}),
a AS (SELECT count(*) FILTER (WHERE category = 'changed') AS c, count(*) FILTER (WHERE category = 'reassigned') AS m
      FROM r WHERE {taken})
SELECT table_name, source_rows, target_rows, matched, changed - c AS changed, missing_from_target, missing_from_source,
       reassigned - m AS reassigned, c + m AS accepted,
       changed - c + missing_from_target + missing_from_source + reassigned - m > 0 AS has_differences
FROM b, a"""


def _profile() -> str:
    parts = [
        f"SELECT '{name}' AS column_name, count(*) FILTER (WHERE source_{name} IS DISTINCT FROM target_{name}) AS changed_count, "
        "count(*) AS changed_rows FROM d WHERE category = 'changed'"
        for name in ORDER_VALUES
    ]
    return (
        ORDERS_DIFF
        + " SELECT *, CASE WHEN changed_rows = 0 THEN 0.0::DOUBLE ELSE changed_count::DOUBLE / changed_rows END AS share FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


def _policies() -> str:
    target = _sql(targets.CUSTOMER)
    values = ["c_name", "c_nationkey", "c_acctbal"]
    coerced = _aligned("SELECT * FROM customer", target, ["c_custkey"], values)
    # Integers of different width are unequal under the strict policy unless both are NULL.
    strict = coerced.replace(
        "s.c_nationkey IS NOT DISTINCT FROM t.c_nationkey", "(s.c_nationkey IS NULL AND t.c_nationkey IS NULL)"
    )
    return (
        f"SELECT * FROM (WITH {strict} SELECT {COUNTS}, 'strict' AS type_policy FROM d) UNION ALL "
        f"SELECT * FROM (WITH {coerced} SELECT {COUNTS}, 'coerce' AS type_policy FROM d)"
    )


def _row_counts(tables: dict[str, str], others: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'dbo.{name}' AS table_name, (SELECT count(*) FROM ({tables[name]})) AS source_rows, "
        + (f"(SELECT count(*) FROM ({others[name]}))" if name in others else "NULL::BIGINT")
        + " AS target_rows"
        for name in tables
    )


def _common_columns() -> str:
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    return " UNION ALL ".join(
        f"SELECT {i} AS column_no, '{name}' AS column_name, (SELECT count({name}) FROM customer) AS source_filled, "
        f"(SELECT count({name}) FROM ({_sql(targets.CUSTOMER)})) AS target_filled"
        for i, name in enumerate(names)
    )


FACETS = ["data_type", "max_length", "precision", "scale", "is_nullable", "is_identity", "is_primary_key"]


def _column_diff() -> str:
    facets = ", ".join(f"CASE WHEN sc.{name} IS DISTINCT FROM tc.{name} THEN '{name}' END" for name in FACETS)
    return f"""{SCHEMAS}
SELECT * FROM (
  SELECT coalesce('dbo.' || sc.table_name, 'dbo.' || tc.table_name) AS full_name,
         coalesce(sc.column_name, tc.column_name) AS column_name,
         CASE WHEN tc.column_name IS NULL THEN 'Only in Source' WHEN sc.column_name IS NULL THEN 'Only in Target'
              ELSE 'Changed' END AS change,
         CASE WHEN tc.column_name IS NULL OR sc.column_name IS NULL THEN '' ELSE concat_ws(',', {facets}) END AS changed_facets,
         sc.data_type AS source_type, tc.data_type AS target_type
  FROM sc FULL OUTER JOIN tc ON sc.table_name = tc.table_name AND sc.column_name = tc.column_name
) WHERE (change <> 'Changed' OR changed_facets <> '') AND full_name <> 'dbo.nation'"""


def _ddl_diff() -> str:
    return f"""{SCHEMAS},
j AS (
  SELECT coalesce(sc.table_name, tc.table_name) AS tab, sc.line AS a, tc.line AS b,
         row_number() OVER (PARTITION BY coalesce(sc.table_name, tc.table_name)
                            ORDER BY sc.line IS NULL, coalesce(sc.ordinal, tc.ordinal)) AS n,
         count(*) OVER (PARTITION BY coalesce(sc.table_name, tc.table_name)) AS total
  FROM sc FULL OUTER JOIN tc ON sc.table_name = tc.table_name AND sc.column_name = tc.column_name
),
f AS (SELECT tab, max(total) AS total, bool_or(a IS NOT NULL) AS has_a, bool_or(b IS NOT NULL) AS has_b FROM j GROUP BY tab),
lines AS (
  SELECT tab, CAST(n + 2 AS INTEGER) AS line_no, '    ' || a || CASE WHEN n = total THEN '' ELSE ',' END AS source_text,
         '    ' || b || CASE WHEN n = total THEN '' ELSE ',' END AS target_text, a IS DISTINCT FROM b AS highlight FROM j
  UNION ALL SELECT tab, 1, CASE WHEN has_a THEN 'CREATE TABLE [dbo].[' || tab || ']' END,
                   CASE WHEN has_b THEN 'CREATE TABLE [dbo].[' || tab || ']' END, NOT (has_a AND has_b) FROM f
  UNION ALL SELECT tab, 2, CASE WHEN has_a THEN '(' END, CASE WHEN has_b THEN '(' END, NOT (has_a AND has_b) FROM f
  UNION ALL SELECT tab, CAST(total + 3 AS INTEGER), CASE WHEN has_a THEN ')' END, CASE WHEN has_b THEN ')' END,
                   NOT (has_a AND has_b) FROM f
)
SELECT 'dbo.' || tab AS full_name, line_no, source_text, target_text, highlight FROM lines"""


def _kinds() -> str:
    labels = {"Table": "Tables", "View": "Views", "Function": "Functions"}
    parts = [
        f"""SELECT '{label}' AS kind, 'compared' AS status, count(*) FILTER (WHERE source_kind = '{kind}') AS source_count,
  count(*) FILTER (WHERE target_kind = '{kind}') AS target_count,
  count(*) FILTER (WHERE source_kind = '{kind}' AND object_class = 'Only in Source') AS only_in_source,
  count(*) FILTER (WHERE target_kind = '{kind}' AND object_class = 'Only in Target') AS only_in_target,
  count(*) FILTER (WHERE source_kind = '{kind}' AND object_class = 'Different') AS different FROM oc"""
        for kind, label in labels.items()
    ]
    percent = _percent("only_in_source + only_in_target + different", "source_count + only_in_target")
    return f"""{OBJECTS}
SELECT *, {percent} AS difference_percent FROM ({' UNION ALL '.join(parts)})
UNION ALL SELECT 'Stored Procedures', 'not compared', NULL, NULL, NULL, NULL, NULL, NULL"""


ORACLE: dict[str, str] = {
    "keyed_diff_rows": f"{ORDERS_DIFF} SELECT * FROM d",
    "keyed_diff_counts": f"{ORDERS_DIFF} SELECT {COUNTS} FROM d",
    "only_in_source": f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({ORDERS}))",
    "only_in_target": f"SELECT * FROM ({ORDERS}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "matched_rows": f"SELECT o.* FROM orders o JOIN ({ORDERS}) t ON o.o_orderkey = t.o_orderkey AND "
    + " AND ".join(f"o.{name} IS NOT DISTINCT FROM t.{name}" for name in ORDER_VALUES),
    "changed_rows": f"{ORDERS_DIFF} SELECT * EXCLUDE (category) FROM d WHERE category = 'changed'",
    "cell_diff": _cells(),
    "keyed_diff_default_exclusions": _excluded(
        _sql(targets.ORDERS_REDATED), ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    ),
    "keyed_diff_excluded": _excluded(ORDERS, ["o_custkey", "o_orderstatus", "o_orderpriority"]),
    "keyed_diff_custom_key": "WITH "
    + _aligned("SELECT * FROM events", _sql(targets.EVENTS), ["user_id", "ts"], EVENT_VALUES)
    + " SELECT * FROM d",
    "keyed_diff_type_policy": _policies(),
    "keyed_diff_range": _key_range(),
    "keyed_diff_large_text": _large_text(),
    "keyed_diff_dup_keys": _dup_keys(),
    "reassigned_rows": f"{ORDERS_DIFF}{MOVED} SELECT source_key AS source_o_orderkey, target_key AS target_o_orderkey, "
    f"{_list(ORDER_VALUES)} FROM m",
    "keyed_diff_reconciled": f"{ORDERS_DIFF}{MOVED} SELECT * FROM r",
    "orphan_content_counts": f"{ORDERS_DIFF}{MOVED} SELECT {ORDER_HASH} AS content_hash, "
    "count(*) FILTER (WHERE category = 'only_in_source') AS only_in_source, "
    "count(*) FILTER (WHERE category = 'only_in_target') AS only_in_target FROM o GROUP BY 1",
    "reassigned_count": f"{ORDERS_DIFF}{MOVED} SELECT count(*) AS reassigned FROM m",
    "large_content_pairs": f"""SELECT coalesce(s.doc_id, t.doc_id) AS doc_id,
  CASE WHEN t.doc_id IS NULL THEN 'only_in_source' WHEN s.doc_id IS NULL THEN 'only_in_target' ELSE 'changed' END AS category,
  s.text AS source_content, t.text AS target_content
FROM documents s FULL OUTER JOIN ({_sql(targets.DOCUMENTS)}) t ON s.doc_id = t.doc_id
WHERE s.doc_id IS NULL OR t.doc_id IS NULL OR s.text IS DISTINCT FROM t.text""",
    "row_hash": f"SELECT {_list(LINE_COLUMNS)}, {_hash(LINE_KINDS)} AS row_hash FROM lineitem",
    "hash_counts": f"SELECT {_hash(LINE_KINDS)} AS row_hash, count(*) AS occurrences FROM ({LINEITEM}) GROUP BY 1",
    "multiset_diff_counts": _multiset(LINE_COLUMNS) + MULTISET_TOTALS,
    "multiset_diff_rows": _multiset(LINE_COLUMNS)
    + " SELECT *, greatest(source_count - target_count, 0) AS missing_from_target, "
    "greatest(target_count - source_count, 0) AS missing_from_source FROM c WHERE source_count <> target_count",
    "top_discrepancies": _multiset(PART_CONTENT)
    + f" SELECT {PART_HASH} AS content_hash, *, abs(source_count - target_count) AS delta FROM c "
    "WHERE source_count <> target_count ORDER BY delta DESC, content_hash LIMIT 10",
    "hash_samples": _samples(),
    "rows_missing_from_target": f"SELECT {_list(LINE_COLUMNS)} FROM lineitem EXCEPT ALL SELECT * FROM ({LINEITEM})",
    "rows_missing_from_source": f"SELECT * FROM ({LINEITEM}) EXCEPT ALL SELECT {_list(LINE_COLUMNS)} FROM lineitem",
    "rows_common": f"SELECT {_list(LINE_COLUMNS)} FROM lineitem INTERSECT ALL SELECT * FROM ({LINEITEM})",
    "table_summary": f"{ORDERS_DIFF}{MOVED} SELECT *, {VERDICT} FROM ({ORDERS_COUNTS})",
    "table_summary_by_digest": f"{ORDERS_DIFF}{MOVED} SELECT *, {VERDICT} FROM ({ORDERS_COUNTS})",
    "multiset_summary_by_digest": f"""WITH m AS (
  SELECT *, 0::BIGINT AS changed, 0::BIGINT AS reassigned FROM ({_multiset(LINE_COLUMNS)} {MULTISET_TOTALS}))
SELECT 'dbo.lineitem' AS table_name, 'multiset' AS comparison, FALSE AS keys_only, * EXCLUDE (differing_contents), {VERDICT} FROM m""",
    "report_summary": f"{RUN} SELECT *, {VERDICT} FROM run ORDER BY has_differences DESC, lower(table_name)",
    "run_rollup": f"""{RUN} SELECT count(*) AS tables_compared,
  count(*) FILTER (WHERE changed + missing_from_target + missing_from_source + reassigned > 0) AS tables_differing,
  {', '.join(f'sum({n})::BIGINT AS {n}' for n in ('source_rows', 'target_rows', 'matched', 'changed', 'missing_from_target', 'missing_from_source', 'reassigned'))}
FROM run""",
    "recompare_merge": f"""{RUN}, merged AS (
  SELECT * FROM run WHERE table_name <> 'dbo.customer'
  UNION ALL SELECT 'dbo.customer', 'keyed', FALSE, n, n, same_value, n - same_value, 0, 0, 0 FROM cu)
SELECT *, {VERDICT} FROM merged""",
    "combine_summaries": f"{ORDERS_DIFF}{MOVED} SELECT * EXCLUDE (comparison, keys_only), {VERDICT} FROM ({ORDERS_COUNTS})",
    "incremental_summary": f"{ORDERS_DIFF}{MOVED} SELECT * EXCLUDE (comparison, keys_only), {VERDICT} FROM ({ORDERS_COUNTS})",
    "changed_column_profile": _profile(),
    "accepted_summary": _accepted(),
    "capped_examples": f"""{ORDERS_DIFF}{MOVED} SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY o_orderkey) AS example_no,
         count(*) OVER (PARTITION BY category) AS total,
         greatest(count(*) OVER (PARTITION BY category) - 10, 0) AS not_shown FROM r) WHERE example_no <= 10""",
    "discrepancy_rows": f"""{ORDERS_DIFF}{MOVED}
SELECT 'dbo.orders' AS table_name, category, 'o_orderkey=' || o_orderkey AS row_key,
       changed_columns_in_order AS changed_columns,
       CASE WHEN category <> 'only_in_target' THEN '{{"o_orderkey":' || o_orderkey || '}}' END AS source_key,
       CASE WHEN category <> 'only_in_source' THEN '{{"o_orderkey":' || coalesce(target_o_orderkey, o_orderkey) || '}}' END AS target_key,
       CASE WHEN category <> 'only_in_target' THEN {_json('source_')} END AS source,
       CASE WHEN category <> 'only_in_source' THEN {_json('target_')} END AS target,
       1::BIGINT AS row_count
FROM (SELECT *, CASE WHEN category = 'changed' THEN concat_ws(',', {', '.join(f"CASE WHEN source_{n} IS DISTINCT FROM target_{n} THEN '{n}' END" for n in ORDER_VALUES)})
             ELSE '' END AS changed_columns_in_order FROM r)""",
    "range_boundaries": f"WITH {BOUNDARIES} SELECT CAST(boundary_no AS INTEGER) AS boundary_no, boundary FROM boundaries",
    "key_ranges": f"WITH {RANGES} SELECT * FROM labelled",
    "diff_by_range": f"""{ORDERS_DIFF}, {RANGES},
g AS (SELECT CAST(1 + (SELECT count(*) FROM boundaries b WHERE b.boundary < d.o_orderkey) AS INTEGER) AS bucket, category FROM d)
SELECT g.bucket, {COUNTS}, any_value(label) AS label FROM g JOIN labelled USING (bucket) GROUP BY g.bucket""",
    "composite_range_boundaries": _composite("lineitem", ["l_returnflag", "l_shipdate", "l_orderkey"])
    + " SELECT CAST(boundary_no AS INTEGER) AS boundary_no, l_returnflag, l_shipdate, l_orderkey FROM boundaries",
    "diff_by_composite_range": _composite("events", ["event_type", "user_id", "ts"])
    + ","
    + _aligned("SELECT * FROM events", _sql(targets.EVENTS), ["event_type", "user_id", "ts"], ["value", "props"])
    + f""", g AS (SELECT category, CAST(1 + (SELECT count(*) FROM boundaries b WHERE b.event_type < d.event_type
  OR b.event_type = d.event_type AND (b.user_id < d.user_id OR b.user_id = d.user_id AND b.ts < d.ts)) AS INTEGER) AS bucket FROM d)
SELECT bucket, {COUNTS} FROM g GROUP BY bucket""",
    "range_boundaries_by_type": " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, CAST(boundary_no AS INTEGER) AS boundary_no, CAST({name} AS VARCHAR) AS boundary "
        f"FROM ({_composite(table, [name])} SELECT * FROM boundaries)"
        for table, name in (("pages", "url"), ("documents", "source"), ("orders", "o_orderdate"))
    ),
    "keyed_diff_collated": f"""SELECT coalesce(s.c_name, t.c_name) AS c_name,
  CASE WHEN s.c_name IS NULL THEN 'only_in_target' WHEN t.c_name IS NULL THEN 'only_in_source'
       WHEN {' AND '.join(f's.{name} IS NOT DISTINCT FROM t.{name}' for name in NAMED)} THEN 'matched' ELSE 'changed' END AS category,
  CASE WHEN s.c_name IS NULL OR t.c_name IS NULL THEN '' ELSE {_changed(NAMED)} END AS changed_columns,
  {', '.join(f's.{name} AS source_{name}, t.{name} AS target_{name}' for name in NAMED)}
FROM customer s FULL OUTER JOIN ({_sql(targets.CUSTOMER_NAMES)}) t ON lower(s.c_name) = lower(t.c_name)""",
    "footer_statistics": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS rows, count({name}) AS filled, min({name}) AS lowest, max({name}) AS highest FROM {table}"
        for table, name in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))
    ),
    "digest_buckets": "WITH "
    + _aligned("SELECT * FROM orders", _sql(targets.ORDERS_LOCAL), ["o_orderkey"], ORDER_VALUES)
    + f""", e AS (SELECT min(o_orderkey) AS low, (max(o_orderkey) - min(o_orderkey) + 1 + {DIGEST_BUCKETS - 1}) // {DIGEST_BUCKETS} AS width FROM d)
SELECT CAST((o_orderkey - low) // width AS INTEGER) AS bucket,
       count(*) FILTER (WHERE category <> 'only_in_target') AS source_rows,
       count(*) FILTER (WHERE category <> 'only_in_source') AS target_rows,
       count(*) FILTER (WHERE category <> 'matched') = 0 AS equal
FROM d, e GROUP BY 1""",
    "digest_diff_counts": _keyed_totals("SELECT * FROM orders", _sql(targets.ORDERS_LOCAL), ["o_orderkey"], ORDER_VALUES),
    "digest_diff_rows": "WITH "
    + _aligned("SELECT * FROM events", _sql(targets.EVENTS), ["user_id", "ts"], EVENT_VALUES)
    + " SELECT * FROM d WHERE category <> 'matched'",
    "row_counts": _row_counts(SOURCE_ROWS, TARGET_ROWS),
    "common_tables": _row_counts(
        {name: rows for name, rows in SOURCE_ROWS.items() if name not in ("nation", "part")}, TARGET_ROWS
    ),
    "common_columns": _common_columns(),
    "schema_columns": SOURCE_SCHEMA,
    "schema_column_diff": _column_diff(),
    "ddl_lines": f"{SCHEMAS} SELECT 'dbo.' || table_name AS full_name, ordinal, line AS ddl_line FROM sc",
    "ddl_diff": _ddl_diff(),
    "object_presence": f"{OBJECTS} SELECT full_name, kind, CASE WHEN object_class IN ('Different', 'Identical') THEN 'Both' "
    "ELSE object_class END AS presence FROM oc",
    "object_classes": f"{OBJECTS} SELECT * FROM oc",
    "schema_summary": _kinds(),
    "schema_percentages": f"""{OBJECTS}, n AS (
  SELECT count(*) AS objects, count(*) FILTER (WHERE object_class LIKE 'Only%') AS one_sided,
         count(*) FILTER (WHERE object_class = 'Different') AS different FROM oc)
SELECT {_percent('one_sided', 'objects')} AS object_difference_percent,
       {_percent('different', 'objects - one_sided')} AS definition_difference_percent,
       one_sided = 0 AND different = 0 AS is_identical FROM n""",
    "text_line_diff": f"""WITH {DOCS},
na AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS k FROM la),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS k FROM lb)
SELECT coalesce(na.doc_id, nb.doc_id) AS doc_id, CAST(na.n AS INTEGER) AS source_line_no, CAST(nb.n AS INTEGER) AS target_line_no,
       coalesce(na.line, nb.line) AS line,
       CASE WHEN nb.doc_id IS NULL THEN 'only_source' WHEN na.doc_id IS NULL THEN 'only_target' ELSE 'same' END AS status
FROM na FULL OUTER JOIN nb ON na.doc_id = nb.doc_id AND na.line = nb.line AND na.k = nb.k""",
    "text_aligned_diff": _alignment(4),
    "text_positional_diff": f"""WITH {DOCS}
SELECT coalesce(la.doc_id, lb.doc_id) AS doc_id, CAST(coalesce(la.n, lb.n) AS INTEGER) AS line_no,
       la.line AS source_line, lb.line AS target_line, la.line IS DISTINCT FROM lb.line AS changed
FROM la FULL OUTER JOIN lb ON la.doc_id = lb.doc_id AND la.n = lb.n""",
    "content_type_audit": f"""{PAGES}
SELECT side, {BODY_TYPE.format('body')} AS content_type, count(*) AS row_count
FROM (SELECT 'source' AS side, body FROM s UNION ALL SELECT 'target', body FROM t) GROUP BY 1, 2""",
    "content_label_conflicts": f"""{PAGES}
SELECT coalesce(s.page_id, t.page_id) AS page_id, {BODY_TYPE.format('s.body')} AS source_type,
       {BODY_TYPE.format('t.body')} AS target_type
FROM s FULL OUTER JOIN t ON s.page_id = t.page_id
WHERE coalesce(s.is_pdf, t.is_pdf) AND (coalesce(left(s.body, 4) <> '%PDF', FALSE) OR coalesce(left(t.body, 4) <> '%PDF', FALSE))""",
}
