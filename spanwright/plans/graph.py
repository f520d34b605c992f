"""The star-schema symbol graph: the driver's tables read as a code corpus, in SQL that Spark and
DuckDB both run.  A customer is a file, nation and bucket a package, an order a type, a line item a
field, a local, a method and references to them."""

from __future__ import annotations

import contextvars
import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import materialize

BASE = ("customer", "orders", "lineitem", "events")

VIEWS = {
    "li": """
SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n,
       concat('c', o_custkey) AS source, l_orderkey * 100000 AS obase
FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey""",
    "g_files": """
SELECT concat('c', c_custkey) AS source,
       CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE concat('p.n', c_nationkey, '.s', c_custkey % 20) END AS package
FROM customer""",
    "g_scopes": """
SELECT source, CAST(0 AS BIGINT) AS scope_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS owner_id,
       CAST(0 AS BIGINT) AS start_at, CAST(100000000000 AS BIGINT) AS end_at FROM g_files
UNION ALL SELECT concat('c', o_custkey), o_orderkey * 100 + 1, CAST(0 AS BIGINT), o_orderkey * 1000, o_orderkey * 100000, o_orderkey * 100000 + 99999 FROM orders
UNION ALL SELECT source, l_orderkey * 100 + 1 + n, l_orderkey * 100 + 1, l_orderkey * 1000 + 300 + n, obase + n * 1000, obase + n * 1000 + 999 FROM li""",
    "g_decls": """
SELECT concat('c', o_custkey) AS source, o_orderkey * 1000 AS decl_id, 'TYPE' AS kind, concat('T', o_orderkey % 40) AS name,
       CAST(0 AS BIGINT) AS scope_id, o_orderkey * 100 + 1 AS body_scope_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Base' END AS type_name,
       o_orderkey * 100000 AS start_at, o_orderkey * 100000 + 99999 AS end_at, o_orderkey * 100000 + 6 AS name_start FROM orders
UNION ALL SELECT source, l_orderkey * 1000 + 100 + n, 'FIELD', concat('v', l_partkey % 7), l_orderkey * 100 + 1, CAST(NULL AS BIGINT), concat('T', l_suppkey % 60),
       obase + 100 + n * 10, obase + 105 + n * 10, obase + 100 + n * 10 FROM li
UNION ALL SELECT source, l_orderkey * 1000 + 200 + n, 'LOCAL', concat('v', l_suppkey % 7), l_orderkey * 100 + 1 + n, CAST(NULL AS BIGINT), concat('T', l_partkey % 40),
       obase + n * 1000 + 10 * CAST(l_quantity AS BIGINT), obase + n * 1000 + 10 * CAST(l_quantity AS BIGINT) + 5, obase + n * 1000 + 10 * CAST(l_quantity AS BIGINT) FROM li
UNION ALL SELECT source, l_orderkey * 1000 + 300 + n, 'METHOD', concat('m', n % 4), l_orderkey * 100 + 1, l_orderkey * 100 + 1 + n,
       CASE WHEN l_linenumber > 3 THEN concat('T', l_partkey % 40) END,
       obase + n * 1000, obase + n * 1000 + 999, obase + n * 1000 + 1 FROM li""",
    "g_imports": """
SELECT source, l_orderkey * 100 + n AS ord, concat('p.n', l_suppkey % 25, '.s', l_orderkey % 20, '.T', l_partkey % 40) AS name,
       CASE WHEN l_partkey % 500 = 0 THEN 'STATIC' WHEN l_partkey % 7 = 0 THEN 'TYPE_ON_DEMAND' ELSE 'TYPE' END AS kind FROM li""",
    "g_nodes": """
SELECT source, l_orderkey * 1000 + n * 10 AS node_id, 'NAME_REF' AS kind, concat('v', (l_orderkey + n) % 9) AS name,
       CAST(NULL AS BIGINT) AS receiver_id, l_orderkey * 100 + 1 + n AS scope_id,
       obase + n * 1000 + 250 AS start_at, obase + n * 1000 + 252 AS end_at, obase + n * 1000 + 250 AS name_start FROM li
UNION ALL SELECT source, l_orderkey * 1000 + n * 10 + 1, 'FIELD_ACCESS', concat('v', l_partkey % 7), l_orderkey * 1000 + n * 10, l_orderkey * 100 + 1 + n,
       obase + n * 1000 + 250, obase + n * 1000 + 255, obase + n * 1000 + 253 FROM li WHERE l_linenumber <> 1
UNION ALL SELECT source, l_orderkey * 1000 + n * 10 + 2, 'METHOD_CALL', concat('m', l_suppkey % 4), l_orderkey * 1000 + n * 10 + 1, l_orderkey * 100 + 1 + n,
       obase + n * 1000 + 250, obase + n * 1000 + 258, obase + n * 1000 + 256 FROM li WHERE l_linenumber > 2""",
    "g_made": """
SELECT source, l_orderkey * 1000 + n * 10 + 4 AS node_id, 'THIS' AS kind, CAST(NULL AS STRING) AS name, CAST(NULL AS BIGINT) AS receiver_id,
       l_orderkey * 100 + 1 + n AS scope_id, CAST(NULL AS STRING) AS type_name FROM li WHERE l_linenumber % 2 = 0
UNION ALL SELECT source, l_orderkey * 1000 + n * 10 + 5, 'FIELD_ACCESS', concat('v', l_suppkey % 7), l_orderkey * 1000 + n * 10 + 4, l_orderkey * 100 + 1 + n, CAST(NULL AS STRING) FROM li WHERE l_linenumber % 2 = 0
UNION ALL SELECT source, l_orderkey * 1000 + n * 10 + 6, 'OBJECT_CREATION', CAST(NULL AS STRING), CAST(NULL AS BIGINT), l_orderkey * 100 + 1 + n, concat('T', l_partkey % 60) FROM li WHERE l_linenumber % 3 = 0
UNION ALL SELECT source, l_orderkey * 1000 + n * 10 + 7, 'METHOD_CALL', concat('m', l_partkey % 4), l_orderkey * 1000 + n * 10 + 6, l_orderkey * 100 + 1 + n, CAST(NULL AS STRING) FROM li WHERE l_linenumber % 3 = 0
UNION ALL SELECT source, l_orderkey * 1000 + n * 10 + 8, 'METHOD_CALL', concat('m', l_suppkey % 5), CAST(NULL AS BIGINT), l_orderkey * 100 + 1 + n, CAST(NULL AS STRING) FROM li WHERE l_linenumber % 4 = 1""",
    "g_inner": """
SELECT source, l_orderkey * 1000 + 400 + n AS decl_id, concat('I', n % 3) AS name, l_orderkey * 100 + 1 AS scope_id, l_orderkey * 1000 AS outer_id,
       l_partkey % 2 = 0 AS is_static, CASE l_suppkey % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PROTECTED' WHEN 2 THEN 'PACKAGE' ELSE 'PRIVATE' END AS access,
       obase + n * 1000 + 500 AS start_at FROM li""",
    "g_qrefs": """
SELECT source, l_orderkey * 1000 + 500 + n AS ref_id, l_orderkey * 100 + 1 + n AS scope_id,
       CASE WHEN n % 2 = 0 THEN concat('T', l_suppkey % 60, '.I', l_partkey % 3)
            ELSE concat('p.n', l_suppkey % 25, '.s', l_orderkey % 20, '.T', l_partkey % 40, '.I', l_partkey % 3) END AS name FROM li""",
    "g_statics": """
SELECT source, l_orderkey * 100 + n AS ord, concat('p.n', l_suppkey % 25, '.s', l_orderkey % 20, '.T', l_partkey % 40,
       CASE WHEN n % 2 = 0 THEN concat('.I', l_suppkey % 4) ELSE '' END) AS name,
       CASE WHEN n % 2 = 0 THEN 'STATIC' ELSE 'STATIC_ON_DEMAND' END AS kind FROM li""",
    "g_irefs": """
SELECT source, l_orderkey * 1000 + 600 + n AS ref_id, l_orderkey * 100 + 1 + n AS scope_id, concat('I', l_partkey % 3) AS name,
       obase + n * 1000 + 250 AS at, l_linenumber % 2 = 0 AS in_static FROM li""",
    "g_locals": """
SELECT source, l_orderkey * 1000 + 700 + n AS decl_id, CASE WHEN l_linenumber % 3 = 0 THEN 'TYPE_PARAM' ELSE 'TYPE' END AS kind, concat('I', l_suppkey % 3) AS name,
       l_orderkey * 100 + 1 + n AS scope_id, l_linenumber % 3 <> 0 AS is_local, obase + n * 1000 + 10 * CAST(l_quantity AS BIGINT) AS start_at FROM li""",
    "g_supers": """
SELECT concat('c', a.o_custkey) AS source, a.o_orderkey * 1000 AS decl_id, concat('c', b.o_custkey) AS super_source, b.o_orderkey * 1000 AS super_id
FROM orders a JOIN orders b ON b.o_orderkey = CAST(floor(a.o_orderkey / 50) AS BIGINT) WHERE a.o_orderkey <> b.o_orderkey
UNION ALL SELECT source, decl_id, source, before * 1000 FROM (
  SELECT concat('c', o_custkey) AS source, o_orderkey * 1000 AS decl_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) x WHERE k % 3 <> 1""",
    "g_bounds": """
SELECT source, l_orderkey * 1000 + 700 + n AS decl_id, source AS bound_source,
       CASE WHEN l_partkey % 2 = 0 THEN l_orderkey * 1000 + 700 + n + CASE WHEN l_suppkey % 2 = 0 THEN 3 ELSE -3 END ELSE l_orderkey * 1000 END AS bound_id
FROM li WHERE l_linenumber % 3 = 0""",
    "g_aliases": """
SELECT source, l_orderkey * 100 + 60 + n AS ord, concat('p.n', l_suppkey % 25, '.s', l_orderkey % 20, '.T', l_partkey % 40, '.I', n % 3) AS name, 'TYPE' AS kind FROM li""",
    "g_versions": """
SELECT concat('u', user_id) AS key, CAST(date_part('day', ts) * 24 + date_part('hour', ts) AS BIGINT) AS revision, event_id AS seq,
       event_type = 'error' AS deleted, CASE WHEN event_type <> 'error' THEN value END AS value FROM events""",
}


def _needed(name: str) -> list[str]:
    out: list[str] = []
    for word in re.findall(r"\b(?:li|g_\w+)\b", VIEWS[name]):
        if word != name and word in VIEWS:
            out += [w for w in _needed(word) if w not in out]
    return [*out, name]


def prefix(*names: str) -> str:
    """``WITH`` clause text (without the keyword) of the named views and what they need."""
    order: list[str] = []
    for name in names:
        order += [w for w in _needed(name) if w not in order]
    return ", ".join(f"{w} AS ({VIEWS[w]})" for w in order)


#: Columns of ``li`` that views read; the others only order it and are not written.
LI = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "n", "source", "obase")


_once: contextvars.ContextVar[dict | None] = contextvars.ContextVar("once", default=None)


def once_for_each_query(f):
    """The query, in which ``li``, which most views need and which takes a window, is written once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _once.get() is not None:  # a query within a query
            return f(spark, sf_dir)
        token = _once.set({})
        try:
            return f(spark, sf_dir)
        finally:
            _once.reset(token)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def kept(sf_dir: str, name: str, make) -> DataFrame:
    """``make()``, called once within a query however often the query asks for ``name``."""
    held = _once.get()
    if held is None:
        return make()
    if (sf_dir, name) not in held:
        held[sf_dir, name] = make()
    return held[sf_dir, name]


def _sql(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    for b in BASE:
        if re.search(rf"\b(FROM|JOIN) {b}\b", text):
            text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
            more[b] = spark.read.parquet(f"{sf_dir}/{b}.parquet")
    return spark.sql(text, **more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view of the graph over the tables of a folder."""
    held = _once.get()
    if held is None or "li" not in _needed(name):
        return _sql(spark, sf_dir, f"WITH {prefix(name)} SELECT * FROM {name}")
    if sf_dir not in held:
        held[sf_dir] = materialize(_sql(spark, sf_dir, VIEWS["li"]).select(*LI), "li")
    order = [w for w in _needed(name) if w != "li"]
    text = "WITH " + ", ".join(f"{w} AS ({VIEWS[w]})" for w in order) + f" SELECT * FROM {name}"
    return _sql(spark, sf_dir, re.sub(r"\b(FROM|JOIN) li\b", r"\1 {li}", text), li=held[sf_dir])
