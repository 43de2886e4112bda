"""Inputs of the registered queries, all derived from the given tables.

The tables as given hold no NULL and no repeated row, so checks of missing cells and duplicates run on degraded
copies. Catalogues, keys and snapshot histories of many databases are derived from ``events``: every user and week
is one database, its tables and columns follow from that week's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelore.functions.names import source_key
from tablelore.operators.catalog import KEYS_SCHEMA
from tablelore.session import settle

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
SOURCE = "warehouse"

# Declared keys of the given tables, as (primary key, [(columns, referred table, referred columns)]).
STAR_KEYS = {
    "region": (["r_regionkey"], []),
    "nation": (["n_nationkey"], [(["n_regionkey"], "region", ["r_regionkey"])]),
    "customer": (["c_custkey"], [(["c_nationkey"], "nation", ["n_nationkey"])]),
    "supplier": (["s_suppkey"], [(["s_nationkey"], "nation", ["n_nationkey"])]),
    "part": (["p_partkey"], []),
    "orders": (["o_orderkey"], [(["o_custkey"], "customer", ["c_custkey"])]),
    "lineitem": (["l_orderkey", "l_linenumber"], [(["l_orderkey"], "orders", ["o_orderkey"]),
                                                  (["l_partkey"], "part", ["p_partkey"]),
                                                  (["l_suppkey"], "supplier", ["s_suppkey"])]),
    "events": (["event_id"], []),
    "documents": (["doc_id"], []),
    "embeddings": (["vec_id"], []),
    "pages": (["page_id"], []),
    "benchmark": (["item_id"], []),
    "labels": (["doc_id"], [(["doc_id"], "documents", ["doc_id"])]),
    "conversations": (["conv_id", "turn"], []),
}


def load(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in (names or TABLES)}


def star_keys(spark: SparkSession) -> DataFrame:
    rows = [(SOURCE, t, pk, [(f"fk_{t}_{i}", c, None, r, rc, None) for i, (c, r, rc) in enumerate(fks)])
            for t, (pk, fks) in STAR_KEYS.items()]
    return spark.createDataFrame(rows, KEYS_SCHEMA)


# Degraded copies, as SQL that reads alike in both engines.
DEGRADED = {
    "orders": "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus, "
              "CASE WHEN o_totalprice > 400000 THEN CAST('NaN' AS DOUBLE) WHEN o_totalprice < 20000 THEN NULL "
              "ELSE o_totalprice END AS o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority "
              "FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
              "o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' "
              "AND o_totalprice BETWEEN 20000 AND 400000",
    "customer": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
                "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer",
    "lineitem": "SELECT nullif(l_returnflag, 'A') AS l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus, "
                "l_linenumber, CASE WHEN l_discount > 0.05 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS l_discount "
                "FROM lineitem",
}


def degraded(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for n in names or DEGRADED:
        given = load(spark, sf, n)[n]
        out[n] = spark.sql(DEGRADED[n].replace(f"FROM {n}", "FROM {given}"), given=given)
    return out


def mixed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All tables, with orders and customer degraded."""
    return {**load(spark, sf), **degraded(spark, sf, "orders", "customer")}


# Every turn signed with something personal, as SQL that reads alike in both engines.
SIGNED = """SELECT concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS turn_key,
  concat(coalesce(text, ''), CASE turn % 4 WHEN 0 THEN concat(' Call +44 20 7946 0', CAST(100 + conv_id % 900 AS STRING), '.')
    WHEN 1 THEN ' Card 4111 1111 1111 1111 12/27' WHEN 2 THEN ' Pay BE68539007547034 EUR'
    ELSE concat(' Write to user', CAST(conv_id AS STRING), '@example.org') END) AS text FROM {conversations}"""


# ---- many databases out of events --------------------------------------------------------------------------------

# What a row refers to follows from the row itself, so no user's events have to be put in order.
EVENTS = """
ev AS (
  SELECT user_id, event_id, ts, value, event_type AS et, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(floor(minute(ts) * 5 / 3) AS INT) AS m, CAST(floor((day(ts) - 1) / 7) AS INT) AS week,
         concat('user_', CAST(user_id AS STRING), '/', CAST(year(ts) AS STRING), '-', CAST(month(ts) AS STRING), '-w',
                CAST(CAST(floor((day(ts) - 1) / 7) AS INT) AS STRING)) AS source
  FROM {events}),
refs AS (
  SELECT source, et, p, max(m) AS kk FROM (
    SELECT source, et, m, CASE WHEN k < 20 THEN 'click' WHEN k < 40 THEN 'view' WHEN k < 60 THEN 'purchase'
                               WHEN k < 80 THEN 'signup' ELSE 'error' END AS p FROM ev) x GROUP BY source, et, p),
ext AS (SELECT DISTINCT source, et, CAST(floor(k / 10) AS INT) AS b FROM ev),
tabs AS (
  SELECT source, et, count(*) AS n, min(k) AS mk,
         CASE WHEN min(k) < 10 THEN concat(et, 's') WHEN min(k) < 20 THEN et
              WHEN min(k) < 35 THEN concat('olist_', et, 's_dataset') WHEN min(k) < 55 THEN concat(et, '_log')
              WHEN min(k) < 70 THEN concat('raw', et) ELSE concat('misc_', et) END AS name
  FROM ev GROUP BY source, et)"""

REF_NAME = """CASE WHEN r.p = r.et THEN concat('parent_', r.et, '_id') WHEN r.kk < 40 THEN concat(upper(r.p), '_ID')
              WHEN r.kk < 55 THEN concat(r.p, '__id') ELSE concat(r.p, '_id') END"""

EXTRA_NAME = """CASE b WHEN 0 THEN 'email_address' WHEN 1 THEN 'fax_no' WHEN 2 THEN 'home_street' WHEN 3 THEN 'order_state'
              WHEN 4 THEN 'birth_day' WHEN 5 THEN 'discard' WHEN 6 THEN 'is_late' WHEN 7 THEN 'username'
              WHEN 8 THEN 'first_name' ELSE 'estate' END"""

# Read from the frames ext, refs and tabs of above.
ESTATE_TOP = f"""ends AS (SELECT source, min(et) AS a, max(et) AS b FROM tabs GROUP BY source HAVING count(*) >= 3),
cols AS (
  SELECT source, name AS table_name, 1 AS ordinal, concat(et, '_id') AS column_name FROM tabs
  UNION ALL
  SELECT r.source, t.name, 1 + CAST(row_number() OVER (PARTITION BY r.source, r.et ORDER BY r.p) AS INT), {REF_NAME}
  FROM refs r JOIN tabs t ON r.source = t.source AND r.et = t.et
  UNION ALL
  SELECT x.source, t.name, 50 + x.b, {EXTRA_NAME}
  FROM ext x JOIN tabs t ON x.source = t.source AND x.et = t.et
  UNION ALL SELECT source, concat('link_', a, '_', b), 1, concat(a, '_id') FROM ends
  UNION ALL SELECT source, concat('link_', a, '_', b), 2, concat(b, '_id') FROM ends
  UNION ALL SELECT source, concat(et, '_detail'), 1, concat(et, '_id') FROM tabs WHERE n >= 5),
pks AS (
  SELECT source, name AS table_name, 1 AS position, concat(et, '_id') AS column_name FROM tabs WHERE mk < 30
  UNION ALL SELECT source, concat('link_', a, '_', b), 1, concat(a, '_id') FROM ends
  UNION ALL SELECT source, concat('link_', a, '_', b), 2, concat(b, '_id') FROM ends
  UNION ALL SELECT source, concat(et, '_detail'), 1, concat(et, '_id') FROM tabs WHERE n >= 5),
fks AS (
  SELECT r.source, t.name AS table_name, CAST(row_number() OVER (PARTITION BY r.source, r.et ORDER BY r.p) AS INT) - 1 AS fk_position,
         {REF_NAME} AS from_column, o.name AS to_table, concat(r.p, '_id') AS to_column, r.kk >= 95 AS uneven
  FROM refs r JOIN tabs t ON r.source = t.source AND r.et = t.et JOIN tabs o ON r.source = o.source AND r.p = o.et
  WHERE r.kk >= 85
  UNION ALL
  SELECT e.source, concat('link_', a, '_', b), 0, concat(a, '_id'), t.name, concat(a, '_id'), false
  FROM ends e JOIN tabs t ON e.source = t.source AND e.a = t.et
  UNION ALL
  SELECT e.source, concat('link_', a, '_', b), 1, concat(b, '_id'), t.name, concat(b, '_id'), false
  FROM ends e JOIN tabs t ON e.source = t.source AND e.b = t.et
  UNION ALL
  SELECT source, concat(et, '_detail'), 0, concat(et, '_id'), name, concat(et, '_id'), false FROM tabs WHERE n >= 5),
names AS (SELECT DISTINCT source, table_name FROM cols)"""

ESTATE = f"{EVENTS},\n{ESTATE_TOP}"

HISTORY = EVENTS + f""",
headers AS (
  SELECT source AS snapshot_id, max(ts) AS captured_at, user_id,
         CASE max(week) WHEN 0 THEN concat('data/User ', CAST(user_id AS STRING))
                        WHEN 1 THEN concat(' DATA/user%20', CAST(user_id AS STRING), ' ')
                        WHEN 2 THEN concat('data//user ', CAST(user_id AS STRING), '/')
                        ELSE concat('data/./user ', CAST(user_id AS STRING)) END AS source_path
  FROM ev GROUP BY source, user_id),
scols AS (
  SELECT source AS snapshot_id, concat(et, 's') AS table_name, concat(et, '_id') AS column_name FROM tabs
  UNION ALL SELECT source, concat(et, 's'), concat('after_', p) FROM refs WHERE kk >= 50
  UNION ALL SELECT source, concat(et, 's'), {EXTRA_NAME} FROM ext WHERE b < 3),
stabs AS (
  SELECT e.snapshot_id, e.table_name, c.n AS column_count, e.row_count, e.score AS completeness_score
  FROM (SELECT source AS snapshot_id, concat(et, 's') AS table_name, count(*) AS row_count,
               CAST(sum(CASE WHEN value >= 5 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS score
        FROM ev GROUP BY source, et) e
  JOIN (SELECT snapshot_id, table_name, count(*) AS n FROM scols GROUP BY snapshot_id, table_name) c
    ON e.snapshot_id = c.snapshot_id AND e.table_name = c.table_name)"""


def _events(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {EVENTS} SELECT * FROM {name}", events=load(spark, sf, "events")["events"])


class Estate:
    """Catalogue of all derived databases. The frames that many parts read are settled once."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark = spark
        self.base = {n: settle(_events(spark, sf, n)) for n in ("ext", "refs", "tabs")}

    def _query(self, query: str) -> DataFrame:
        text = ESTATE_TOP
        for n in self.base:
            text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
            query = query.replace(f"FROM {n}", f"FROM {{{n}}}")
        return self.spark.sql(f"WITH {text} {query}", **self.base)

    def fields(self) -> DataFrame:
        """Columns of every database, before keys are applied."""
        return settle(self._query("SELECT source, table_name, ordinal, column_name, 'bigint' AS data_type, "
                                  "true AS is_nullable, CAST(NULL AS STRING) AS default_value FROM cols"))

    def keys(self) -> DataFrame:
        """Declared keys of every database; some foreign keys come with column lists of different length."""
        on = ["source", "table_name"]
        pk = self._query("SELECT * FROM pks").groupBy(*on).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda s: s["column_name"]).alias("primary_keys"))
        fk = (self._query("SELECT * FROM fks").groupBy(*on)
              .agg(F.array_sort(F.collect_list(F.struct("fk_position", "from_column", "to_table", "to_column", "uneven"))).alias("f"))
              .select(*on, F.transform("f", lambda s: F.struct(
                  F.concat(F.lit("fk_"), s["from_column"]).alias("name"),
                  F.array(s["from_column"]).alias("constrained_columns"),
                  F.lit(None).cast("string").alias("referred_schema"), s["to_table"].alias("referred_table"),
                  F.when(s["uneven"], F.array(s["to_column"], F.lit("extra"))).otherwise(F.array(s["to_column"])).alias("referred_columns"),
                  F.lit(None).cast("map<string,string>").alias("options"))).alias("fks")))
        return settle(self._query("SELECT * FROM names").join(pk, on, "left").join(fk, on, "left")
                      .select(*on, F.coalesce("primary_keys", F.array().cast("array<string>")).alias("primary_keys"), "fks"))

    def sizes(self) -> DataFrame:
        return self._query("SELECT source, name AS table_name, n AS row_count FROM tabs")


def history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, tables and columns of one snapshot per user and week."""
    def part(query: str) -> DataFrame:
        return spark.sql(f"WITH {HISTORY} {query}", events=load(spark, sf, "events")["events"])

    headers = part("SELECT snapshot_id, source_path, captured_at FROM headers")
    return (settle(headers.withColumn("source_key", source_key(F.col("source_path")))),
            settle(part("SELECT * FROM stabs")), settle(part("SELECT * FROM scols")))
