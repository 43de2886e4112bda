"""The registered queries as plain SQL for DuckDB, over the same tables.

Written from the rules, not from the Spark plans: edges, for one, are scored pair by pair here.
"""

from __future__ import annotations

from tablelore.functions import cells, pii
from tablelore.plans import summaries
from tablelore.workload import inputs
from tablelore.workload.inputs import DEGRADED, ESTATE, EXTRA_NAME, HISTORY, SIGNED, SOURCE, STAR_KEYS  # noqa: F401

# Columns of the given tables with a short type name.
SCHEMA = {
    "region": "r_regionkey int, r_name text",
    "nation": "n_nationkey int, n_name text, n_regionkey int",
    "customer": "c_custkey int, c_name text, c_nationkey int, c_acctbal double, c_mktsegment text",
    "supplier": "s_suppkey int, s_name text, s_nationkey int, s_acctbal double",
    "part": "p_partkey int, p_name text, p_brand text, p_type text, p_size int, p_retailprice double",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus text, o_totalprice double, o_orderdate time, o_orderpriority text",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag text, l_linestatus text, l_shipdate time",
    "events": "event_id int, ts time, user_id int, event_type text, value double, props text",
    "documents": "doc_id int, text text, lang text, source text, n_chars int",
    "embeddings": "vec_id int, embedding array, label int",
    "pages": "page_id int, url text, html text",
    "benchmark": "item_id int, text text",
    "labels": "doc_id int, quality int, toxic int",
    "conversations": "conv_id int, turn int, role text, text text",
}


def columns_of(table: str) -> list[tuple[int, str, str]]:
    return [(i, *c.split()) for i, c in enumerate(SCHEMA[table].split(", "), 1)]


LINEITEM_DEGRADED = [(1, "l_returnflag", "text"), (2, "l_linestatus", "text"), (3, "l_linenumber", "int"), (4, "l_discount", "double")]


class Table:
    """A table as the oracles see it: its label, what to select from, its columns."""

    def __init__(self, label: str, frm: str, columns: list[tuple[int, str, str]]):
        self.label, self.frm, self.columns = label, frm, columns

    def present(self, name: str, kind: str) -> str:
        return f"CASE WHEN NOT isnan({name}) THEN {name} END" if kind == "double" else name


GIVEN = [Table(t, t, columns_of(t)) for t in inputs.TABLES]
SPOILT = {t: Table(t, f"({q})", LINEITEM_DEGRADED if t == "lineitem" else columns_of(t)) for t, q in DEGRADED.items()}
BOTH = GIVEN + [Table(f"{t}_degraded", s.frm, s.columns) for t, s in SPOILT.items()]
MIXED = [SPOILT[t.label] if t.label in ("orders", "customer") else t for t in GIVEN]


def per_column(tables: list[Table], body, keep=lambda kind: True) -> str:
    """UNION ALL of one select per column; body(table, ordinal, name, kind) gives its select list."""
    return " UNION ALL ".join(
        f"SELECT '{t.label}' AS table_name, {body(t, i, n, k)} FROM {t.frm}"
        for t in tables for i, n, k in t.columns if keep(k))


def nulls(tables: list[Table]) -> str:
    return per_column(tables, lambda t, i, n, k: (
        f"{i} AS ordinal, '{n}' AS column_name, count(*) AS total_rows, count(*) - count({t.present(n, k)}) AS null_count"))


def sizes(tables: list[Table]) -> str:
    """Per table: rows, columns, completeness, sparse flag."""
    return (f"SELECT table_name, max(total_rows) AS total_rows, count(*) AS total_columns, "
            f"avg(1 - CAST(null_count AS DOUBLE) / total_rows) AS completeness_score, "
            f"bool_or(CAST(null_count AS DOUBLE) / total_rows > 0.3) AS sparse FROM ({nulls(tables)}) GROUP BY table_name")


def duplicates(tables: list[Table]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t.label}' AS table_name, (SELECT count(*) FROM {t.frm}) - (SELECT count(*) FROM "
        f"(SELECT DISTINCT {', '.join(f'{t.present(n, k)} AS {n}' for _, n, k in t.columns)} FROM {t.frm})) AS duplicate_row_count"
        for t in tables)


def profiles(tables: list[Table]) -> str:
    return (f"SELECT s.*, d.duplicate_row_count, s.sparse OR d.duplicate_row_count > 0 AS flag "
            f"FROM ({sizes(tables)}) s JOIN ({duplicates(tables)}) d ON s.table_name = d.table_name")


def quality(score: str) -> str:
    return f"CASE WHEN {score} > 0.95 THEN 'good' WHEN {score} > 0.8 THEN 'warn' ELSE 'bad' END"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLES: dict[str, str] = {}

# ---- catalogue ---------------------------------------------------------------------------------------------------

ORACLES["table_row_counts"] = " UNION ALL ".join(
    f"SELECT '{t.label}' AS table_name, count(*) AS row_count, CAST({len(t.columns)} AS BIGINT) AS column_count, "
    f"'{','.join(STAR_KEYS[t.label][0])}' AS primary_keys, CAST({len(GIVEN)} AS BIGINT) AS total_tables, "
    f"CAST({sum(len(x.columns) for x in GIVEN)} AS BIGINT) AS total_columns FROM {t.frm}" for t in GIVEN)


def _fk_ref(table: str, column: str) -> str | None:
    return next((f"{r}.{rc}" for cs, r, rcs in STAR_KEYS[table][1] for c, rc in zip(cs, rcs) if c == column), None)


def _catalog_row(t: Table, i: int, n: str, k: str) -> str:
    ref = _fk_ref(t.label, n)
    return (f"{i} AS ordinal, '{n}' AS column_name, {k in ('int', 'double')} AS is_numeric, "
            f"{n in STAR_KEYS[t.label][0]} AS is_primary_key, {ref is not None} AS is_foreign_key, "
            f"CAST({repr(ref) if ref else 'NULL'} AS VARCHAR) AS foreign_key_references, count(*) AS row_count")


ORACLES["catalog_of_tables"] = per_column(GIVEN, _catalog_row)

WITH_ESTATE = "WITH " + ESTATE.replace("{events}", "events")
FLAGGED = """,
target AS (SELECT source, table_name, from_column, arg_max(to_table || '.' || to_column, fk_position) AS ref
           FROM fks GROUP BY source, table_name, from_column),
flagged AS (
  SELECT c.source, c.table_name, c.ordinal, c.column_name, p.column_name IS NOT NULL AS is_primary_key,
         t.ref IS NOT NULL AS is_foreign_key, t.ref AS foreign_key_references
  FROM cols c LEFT JOIN pks p ON c.source = p.source AND c.table_name = p.table_name AND c.column_name = p.column_name
  LEFT JOIN target t ON c.source = t.source AND c.table_name = t.table_name AND c.column_name = t.from_column)"""

ORACLES["estate_catalog"] = f"{WITH_ESTATE}{FLAGGED} SELECT * FROM flagged"

# ---- profiles ----------------------------------------------------------------------------------------------------

ORACLES["column_nulls"] = (
    f"SELECT table_name, ordinal, column_name, total_rows, null_count, "
    f"round(CAST(null_count AS DOUBLE) / total_rows, 9) AS null_rate FROM ({nulls(BOTH)})")

ORACLES["column_uniqueness"] = (
    "SELECT table_name, ordinal, column_name, unique_count, round(CAST(unique_count AS DOUBLE) / n, 9) AS uniqueness_rate, "
    "unique_count = 1 AS is_constant, unique_count = n AS is_unique_key FROM ("
    + per_column(BOTH, lambda t, i, n, k: f"{i} AS ordinal, '{n}' AS column_name, count(*) AS n, "
                                          f"count(DISTINCT {t.present(n, k)}) AS unique_count") + ")")

ORACLES["numeric_stats"] = per_column(
    BOTH, lambda t, i, n, k: (f"'{n}' AS column_name, CAST(min({t.present(n, k)}) AS DOUBLE) AS min_num, "
                              f"CAST(max({t.present(n, k)}) AS DOUBLE) AS max_num, round(avg({t.present(n, k)}), 5) AS mean_value"),
    lambda k: k in ("int", "double"))

ORACLES["text_min_max"] = per_column(
    BOTH, lambda t, i, n, k: f"'{n}' AS column_name, CAST(min({n}) AS VARCHAR) AS min_value, CAST(max({n}) AS VARCHAR) AS max_value",
    lambda k: k in ("text", "time"))

def java_text(x: str) -> str:
    """A float as Java writes it: with an exponent below a thousandth and from ten millions on."""
    s = f"regexp_replace(CAST({x} AS VARCHAR), '^-', '')"
    digits = f"rtrim(ltrim(regexp_replace(regexp_replace({s}, 'e.*$', ''), '[.]', ''), '0'), '0')"
    power = f"CAST(floor(log10(abs({x}))) AS INT)"
    exponent = f"({power} + CASE WHEN abs({x}) >= power(10.0, {power} + 1) THEN 1 WHEN abs({x}) < power(10.0, {power}) THEN -1 ELSE 0 END)"
    return (f"CASE WHEN {x} = 0 OR (abs({x}) >= 1e-3 AND abs({x}) < 1e7) THEN CAST({x} AS VARCHAR) ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || "
            f"left({digits}, 1) || '.' || CASE WHEN length({digits}) > 1 THEN substr({digits}, 2) ELSE '0' END || 'E' || {exponent} END")


def cell_text(name: str, kind: str) -> str:
    if kind == "double":
        return java_text(name)
    if kind == "array":
        return f"'[' || array_to_string([{java_text('x')} FOR x IN {name}], ',') || ']'"
    return f"CAST({name} AS VARCHAR)"


ORACLES["sample_values"] = " UNION ALL ".join(
    f"SELECT '{t.label}' AS table_name, '{n}' AS column_name, string_agg(v, '|' ORDER BY h) AS samples FROM ("
    f"SELECT v, md5(v) AS h FROM (SELECT DISTINCT {cell_text(n, k)} AS v FROM {t.frm} WHERE {n} IS NOT NULL) ORDER BY h LIMIT 5)"
    for t in GIVEN for i, n, k in t.columns)

ORACLES["approximate_distinct"] = per_column(BOTH, lambda t, i, n, k: (
    f"'{n}' AS column_name, count(*) AS total_rows, count(*) - count({t.present(n, k)}) AS null_count, "
    + (f"CAST(min({t.present(n, k)}) AS DOUBLE) AS min_num, CAST(max({t.present(n, k)}) AS DOUBLE) AS max_num, round(avg({t.present(n, k)}), 5) AS mean_value, "
       if k in ("int", "double") else "NULL AS min_num, NULL AS max_num, NULL AS mean_value, ") + "true AS within_bound"))

ORACLES["duplicate_rows"] = (
    f"SELECT table_name, total_rows, total_columns, round(completeness_score, 9) AS completeness_score, "
    f"duplicate_row_count, flag AS has_data_quality_issues FROM ({profiles(BOTH)})")

ORACLES["overall_completeness"] = (
    f"SELECT count(*) AS total_tables, round(avg(completeness_score), 9) AS overall_completeness FROM ({sizes(MIXED)})")

ORACLES["sampled_profile"] = (
    "WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY md5(CAST(to_json(struct_pack("
    "o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus, o_orderpriority := o_orderpriority)) "
    "AS VARCHAR)) LIMIT 1000) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(*) AS total_rows, count(*) - count({n}) AS null_count, "
        f"count(DISTINCT {n}) AS unique_count, CAST(min({n}) AS VARCHAR) AS min_value, CAST(max({n}) AS VARCHAR) AS max_value FROM s"
        for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))

ORACLES["display_values"] = (
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '<bytes:' || strlen(p_name) || '>' AS p_name, "
    "CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE '' END AS p_size, "
    "CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END AS p_type FROM part")

ORACLES["top_null_columns"] = (
    f"WITH n AS ({nulls(BOTH)}), p AS ({profiles(BOTH)}), "
    "r AS (SELECT *, CAST(null_count AS DOUBLE) / total_rows AS rate, row_number() OVER (PARTITION BY table_name "
    "ORDER BY CAST(null_count AS DOUBLE) / total_rows DESC, ordinal) AS rank FROM n) "
    "SELECT r.table_name, p.duplicate_row_count, CAST(r.rank AS INT) AS rank, r.column_name, round(r.rate, 9) AS null_rate "
    "FROM r JOIN p ON r.table_name = p.table_name WHERE p.flag AND r.rank <= 3")

ORACLES["quality_labels"] = (
    f"WITH n AS (SELECT *, CAST(null_count AS DOUBLE) / total_rows AS rate FROM ({nulls(MIXED)})), s AS ({sizes(MIXED)}) "
    f"SELECT n.table_name, n.column_name, round(rate * 100, 2) AS null_rate_pct, {quality('1 - rate')} AS quality_class, "
    f"round(completeness_score * 100, 2) AS completeness_pct, {quality('completeness_score')} AS completeness_class "
    "FROM n JOIN s ON n.table_name = s.table_name")

# ---- cleaning ----------------------------------------------------------------------------------------------------

ORACLES["clean_strings"] = "SELECT DISTINCT p_name, nullif(p_type, 'PROMO') AS p_type, p_brand FROM part"

ORACLES["parse_dates"] = (
    "SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS order_date, "
    "CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS delivery_date, "
    "CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) - CASE WHEN o_orderstatus = 'P' THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS paid_time FROM orders")
ORACLES["date_layouts"] = """
WITH o AS (SELECT *, o_orderpriority = '5-LOW' AS late, day(o_orderdate) <= 12 AS either FROM orders),
c AS (SELECT 'order_date' AS column_name, count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS filled,
        count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')) AS m,
        count(*) FILTER (either AND o_orderstatus = 'O' AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')) AS d, count(*) FILTER (late) AS lost FROM o
      UNION ALL SELECT 'delivery_date', count(*), count(*) FILTER (late OR either), count(*) FILTER (NOT late), count(*) FILTER (late) FROM o
      UNION ALL SELECT 'paid_time', count(*), 0, 0, 0 FROM o)
SELECT column_name, filled, m AS month_first_fits, d AS day_first_fits, d > m AS day_first, filled - lost AS parsed, lost FROM c"""


def _csv_column(t: Table, i: int, n: str, k: str) -> str:
    """What a column reads as once it was text: white space around it is gone, blanks are NULL, and so are the texts that stand for missing cells."""
    if k == "text":
        tokens = ", ".join(_sql(x) for x in cells.NULL_TOKENS)
        value = f"CASE WHEN {n} NOT IN ({tokens}) THEN nullif(regexp_replace({n}, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g'), '') END"
        return (f"{i} AS ordinal, '{n}' AS column_name, 'string' AS data_type, count(*) AS total_rows, count(*) - count({value}) AS null_count, "
                f"count(DISTINCT {value}) AS unique_count, NULL AS min_num, NULL AS max_num, NULL AS mean_value")
    if k == "time":
        value = f"date_trunc('millisecond', {n})"
        return (f"{i} AS ordinal, '{n}' AS column_name, 'timestamp_ntz' AS data_type, count(*) AS total_rows, 0 AS null_count, count(DISTINCT {value}) AS unique_count, "
                "NULL AS min_num, NULL AS max_num, NULL AS mean_value")
    kind = "'whole'" if k == "int" else f"CASE WHEN bool_and({n} % 1 = 0) THEN 'whole' ELSE 'double' END"
    return (f"{i} AS ordinal, '{n}' AS column_name, {kind} AS data_type, count(*) AS total_rows, 0 AS null_count, count(DISTINCT {n}) AS unique_count, "
            f"CAST(min({n}) AS DOUBLE) AS min_num, CAST(max({n}) AS DOUBLE) AS max_num, round(avg({n}), 4) AS mean_value")


ORACLES["csv_tables"] = per_column([t for t in GIVEN if t.label in ("orders", "part", "customer", "nation", "documents")], _csv_column)


def _type_of(table: str, i: int, name: str, value: str) -> str:
    """Type of a text expression: numeric when every value parses, whole when none has a fraction."""
    return (f"SELECT '{table}' AS table_name, {i} AS ordinal, '{name}' AS column_name, CASE "
            f"WHEN count(v) = 0 THEN 'string' "
            f"WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) AND bool_and(TRY_CAST(v AS DOUBLE) % 1 = 0) THEN 'bigint' "
            f"WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN 'double' "
            f"WHEN bool_and(v IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) THEN 'boolean' ELSE 'string' END AS inferred_type, "
            f"count(v) AS filled FROM (SELECT {value} AS v FROM {table})")


ORACLES["infer_types"] = " UNION ALL ".join([
    _type_of("orders", 1, "o_orderkey", "CAST(o_orderkey AS VARCHAR)"),
    _type_of("orders", 2, "o_custkey", "o_custkey || '.0'"),
    _type_of("orders", 3, "o_totalprice", "CASE WHEN o_totalprice > 480000 THEN 'not a number' ELSE CAST(o_totalprice AS VARCHAR) END"),
    _type_of("orders", 4, "is_final", "CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END"),
    _type_of("orders", 5, "nothing", "CAST(NULL AS VARCHAR)"),
    _type_of("part", 1, "p_partkey", "CAST(p_partkey AS VARCHAR)"),
    _type_of("part", 2, "p_size", "CAST(nullif(p_size, 1) AS VARCHAR)"),
    _type_of("part", 3, "p_retailprice", "CAST(p_retailprice AS VARCHAR)"),
    _type_of("part", 4, "p_name", "p_name"),
    _type_of("customer", 1, "c_acctbal", "CAST(c_acctbal AS VARCHAR)"),
    _type_of("customer", 2, "c_custkey", "c_custkey || 'e0'"),
    _type_of("lineitem", 1, "l_quantity", "CAST(l_quantity AS VARCHAR)"),
    _type_of("lineitem", 2, "l_discount", "CAST(l_discount AS VARCHAR)"),
    "SELECT 'lineitem' AS table_name, 3 AS ordinal, 'l_linenumber' AS column_name, 'int' AS inferred_type, count(*) AS filled FROM lineitem",
])

# ---- relationships -----------------------------------------------------------------------------------------------

# Pair by pair, over ctes cols, pks and fks (flat key lists) with the flagged columns of FLAGGED.
EDGES = """,
pk_of AS (SELECT source, table_name, list(column_name ORDER BY position) AS pk FROM pks GROUP BY source, table_name),
tbl AS (
  SELECT c.source, c.table_name, list(c.column_name ORDER BY c.ordinal) AS names, coalesce(any_value(p.pk), []) AS pk,
         trim(regexp_replace(regexp_replace(lower(c.table_name), '^olist_', ''), '_dataset$', ''), '_') AS core
  FROM cols c LEFT JOIN pk_of p ON c.source = p.source AND c.table_name = p.table_name GROUP BY c.source, c.table_name),
child AS (
  SELECT f.source, f.table_name, f.column_name, f.ordinal, lower(f.column_name) AS fc,
         CASE WHEN lower(f.column_name) LIKE '%\\_id' ESCAPE '\\'
              THEN nullif(trim(left(lower(f.column_name), length(f.column_name) - 3), '_'), '') END AS s
  FROM flagged f JOIN tbl t ON f.source = t.source AND f.table_name = t.table_name
  WHERE NOT f.is_foreign_key AND NOT (len(t.pk) = 1 AND t.pk[1] = f.column_name)),
kids AS (
  SELECT c.* FROM child c JOIN tbl t ON c.source = t.source AND c.table_name = t.table_name
  WHERE NOT coalesce(c.fc = c.s || '_id' AND t.core IN (c.s, c.s || 's'), false)),
pair AS (
  SELECT k.source, k.table_name AS from_table, k.column_name AS from_column, k.ordinal, k.fc, k.s,
         o.table_name AS to_table, o.core, o.pk, o.names, [lower(x) FOR x IN o.names] AS low,
         coalesce(o.core = k.s OR o.core = k.s || 's' OR rtrim(o.core, 's') = k.s, false) AS exact
  FROM kids k JOIN tbl o ON k.source = o.source AND k.table_name <> o.table_name),
scored AS (
  SELECT *, CASE
      WHEN list_contains([lower(x) FOR x IN pk], fc) THEN 0.95
      WHEN exact AND list_contains(low, fc) THEN 0.95
      WHEN s IS NULL THEN 0.0
      WHEN exact OR list_contains(string_split(core, '_'), s) OR starts_with(core, s) THEN 0.8
      WHEN length(s) >= 3 AND (contains(core, s) OR contains(s, core)) THEN 0.6 ELSE 0.0 END AS score,
    CASE WHEN list_contains(low, fc) THEN names[list_position(low, fc)] WHEN len(pk) = 1 THEN pk[1]
         WHEN list_contains(low, s || '_id') THEN names[list_position(low, s || '_id')] ELSE coalesce(pk[1], names[1]) END AS to_column
  FROM pair
  WHERE s IS NULL OR list_contains(low, fc) OR list_contains(low, s || '_id')),
implied AS (
  SELECT source, from_table, from_column, to_table, to_column, false AS is_explicit, CAST(score AS DOUBLE) AS confidence,
         ordinal AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY source, from_table, from_column ORDER BY score DESC, to_table, to_column) AS rn
        FROM scored WHERE score >= 0.6) WHERE rn = 1),
declared AS (SELECT source, table_name AS from_table, from_column, to_table, to_column, true AS is_explicit,
                    CAST(1.0 AS DOUBLE) AS confidence, min(fk_position) AS position
             FROM fks GROUP BY ALL),
fk_of AS (SELECT source, table_name, count(DISTINCT fk_position) AS n, list(DISTINCT to_table) AS referred,
                 list_sort(list(DISTINCT from_column)) AS fk_cols FROM fks GROUP BY source, table_name),
junction AS (SELECT f.source, f.table_name, f.referred FROM fk_of f JOIN tbl t ON f.source = t.source AND f.table_name = t.table_name
             WHERE f.n >= 2 AND len(f.referred) >= 2 AND len(t.pk) > 0 AND list_sort(t.pk) = f.fk_cols),
both_kinds AS (SELECT * FROM declared UNION ALL SELECT * FROM implied),
edges AS (
  SELECT e.source, e.from_table, e.from_column, e.to_table, e.to_column,
    CASE WHEN EXISTS (SELECT 1 FROM junction j WHERE j.source = e.source AND j.table_name = e.from_table) THEN 'one_to_many'
         WHEN EXISTS (SELECT 1 FROM junction j WHERE j.source = e.source AND j.table_name <> e.from_table AND j.table_name <> e.to_table
                      AND list_contains(j.referred, e.from_table) AND list_contains(j.referred, e.to_table)) THEN 'many_to_many'
         WHEN EXISTS (SELECT 1 FROM flagged f JOIN tbl t ON f.source = t.source AND f.table_name = t.table_name
                      WHERE f.source = e.source AND f.table_name = e.from_table AND f.is_foreign_key AND len(t.pk) = 1
                      AND t.pk[1] = f.column_name AND starts_with(f.foreign_key_references, e.to_table || '.')) THEN 'one_to_one'
         ELSE 'one_to_many' END AS relationship_type,
    e.is_explicit, e.confidence, e.position
  FROM both_kinds e)"""

EDGE_COLUMNS = "source, from_table, from_column, to_table, to_column, relationship_type, is_explicit, confidence"
ESTATE_EDGES = f"{WITH_ESTATE}{FLAGGED}{EDGES}"

ORACLES["explicit_edges"] = f"{ESTATE_EDGES} SELECT {EDGE_COLUMNS} FROM edges WHERE is_explicit"
ORACLES["implicit_edges"] = f"{ESTATE_EDGES} SELECT {EDGE_COLUMNS} FROM edges WHERE NOT is_explicit"
ORACLES["relationship_map"] = f"{ESTATE_EDGES} SELECT {EDGE_COLUMNS} FROM edges"
ORACLES["junctions"] = (
    f"{ESTATE_EDGES} SELECT source, table_name, array_to_string(list_sort(referred), ',') AS referred FROM junction")
ORACLES["adjacency"] = (
    f"{ESTATE_EDGES}, arcs AS (SELECT source, from_table, to_table, string_agg(from_column || '>' || to_column, ',' "
    "ORDER BY is_explicit DESC, position, from_column) AS edges FROM edges GROUP BY source, from_table, to_table), "
    "nodes AS (SELECT source, from_table FROM edges UNION SELECT source, to_table FROM edges) "
    "SELECT n.source, n.from_table, a.to_table, a.edges FROM nodes n LEFT JOIN arcs a "
    "ON n.source = a.source AND n.from_table = a.from_table")
TOUCH = (", touch AS (SELECT DISTINCT source, t AS table_name, from_table || '.' || from_column || ' -> ' || to_table || '.' || "
         "to_column AS edge FROM (SELECT *, unnest([from_table, to_table]) AS t FROM edges))")
ORACLES["edges_of_tables"] = (
    f"{ESTATE_EDGES}{TOUCH} SELECT source, table_name, string_agg(edge, '; ' ORDER BY edge) AS relationships "
    "FROM touch GROUP BY source, table_name")
ORACLES["er_diagram"] = (
    f"{ESTATE_EDGES}, src AS (SELECT DISTINCT source FROM edges) "
    "SELECT source, 0 AS section, '' AS sort_key, 'erDiagram' AS line FROM src UNION ALL "
    "SELECT source, CASE WHEN is_explicit THEN 1 ELSE 2 END, from_table, '    ' || to_table || CASE relationship_type "
    "WHEN 'one_to_many' THEN ' ||--o{ ' WHEN 'many_to_many' THEN ' }o--o{ ' ELSE ' ||--|| ' END || from_table || "
    "' : \"' || from_column || '\"' FROM edges UNION ALL "
    "SELECT t.source, 3, t.table_name, unnest(['    ' || t.table_name || ' {', '    }']) FROM tbl t JOIN src s ON t.source = s.source")

# ---- personal data -----------------------------------------------------------------------------------------------

NAME_RULES = """CASE
  WHEN contains(c, 'email') THEN 'EMAIL=0.95' WHEN contains(c, 'phone') OR contains(c, 'fax') THEN 'PHONE=0.95'
  WHEN contains(c, 'address') OR contains(c, 'street') THEN 'LOCATION=0.9'
  WHEN contains(c, 'zip') OR contains(c, 'postal') OR contains(c, 'city') OR regexp_matches(c, '(^|_)state($|_)') THEN 'LOCATION=0.75'
  WHEN contains(c, 'dob') OR contains(c, 'birth') THEN 'DATE_OF_BIRTH=0.95'
  WHEN contains(c, 'card') OR contains(c, 'account') OR contains(c, 'iban') THEN 'FINANCIAL=0.95'
  WHEN contains(c, 'latitude') OR ends_with(c, 'lat') OR contains(c, '_lat') OR starts_with(c, 'lat_')
    OR contains(c, 'longitude') OR contains(c, 'lng') THEN 'LOCATION=0.85'
  WHEN contains(c, 'name') AND NOT contains(c, 'username') THEN 'NAME=0.8'
  WHEN ends_with(c, '_id') THEN 'ID=0.7' END"""

NAMED = f""",
ruled AS (SELECT *, string_split(rule, '=')[1] AS pii_type, CAST(string_split(rule, '=')[2] AS DOUBLE) AS confidence
          FROM (SELECT *, {NAME_RULES} AS rule FROM (SELECT *, lower(column_name) AS c FROM flagged)) WHERE rule IS NOT NULL),
named AS (SELECT source, table_name, column_name, pii_type, confidence FROM ruled WHERE NOT (pii_type = 'ID' AND is_foreign_key))"""

ORACLES["pii_by_name"] = f"{WITH_ESTATE}{FLAGGED}{NAMED} SELECT source, table_name, column_name, pii_type, confidence FROM ruled"
ORACLES["pii_id_suppression"] = (
    f"{WITH_ESTATE}{FLAGGED}{NAMED} SELECT source, table_name, column_name, confidence FROM named WHERE pii_type = 'ID'")
ORACLES["findings_by_table"] = (
    f"{WITH_ESTATE}{FLAGGED}{NAMED} SELECT source, table_name, string_agg(column_name || ':' || pii_type, ',' "
    "ORDER BY column_name, pii_type) AS findings, count(DISTINCT column_name) AS pii_column_count FROM named GROUP BY source, table_name")

SUMMARY = """ SELECT c.source, c.columns_scanned, coalesce(n.rule_hits, 0) AS rule_based_hits, coalesce(n.value_hits, 0) AS value_finding_rows,
  coalesce(n.kept, 0) AS findings_after_dedupe, coalesce(n.cols, 0) AS total_pii_columns, coalesce(n.tables, '') AS tables_with_pii,
  coalesce(t.by_type, '') AS by_pii_type
  FROM (SELECT source, count(*) AS columns_scanned FROM flagged GROUP BY source) c
  LEFT JOIN (SELECT source, count(*) FILTER (rule) AS rule_hits, count(*) FILTER (NOT rule) AS value_hits,
                    count(DISTINCT (table_name, column_name, pii_type)) AS kept, count(DISTINCT (table_name, column_name)) AS cols,
                    array_to_string(list_sort(list(DISTINCT table_name)), ',') AS tables FROM found GROUP BY source) n ON c.source = n.source
  LEFT JOIN (SELECT source, string_agg(pii_type || '=' || n, ',' ORDER BY pii_type) AS by_type FROM (
               SELECT source, pii_type, count(DISTINCT (table_name, column_name)) AS n FROM found GROUP BY source, pii_type)
             GROUP BY source) t ON c.source = t.source"""

ORACLES["pii_summary_of_estate"] = (
    f"{WITH_ESTATE}{FLAGGED}{NAMED}, found AS (SELECT *, true AS rule FROM named){SUMMARY}")


def luhn(m: str) -> str:
    d = f"reverse(regexp_replace({m}, '[ -]', '', 'g'))"
    return (f"length({d}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(substr({d}, i, 1) AS INT) "
            f"WHEN CAST(substr({d}, i, 1) AS INT) < 5 THEN 2 * CAST(substr({d}, i, 1) AS INT) "
            f"ELSE 2 * CAST(substr({d}, i, 1) AS INT) - 9 END FOR i IN range(1, length({d}) + 1)]) % 10 = 0")


def iban(m: str) -> str:
    """Checksum on the whole number; 68 digits would not fit, so it is taken in two halves of at most 30 characters."""
    c = f"regexp_replace({m}, ' ', '', 'g')"
    t = f"(substr({c}, 5) || substr({c}, 1, 4))"
    digits = (f"array_to_string([CASE WHEN substr({t}, i, 1) BETWEEN '0' AND '9' THEN substr({t}, i, 1) "
              f"ELSE CAST(ascii(substr({t}, i, 1)) - 55 AS VARCHAR) END FOR i IN range(1, length({t}) + 1)], '')")
    first = f"CAST(TRY_CAST(substr({digits}, 1, 30) AS HUGEINT) % 97 AS VARCHAR)"
    rest = f"substr({digits}, 31)"
    second = f"CAST(TRY_CAST({first} || substr({rest}, 1, 30) AS HUGEINT) % 97 AS VARCHAR)"
    return (f"length({c}) BETWEEN 15 AND 34 AND TRY_CAST({second} || substr({rest}, 31) AS HUGEINT) % 97 = 1")


CARD_RUNS = r"regexp_extract_all(cell, '\b[0-9](?:[ -]?[0-9]){12,}[A-Za-z_]?')"


def _card_ends(w: str, p: str, e: str) -> str:
    """Whether places p to e of a run are a card number that begins and ends with a group of digits."""
    return (f"({p} = 1 OR substr({w}, {p} - 1, 1) IN (' ', '-')) AND substr({w}, {p}, 1) NOT IN (' ', '-') AND "
            f"({e} = length({w}) OR substr({w}, {e} + 1, 1) IN (' ', '-')) AND substr({w}, {e}, 1) NOT IN (' ', '-') AND {luhn(f'substr({w}, {p}, {e} - {p} + 1)')}")


def card_matches(frm: str) -> str:
    """Ctes over rows (r, cell): all card numbers of every run of digits, then from left to right those that lie apart."""
    return (f"""run AS (SELECT r, regexp_replace(unnest({CARD_RUNS}), '[ -]?[0-9]+[A-Za-z_]$', '') AS w, unnest(range(len({CARD_RUNS}))) AS nth FROM {frm}),
  begun AS (SELECT *, unnest(range(1, length(w) - 11)) AS p FROM run), ended AS (SELECT *, unnest(range(p + 12, least(p + 36, length(w)) + 1)) AS e FROM begun),
  card AS (SELECT r, nth, w, p, min(e) AS e FROM ended WHERE {_card_ends('w', 'p', 'e')} GROUP BY ALL),
  apart AS (SELECT r, nth, min(p) AS p, arg_min(e, p) AS e FROM card GROUP BY r, nth
            UNION ALL SELECT c.r, c.nth, min(c.p), arg_min(c.e, c.p) FROM apart a JOIN card c ON c.r = a.r AND c.nth = a.nth AND c.p > a.e GROUP BY c.r, c.nth)""")


def iban_matches(cell: str) -> str:
    """List of the account numbers in a text: every place where one may begin, tried with its country's length."""
    def layout(n: int) -> str:
        rest = f"(?: ?[A-Z0-9]{{{(n - 4) % 4}}})" if (n - 4) % 4 else ""
        return f"'{n}': '^([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{rest})(?:[^A-Za-z0-9_]|$)'"

    size = f"map {{{', '.join(f"'{c}': '{n}'" for c, n in pii.IBAN_LENGTHS.items())}}}[substr({cell}, p, 2)]"
    shape = f"map {{{', '.join(layout(n) for n in sorted(set(pii.IBAN_LENGTHS.values())))}}}"
    found = (f"[regexp_extract(substr({cell}, p, 48), coalesce({shape}[{size}], '^(x)$y'), 1) FOR p IN range(1, length({cell}) - 13) IF regexp_matches(substr({cell}, p, 4), "
             f"'^[A-Z]{{2}}[0-9]{{2}}$') AND (p = 1 OR NOT regexp_matches(substr({cell}, p - 1, 1), '[A-Za-z0-9_]'))]")
    return f"CASE WHEN regexp_matches({cell}, '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}') THEN [m FOR m IN {found} IF m <> '' AND {iban('m')}] ELSE [] END"


def matches(frm: str, key: str, text: str) -> str:
    def one(entity: str, kind: str, found: str) -> str:
        return f"SELECT k AS {key}, '{kind}' AS pii_type, '{entity}' AS entity_type, unnest({found}) AS match FROM cells"

    every = " UNION ALL ".join([
        one("EMAIL_ADDRESS", "EMAIL", f"regexp_extract_all(cell, {_sql(pii.EMAIL)})"), one("PHONE_NUMBER", "PHONE", f"regexp_extract_all(cell, {_sql(pii.PHONE)})"),
        one("IBAN_CODE", "FINANCIAL", iban_matches("cell")),
        f"SELECT c.k, 'FINANCIAL', 'CREDIT_CARD', substr(run.w, a.p, a.e - a.p + 1) FROM apart a JOIN run ON run.r = a.r AND run.nth = a.nth JOIN cells c ON c.r = a.r"])
    return f"WITH RECURSIVE cells AS (SELECT row_number() OVER () AS r, {key} AS k, {text} AS cell FROM {frm}), {card_matches('cells')} {every}"


ORACLES["pii_documents"] = matches("documents", "doc_id", "text")
ORACLES["pii_conversations"] = matches(f"({SIGNED.replace('{conversations}', 'conversations')})", "turn_key", "text")


def star_catalog(tables: list[Table]) -> str:
    """The given tables as ctes cols, pks and fks."""
    def rows(values: list[str], names: str) -> str:
        return f"(SELECT * FROM (VALUES {', '.join(values)}) v({names}))"

    cols = [f"('{SOURCE}', '{t.label}', {i}, '{n}')" for t in tables for i, n, _ in t.columns]
    pks = [f"('{SOURCE}', '{t}', {i}, '{c}')" for t, (pk, _) in STAR_KEYS.items() for i, c in enumerate(pk, 1)]
    fks = [f"('{SOURCE}', '{t}', {i}, '{c}', '{r}', '{rc}')" for t, (_, f) in STAR_KEYS.items()
           for i, (cs, r, rcs) in enumerate(f) for c, rc in zip(cs, rcs)]
    return (f"WITH cols AS {rows(cols, 'source, table_name, ordinal, column_name')}, "
            f"pks AS {rows(pks, 'source, table_name, position, column_name')}, "
            f"fks AS {rows(fks, 'source, table_name, fk_position, from_column, to_table, to_column')}")


def value_hits(tables: list[Table]) -> str:
    """Hits by value over text columns no name rule caught, as ctes cells and hits."""
    caught = {("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")}
    found = " UNION ALL ".join(
        f"SELECT '{t.label}' AS table_name, '{n}' AS column_name, CAST({n} AS VARCHAR) AS cell FROM {t.frm}"
        for t in tables for _, n, k in t.columns if k == "text" and (t.label, n) not in caught)
    cards = (f"[w FOR w IN [regexp_replace(x, '[ -]?[0-9]+[A-Za-z_]$', '') FOR x IN {CARD_RUNS}] IF "
             f"len([p FOR p IN range(1, length(w) - 11) IF len([e FOR e IN range(p + 12, least(p + 36, length(w)) + 1) IF {_card_ends('w', 'p', 'e')}]) > 0]) > 0]")
    luhn_hit, iban_hit = f"len({cards}) > 0", f"len({iban_matches('cell')}) > 0"
    kinds = [("EMAIL_ADDRESS", "EMAIL", 1.0, f"regexp_matches(cell, {_sql(pii.EMAIL)})"),
             ("PHONE_NUMBER", "PHONE", 0.75, f"regexp_matches(cell, {_sql(pii.PHONE)})"),
             ("CREDIT_CARD", "FINANCIAL", 1.0, luhn_hit), ("IBAN_CODE", "FINANCIAL", 1.0, iban_hit)]
    short = "CASE WHEN length(trim(cell)) > 200 THEN left(trim(cell), 197) || '...' ELSE trim(cell) END"
    hits = " UNION ALL ".join(
        f"SELECT table_name, column_name, '{e}' AS entity_type, '{k}' AS pii_type, count(*) FILTER ({hit}) AS hits, "
        f"count(*) AS total_rows, CAST({conf} AS DOUBLE) AS confidence, min({short}) FILTER ({hit}) AS sample_trigger "
        f"FROM cells GROUP BY table_name, column_name" for e, k, conf, hit in kinds)
    return f"cells AS ({found}), hits AS (SELECT * FROM ({hits}) WHERE hits > 0)"


ORACLES["pii_values"] = (
    f"WITH {value_hits(GIVEN)} SELECT table_name, column_name, entity_type, pii_type, hits, total_rows, "
    "round(CAST(hits AS DOUBLE) / total_rows, 9) AS hit_rate, confidence, sample_trigger FROM hits")


def star_findings(tables: list[Table]) -> str:
    """Catalogue, edges and all findings of the given tables as ctes."""
    return (f"{star_catalog(tables)}{FLAGGED}{EDGES}{NAMED}, {value_hits(tables)}, found AS ("
            f"SELECT source, table_name, column_name, pii_type, 'rule_based' AS detection_method, confidence, "
            f"CAST(NULL AS VARCHAR) AS sample_trigger, true AS rule FROM named UNION ALL "
            f"SELECT '{SOURCE}', table_name, column_name, pii_type, 'value_scan', confidence, sample_trigger, false FROM hits), "
            f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name, pii_type "
            f"ORDER BY confidence DESC, detection_method, sample_trigger) AS rn FROM found) WHERE rn = 1)")


ORACLES["pii_findings"] = (
    f"{star_findings(GIVEN)} SELECT table_name, column_name, pii_type, detection_method, confidence, sample_trigger FROM best")
ORACLES["pii_summary"] = f"{star_findings(GIVEN)}{SUMMARY}"

# ---- snapshots and drift -----------------------------------------------------------------------------------------

HASH = ("SELECT {key}, md5(string_agg(table_name || ':' || names, chr(10) ORDER BY table_name)) AS schema_hash FROM ("
        "SELECT {key}, table_name, string_agg(column_name, ',' ORDER BY column_name) AS names FROM {cols} "
        "GROUP BY {key}, table_name) GROUP BY {key}")
ORACLES["schema_hash"] = f"{WITH_ESTATE} " + HASH.format(key="source", cols="cols")

WITH_HISTORY = "WITH " + HISTORY.replace("{events}", "events") + (
    ", head AS (SELECT *, 'data/user ' || user_id AS source_key FROM headers)")
ORACLES["snapshot_build"] = (
    f"{WITH_HISTORY}, h AS ({HASH.format(key='snapshot_id', cols='scols')}), m AS (SELECT snapshot_id, "
    "string_agg(table_name, ',' ORDER BY table_name) AS table_names, "
    "string_agg(table_name || '=' || column_count, ',' ORDER BY table_name) AS column_counts, "
    "string_agg(table_name || '=' || row_count, ',' ORDER BY table_name) AS row_counts, "
    "string_agg(table_name || '=' || CAST(round(completeness_score * 1000) AS BIGINT), ',' ORDER BY table_name) AS completeness_scores "
    "FROM stabs GROUP BY snapshot_id) SELECT head.snapshot_id, source_key, captured_at, table_names, column_counts, row_counts, "
    "completeness_scores, schema_hash FROM head JOIN m ON head.snapshot_id = m.snapshot_id JOIN h ON head.snapshot_id = h.snapshot_id")
ORACLES["snapshot_list"] = (
    f"{WITH_HISTORY} SELECT head.snapshot_id, source_path, captured_at, n AS table_count FROM head JOIN "
    "(SELECT snapshot_id, count(*) AS n FROM stabs GROUP BY snapshot_id) t ON head.snapshot_id = t.snapshot_id")
ORACLES["latest_snapshots"] = (
    f"{WITH_HISTORY} SELECT source_key, snapshot_id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY source_key "
    "ORDER BY captured_at DESC) AS rn FROM head) WHERE rn = 1")
ORACLES["newest_reports"] = (
    f"{WITH_HISTORY} SELECT source_key, path, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY source_key "
    "ORDER BY generated_at DESC, path DESC) AS rn FROM (SELECT source_key, 'reports/' || snapshot_id || '.html' AS path, "
    "CAST(date_trunc('day', captured_at) AS TIMESTAMP) AS generated_at FROM head)) WHERE rn = 1")
PAIRS = (", pairs AS (SELECT * FROM (SELECT lag(snapshot_id) OVER (PARTITION BY source_key ORDER BY captured_at) AS snapshot_id_before, "
         "snapshot_id AS snapshot_id_after, source_key FROM head) WHERE snapshot_id_before IS NOT NULL)")
ORACLES["consecutive_snapshots"] = f"{WITH_HISTORY}{PAIRS} SELECT * FROM pairs"
CHANGES = """,
bef AS (SELECT p.snapshot_id_before, p.snapshot_id_after, t.* FROM pairs p JOIN stabs t ON p.snapshot_id_before = t.snapshot_id),
aft AS (SELECT p.snapshot_id_before, p.snapshot_id_after, t.* FROM pairs p JOIN stabs t ON p.snapshot_id_after = t.snapshot_id),
tc AS (
  SELECT coalesce(b.snapshot_id_before, a.snapshot_id_before) AS snapshot_id_before,
         coalesce(b.snapshot_id_after, a.snapshot_id_after) AS snapshot_id_after,
         coalesce(b.table_name, a.table_name) AS table_name,
         CASE WHEN b.table_name IS NULL THEN 'added' WHEN a.table_name IS NULL THEN 'removed' ELSE 'kept' END AS change,
         b.row_count AS rows_before, a.row_count AS rows_after,
         CASE WHEN b.row_count = 0 THEN CASE WHEN a.row_count = 0 THEN 0.0 ELSE 1.0 END
              ELSE CAST(a.row_count - b.row_count AS DOUBLE) / b.row_count END AS row_delta,
         a.completeness_score - b.completeness_score AS score_delta
  FROM bef b FULL JOIN aft a ON b.snapshot_id_after = a.snapshot_id_after AND b.table_name = a.table_name)"""
ORACLES["drift_tables"] = (
    f"{WITH_HISTORY}{PAIRS}{CHANGES} SELECT snapshot_id_before, snapshot_id_after, table_name, change, rows_before, rows_after, "
    "round(row_delta, 9) AS row_delta, round(score_delta, 9) AS score_delta FROM tc")
ORACLES["drift"] = f"""{WITH_HISTORY}{PAIRS}{CHANGES},
kept AS (SELECT * FROM tc WHERE change = 'kept'),
plus AS (SELECT k.snapshot_id_after, k.table_name, string_agg(c.column_name, '+' ORDER BY c.column_name) AS names
         FROM kept k JOIN scols c ON c.snapshot_id = k.snapshot_id_after AND c.table_name = k.table_name
         WHERE NOT EXISTS (SELECT 1 FROM scols o WHERE o.snapshot_id = k.snapshot_id_before AND o.table_name = k.table_name
                           AND o.column_name = c.column_name) GROUP BY k.snapshot_id_after, k.table_name),
minus AS (SELECT k.snapshot_id_after, k.table_name, string_agg(c.column_name, '+' ORDER BY c.column_name) AS names
          FROM kept k JOIN scols c ON c.snapshot_id = k.snapshot_id_before AND c.table_name = k.table_name
          WHERE NOT EXISTS (SELECT 1 FROM scols o WHERE o.snapshot_id = k.snapshot_id_after AND o.table_name = k.table_name
                            AND o.column_name = c.column_name) GROUP BY k.snapshot_id_after, k.table_name),
t AS (SELECT snapshot_id_after,
        string_agg(table_name, ',' ORDER BY table_name) FILTER (change = 'added') AS ta, count(*) FILTER (change = 'added') AS na,
        string_agg(table_name, ',' ORDER BY table_name) FILTER (change = 'removed') AS tr, count(*) FILTER (change = 'removed') AS nr,
        string_agg(table_name, ',' ORDER BY table_name) FILTER (abs(score_delta) > 0.02) AS cc, count(*) FILTER (abs(score_delta) > 0.02) AS nc,
        string_agg(table_name, ',' ORDER BY table_name) FILTER (abs(row_delta) > 0.05) AS rc, count(*) FILTER (abs(row_delta) > 0.05) AS nrc
      FROM tc GROUP BY snapshot_id_after),
p AS (SELECT snapshot_id_after, string_agg(table_name || ':' || names, ',' ORDER BY table_name) AS v, count(*) AS n FROM plus GROUP BY snapshot_id_after),
m AS (SELECT snapshot_id_after, string_agg(table_name || ':' || names, ',' ORDER BY table_name) AS v, count(*) AS n FROM minus GROUP BY snapshot_id_after),
w AS (SELECT pairs.*, coalesce(ta, '') AS tables_added, coalesce(tr, '') AS tables_removed, coalesce(p.v, '') AS columns_added,
        coalesce(m.v, '') AS columns_removed, coalesce(cc, '') AS completeness_changes, coalesce(rc, '') AS row_count_changes,
        coalesce(nr, 0) > 0 OR coalesce(m.n, 0) > 0 AS has_breaking_changes,
        concat_ws('; ', CASE WHEN na > 0 THEN na || ' table(s) added' END, CASE WHEN nr > 0 THEN nr || ' table(s) removed' END,
          CASE WHEN p.n > 0 THEN 'columns added in ' || p.n || ' table(s)' END,
          CASE WHEN m.n > 0 THEN 'columns removed in ' || m.n || ' table(s)' END,
          CASE WHEN nc > 0 THEN 'completeness shifted in ' || nc || ' table(s)' END,
          CASE WHEN nrc > 0 THEN 'row-count drift in ' || nrc || ' table(s)' END) AS parts
      FROM pairs LEFT JOIN t ON pairs.snapshot_id_after = t.snapshot_id_after LEFT JOIN p ON pairs.snapshot_id_after = p.snapshot_id_after
      LEFT JOIN m ON pairs.snapshot_id_after = m.snapshot_id_after)
SELECT * EXCLUDE (parts), CASE WHEN parts = '' THEN 'No drift detected between snapshots.' ELSE parts || '.' END AS summary FROM w"""

BEFORE, AFTER = [t for t in GIVEN if t.label in SPOILT], [*SPOILT.values(), next(t for t in GIVEN if t.label == "nation")]
LOST = {t.label: [n for _, n, _ in t.columns if n not in [x for _, x, _ in SPOILT[t.label].columns]] for t in BEFORE}
ORACLES["stored_drift"] = (
    f"WITH b AS ({sizes(BEFORE)}), a AS ({sizes(AFTER)}), j AS (SELECT a.table_name, a.completeness_score - b.completeness_score AS score, "
    "CAST(a.total_rows - b.total_rows AS DOUBLE) / b.total_rows AS rows FROM a JOIN b ON a.table_name = b.table_name) "
    "SELECT 'data/warehouse' AS source_key, 'nation' AS tables_added, '' AS tables_removed, '' AS columns_added, "
    f"'{','.join(f'{t}:{"+".join(sorted(c))}' for t, c in sorted(LOST.items()) if c)}' AS columns_removed, "
    "coalesce(string_agg(table_name || ':' || CAST(round(score * 10000) AS BIGINT), ',' ORDER BY table_name) FILTER (abs(score) > 0.02), '') AS completeness_changes, "
    "coalesce(string_agg(table_name || ':' || CAST(round(rows * 10000) AS BIGINT), ',' ORDER BY table_name) FILTER (abs(rows) > 0.05), '') AS row_count_changes, "
    "true AS has_breaking_changes FROM j")

# ---- views -------------------------------------------------------------------------------------------------------

STAR_VIEW = f"{star_findings(MIXED)}{TOUCH}, prof AS ({profiles(MIXED)}), rate AS (SELECT *, CAST(null_count AS DOUBLE) / total_rows AS null_rate FROM ({nulls(MIXED)}))"

ORACLES["table_rollup"] = (
    f"{STAR_VIEW} SELECT p.table_name, p.total_rows AS row_count, p.total_columns AS column_count, "
    "round(p.completeness_score, 9) AS completeness_score, p.flag AS has_quality_issues, coalesce(f.n, 0) AS pii_column_count, "
    "coalesce(t.edges, '') AS relationships FROM prof p "
    "LEFT JOIN (SELECT table_name, count(DISTINCT column_name) AS n FROM best GROUP BY table_name) f ON p.table_name = f.table_name "
    "LEFT JOIN (SELECT table_name, string_agg(edge, '; ' ORDER BY edge) AS edges FROM touch GROUP BY table_name) t "
    "ON p.table_name = t.table_name")
ORACLES["overall_stats"] = (
    f"{STAR_VIEW} SELECT (SELECT count(*) FROM prof) AS total_tables, (SELECT CAST(sum(total_columns) AS BIGINT) FROM prof) AS total_columns, "
    "(SELECT round(avg(completeness_score), 9) FROM prof) AS overall_completeness, (SELECT count(*) FROM edges) AS total_relationships, "
    "(SELECT count(DISTINCT (table_name, column_name)) FROM best) AS total_pii_columns")
ORACLES["column_dictionary"] = (
    f"{STAR_VIEW} SELECT c.table_name, c.ordinal, c.column_name, c.is_primary_key, c.is_foreign_key, c.foreign_key_references, "
    f"round(r.null_rate, 9) AS null_rate, round(r.null_rate * 100, 2) AS null_rate_pct, {quality('1 - r.null_rate')} AS quality_class, "
    "coalesce(f.kinds, '') AS pii_types FROM flagged c JOIN rate r ON c.table_name = r.table_name AND c.column_name = r.column_name "
    "LEFT JOIN (SELECT table_name, column_name, string_agg(pii_type, ',' ORDER BY pii_type) AS kinds FROM best "
    "GROUP BY table_name, column_name) f ON c.table_name = f.table_name AND c.column_name = f.column_name")

UNIQUE = per_column(MIXED, lambda t, i, n, k: f"{i} AS ordinal, '{n}' AS column_name, count(*) - count({t.present(n, k)}) AS null_count, "
                                              f"count(DISTINCT {t.present(n, k)}) AS unique_count")
FOUND = "(SELECT table_name, string_agg(column_name || ':' || pii_type, ',' ORDER BY column_name, pii_type) AS pii FROM best GROUP BY table_name)"
EDGE_LISTS = "(SELECT table_name, string_agg(edge, '; ' ORDER BY edge) AS edges FROM touch GROUP BY table_name)"
ORACLES["table_detail"] = (
    f"{STAR_VIEW}, uniq AS ({UNIQUE}) SELECT p.table_name, p.total_rows AS row_count, p.total_columns AS column_count, "
    "round(p.completeness_score, 9) AS completeness_score, p.flag AS has_quality_issues, coalesce(e.edges, '') AS relationships, coalesce(f.pii, '') AS findings, "
    "u.ordinal, u.column_name, c.is_primary_key, c.foreign_key_references, u.null_count, u.unique_count "
    f"FROM prof p JOIN uniq u ON u.table_name = p.table_name JOIN flagged c ON c.table_name = u.table_name AND c.column_name = u.column_name "
    f"LEFT JOIN {FOUND} f ON f.table_name = p.table_name LEFT JOIN {EDGE_LISTS} e ON e.table_name = p.table_name WHERE p.table_name = 'orders'")
ORACLES["dictionary_document"] = (
    f"{STAR_VIEW}, uniq AS ({UNIQUE}), "
    "cc AS (SELECT u.table_name, string_agg(u.column_name || ':' || c.is_primary_key || ':' || c.is_foreign_key, ',' ORDER BY u.ordinal) AS columns, "
    "string_agg(u.column_name || ':' || u.null_count || ':' || u.unique_count, ',' ORDER BY u.ordinal) AS profiles "
    "FROM uniq u JOIN flagged c ON c.table_name = u.table_name AND c.column_name = u.column_name GROUP BY u.table_name), "
    "ee AS (SELECT table_name, string_agg(e, ',' ORDER BY e) AS edges FROM (SELECT unnest(list_distinct([from_table, to_table])) AS table_name, "
    "from_table || '.' || from_column || '.' || to_table || '.' || to_column AS e FROM edges) GROUP BY table_name), "
    "kk AS (SELECT table_name, string_agg('fk_' || table_name || '_' || fk_position || ':' || to_table, ',' ORDER BY fk_position) AS foreign_keys FROM fks GROUP BY table_name) "
    "SELECT p.table_name, p.total_rows AS row_count, round(p.completeness_score, 9) AS completeness_score, p.duplicate_row_count, cc.columns, cc.profiles, "
    "coalesce(kk.foreign_keys, '') AS foreign_keys, ee.edges, f.pii FROM prof p JOIN cc ON cc.table_name = p.table_name "
    f"LEFT JOIN kk ON kk.table_name = p.table_name LEFT JOIN ee ON ee.table_name = p.table_name LEFT JOIN {FOUND} f ON f.table_name = p.table_name")
ORACLES["database_document"] = (
    f"{STAR_VIEW}, o AS (SELECT * FROM ({ORACLES['overall_stats'].removeprefix(STAR_VIEW)})), "
    "b AS (SELECT string_agg(pii_type || '=' || n, ',' ORDER BY pii_type) AS by_pii_type FROM (SELECT pii_type, count(*) AS n FROM best GROUP BY pii_type)), "
    "a AS (SELECT string_agg(from_table || '>' || t, ',' ORDER BY from_table) AS adjacency FROM (SELECT from_table, string_agg(to_table, '+' ORDER BY to_table) AS t "
    "FROM (SELECT DISTINCT from_table, to_table FROM edges) GROUP BY from_table)), "
    "i AS (SELECT coalesce(string_agg(table_name, ',' ORDER BY table_name), '') AS tables_with_issues FROM prof WHERE flag), "
    f"s AS ({HASH.format(key='source', cols='cols')}) "
    f"SELECT '{SOURCE}' AS source, '2024-01-01T00:00:00' AS generated_at, o.*, i.tables_with_issues, a.adjacency, b.by_pii_type, s.schema_hash FROM o, b, a, i, s")


def _database(source: str, tables: list[Table]) -> str:
    return (f"SELECT '{source}' AS source, p.table_name, p.total_rows AS row_count, p.total_columns AS column_count, round(p.completeness_score, 9) AS completeness_score, "
            f"p.flag AS has_quality_issues, n.columns, n.null_rates, printf('Completeness (avg): %.3f; duplicate rows: %d; quality flag: %s', p.completeness_score, "
            f"p.duplicate_row_count, CASE WHEN p.flag THEN 'True' ELSE 'False' END) AS data_quality_notes, count(*) OVER () AS total_tables, "
            f"round(avg(p.completeness_score) OVER (), 9) AS overall_completeness FROM ({profiles(tables)}) p JOIN (SELECT table_name, count(*) AS columns, "
            f"round(sum(CAST(null_count AS DOUBLE) / total_rows), 6) AS null_rates FROM ({nulls(tables)}) GROUP BY table_name) n ON n.table_name = p.table_name")


ORACLES["two_databases"] = " UNION ALL ".join([
    _database("given", [t for t in GIVEN if t.label in SPOILT]), _database("spoilt", list(SPOILT.values()))])

# ---- texts -------------------------------------------------------------------------------------------------------

ORACLES["fallback_column_notes"] = (
    f"SELECT table_name, column_name, CASE WHEN null_count > 0 THEN CAST(round_even(100 * CAST(null_count AS DOUBLE) / total_rows, 0) "
    f"AS INT) || '% null rate — may be optional or sparse' END AS data_notes FROM ({nulls(MIXED)})")

ORACLES["fallback_summaries"] = (
    f"{WITH_ESTATE}{FLAGGED}{NAMED}, "
    "prof AS (SELECT t.source, t.name AS table_name, t.n, 1.0 / count(*) AS score FROM tabs t JOIN cols c ON t.source = c.source "
    "AND t.name = c.table_name GROUP BY t.source, t.name, t.n), "
    "warn AS (SELECT source, table_name, 'Possible PII columns: ' || string_agg(column_name || ' (' || pii_type || ')', ', ' "
    "ORDER BY column_name) AS pii_warning FROM named GROUP BY source, table_name) "
    "SELECT p.source, p.table_name, array_to_string([upper(left(x, 1)) || substr(x, 2) FOR x IN string_split(p.table_name, '_')], ' ') "
    "AS suggested_business_name, "
    "printf('Completeness (avg): %.3f; duplicate rows: %d; quality flag: %s', CAST(score AS DOUBLE), n - 1, "
    "CASE WHEN n > 3 THEN 'True' ELSE 'False' END) AS data_quality_notes, pii_warning "
    "FROM prof p LEFT JOIN warn w ON p.source = w.source AND p.table_name = w.table_name")

NO_TEXT = "'Auto-generated description unavailable'"
_BODY = ("'{\"business_description\":\"Order \\\"' || o_orderkey || '\\\" of a customer\",\"suggested_business_name\":\"' || "
         "CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Order ' || o_orderstatus END || '\"' || "
         "CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',\"pii_warning\":\"' || o_orderstatus || '\"' END || "
         "',\"columns\":[{\"column_name\":\"o_orderkey\",\"business_description\":\"' || o_orderstatus || '\"},"
         "{\"column_name\":\"unknown\",\"business_description\":\"x\"},"
         "{\"column_name\":\" o_orderkey \",\"business_description\":\"' || o_orderpriority || '\"}]}'")
ORACLES["parse_responses"] = (
    "WITH r AS (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS parsed FROM orders) "
    "SELECT 'order_' || o_orderkey AS table_name, parsed, "
    "CASE WHEN parsed THEN 'Order \"' || o_orderkey || '\" of a customer' "
    f"WHEN o_orderpriority = '5-LOW' THEN '[' || {_BODY} || ']' "
    "ELSE '{\"business_description\": \"order ' || o_orderkey END AS business_description, "
    "CASE WHEN parsed THEN CASE WHEN o_orderstatus = 'F' THEN 'order_' || o_orderkey ELSE 'Order ' || o_orderstatus END END "
    f"AS suggested_business_name, {NO_TEXT} AS business_purpose, "
    "CASE WHEN parsed THEN nullif(o_orderstatus, 'P') END AS pii_warning FROM r")
ORACLES["merge_tables"] = (
    f"WITH p AS ({ORACLES['parse_responses']}), f AS (SELECT 'order_' || o_orderkey AS table_name FROM orders UNION ALL SELECT 'order_none') "
    "SELECT f.table_name, coalesce(p.business_description, 'business_description of ' || f.table_name) AS business_description, "
    "coalesce(p.suggested_business_name, 'suggested_business_name of ' || f.table_name) AS suggested_business_name, "
    f"CASE WHEN p.parsed IS NULL THEN 'business_purpose of ' || f.table_name ELSE {NO_TEXT} END AS business_purpose, "
    f"CASE WHEN coalesce(p.parsed, false) THEN {NO_TEXT} ELSE 'data_quality_notes of ' || f.table_name END AS data_quality_notes, "
    "CASE WHEN coalesce(p.parsed, false) THEN p.pii_warning ELSE 'pii_warning of ' || f.table_name END AS pii_warning "
    "FROM f LEFT JOIN p ON p.table_name = f.table_name")
ORACLES["parse_response_columns"] = (
    "SELECT 'order_' || o_orderkey AS table_name, 1 AS ordinal, 'o_orderkey' AS column_name, "
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority "
    f"ELSE {NO_TEXT} END AS business_description, 'o_orderkey' AS suggested_business_name, CAST(NULL AS VARCHAR) AS data_notes FROM orders "
    f"UNION ALL SELECT 'order_' || o_orderkey, 2, 'o_custkey', {NO_TEXT}, 'o_custkey', NULL FROM orders")

ORACLES["reuse_summaries"] = (
    f"{WITH_ESTATE} SELECT source, table_name, md5(string_agg(md5(column_name), '' ORDER BY md5(column_name))) AS table_digest "
    "FROM cols GROUP BY source, table_name HAVING bool_or(column_name = 'discard')")
ORACLES["history_of_source"] = f"{WITH_HISTORY} SELECT snapshot_id, source_path, captured_at FROM head WHERE source_key = 'data/user 1'"


def fixed(x: str, digits: int) -> str:
    """Decimal digits, ties away from zero."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(18, 9)), {digits}) AS DECIMAL(18, {digits})) AS VARCHAR)"


def yes(x: str) -> str:
    return f"CASE WHEN {x} THEN 'True' ELSE 'False' END"


TITLES = "array_to_string([upper(left(x, 1)) || substr(x, 2) FOR x IN string_split(table_name, '_')], ' ')"
ORACLES["database_prompts"] = (
    f"WITH t AS (SELECT unnest([{', '.join(repr(t.label) for t in GIVEN)}]) AS table_name) SELECT '{SOURCE}' AS source, "
    f"{_sql(summaries.DATABASE_HEAD)} || 'Database: {SOURCE}' || chr(10) || 'Tables: {len(GIVEN)}' || chr(10) || 'Columns: {sum(len(t.columns) for t in GIVEN)}' || chr(10) || chr(10) || "
    "'Its tables, as JSON:' || chr(10) || '[ ' || string_agg('{' || chr(10) || '  \"table_name\" : \"' || table_name || '\",' || chr(10) || "
    f"'  \"suggested_business_name\" : \"' || {TITLES} || '\",' || chr(10) || '  \"business_purpose\" : \"' || {NO_TEXT} || '\",' || chr(10) || "
    f"'  \"business_description\" : \"' || {NO_TEXT} || '\"' || chr(10) || '}}', ', ' ORDER BY table_name) || ' ]' || {_sql(summaries.DATABASE_TAIL)} AS prompt FROM t")

KINDS = "map {'BIGINT': 'bigint', 'INTEGER': 'int', 'DOUBLE': 'double', 'VARCHAR': 'string', 'TIMESTAMP': 'timestamp_ntz', 'FLOAT[]': 'array<float>', 'DOUBLE[]': 'array<double>'}"
TYPES = per_column(MIXED, lambda t, i, n, k: f"'{n}' AS column_name, any_value(typeof({n})) AS kind, count(*) AS n")
ORACLES["table_prompts"] = (
    f"{STAR_VIEW}, uniq AS ({UNIQUE}), kinds AS ({TYPES}), "
    f"cl AS (SELECT u.table_name, string_agg('  - ' || u.column_name || ': ' || {KINDS}[k.kind] || ' (nullable=True, PK=' || {yes('c.is_primary_key')} || ', FK=' || "
    f"{yes('c.is_foreign_key')} || ')', chr(10) ORDER BY u.ordinal) AS schema_lines, string_agg('  - ' || u.column_name || ': null_rate=' || "
    f"{fixed('CAST(u.null_count AS DOUBLE) / k.n', 3)} || ', uniqueness_rate=' || {fixed('CAST(u.unique_count AS DOUBLE) / k.n', 3)}, chr(10) ORDER BY u.ordinal) AS profile_lines "
    "FROM uniq u JOIN flagged c ON c.table_name = u.table_name AND c.column_name = u.column_name JOIN kinds k ON k.table_name = u.table_name AND k.column_name = u.column_name GROUP BY u.table_name), "
    "el AS (SELECT table_name, string_agg(line, chr(10) ORDER BY is_explicit DESC, from_table, position, line) AS edge_lines FROM (SELECT *, unnest(list_distinct([from_table, to_table])) AS table_name, "
    "'  - ' || from_table || '.' || from_column || ' -> ' || to_table || '.' || to_column || ' (' || relationship_type || ', ' || CASE WHEN is_explicit THEN 'explicit' ELSE 'implicit' END || "
    f"', confidence=' || {fixed('confidence', 2)} || ')' AS line FROM edges) GROUP BY table_name), "
    f"pl AS (SELECT table_name, string_agg('  - ' || column_name || ': ' || pii_type || ' via ' || detection_method || ' (confidence=' || {fixed('confidence', 2)} || ')', chr(10) "
    "ORDER BY column_name, pii_type) AS pii_lines FROM best GROUP BY table_name) "
    f"SELECT p.table_name, {_sql(summaries.TABLE_HEAD)} || 'Table: ' || p.table_name || chr(10) || 'Rows in the catalogue: ' || p.total_rows || chr(10) || 'Rows profiled: ' || p.total_rows || chr(10) || "
    f"'Share of cells filled, mean over columns: ' || {fixed('p.completeness_score', 4)} || chr(10) || 'Rows that repeat another: ' || p.duplicate_row_count || chr(10) || "
    f"'Flagged for quality: ' || {yes('p.flag')} || chr(10) || chr(10) || 'Schema:' || chr(10) || cl.schema_lines || chr(10) || chr(10) || 'Figures by column:' || chr(10) || cl.profile_lines || "
    "chr(10) || chr(10) || 'Links to and from other tables:' || chr(10) || coalesce(el.edge_lines, '  (none detected)') || chr(10) || chr(10) || 'Columns that may hold personal data:' || chr(10) || "
    f"coalesce(pl.pii_lines, '  (none flagged)') || {_sql(summaries.TABLE_TAIL)} AS prompt FROM prof p JOIN cl ON cl.table_name = p.table_name LEFT JOIN el ON el.table_name = p.table_name "
    "LEFT JOIN pl ON pl.table_name = p.table_name")
