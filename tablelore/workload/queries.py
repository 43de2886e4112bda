"""The registered queries: each reads whole tables, or frames derived from them, through the library."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelore.functions import cells, pii as pii_names
from tablelore.operators import catalog, cleaning, pii, profiling, relationships, sketches, versions
from tablelore.plans import dictionary, summaries, views
from tablelore.session import settle, shared_folder
from tablelore.sources.tables import load_tables
from tablelore.sources.version_store import VersionStore
from tablelore.workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EDGE = ["source", "from_table", "from_column", "to_table", "to_column", "relationship_type", "is_explicit", "confidence"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


# ---- catalogue ---------------------------------------------------------------------------------------------------

def _warehouse(spark: SparkSession, sf: str, tables: dict[str, DataFrame] | None = None):
    tables = tables or inputs.load(spark, sf)
    keys = inputs.star_keys(spark)
    columns = catalog.catalog_columns(catalog.field_frame(spark, tables, inputs.SOURCE), keys)
    return tables, keys, columns


@query
def table_row_counts(spark, sf):
    tables, keys, columns = _warehouse(spark, sf)
    frame = catalog.catalog_tables(columns, catalog.row_counts(tables, inputs.SOURCE), keys)
    return (frame.join(catalog.database_totals(frame), "source")
            .select("table_name", "row_count", "column_count", joined("primary_keys").alias("primary_keys"),
                    "total_tables", "total_columns"))


@query
def catalog_of_tables(spark, sf):
    tables, keys, columns = _warehouse(spark, sf)
    numeric = catalog.numeric_fields(spark, tables, inputs.SOURCE)
    counts = catalog.row_counts(tables, inputs.SOURCE)
    return (columns.join(counts, ["source", "table_name"]).join(numeric, ["source", "table_name", "column_name"])
            .select("table_name", "ordinal", "column_name", "is_numeric", "is_primary_key", "is_foreign_key",
                    "foreign_key_references", "row_count"))


def _estate(spark, sf, estate: inputs.Estate | None = None):
    estate = estate or inputs.Estate(spark, sf)
    keys = estate.keys()
    return keys, catalog.catalog_columns(estate.fields(), keys)


@query
def estate_catalog(spark, sf):
    _, columns = _estate(spark, sf)
    return columns.select("source", "table_name", "ordinal", "column_name", "is_primary_key", "is_foreign_key",
                          "foreign_key_references")


# ---- profiles ----------------------------------------------------------------------------------------------------

def _both(spark, sf) -> dict[str, DataFrame]:
    """All tables as given, and the degraded copies under names of their own."""
    return {**inputs.load(spark, sf), **{f"{t}_degraded": d for t, d in inputs.degraded(spark, sf).items()}}


@query
def column_nulls(spark, sf):
    ranges = profiling.column_ranges(_both(spark, sf))
    return ranges.select("table_name", "ordinal", "column_name", "total_rows", "null_count",
                         F.round("null_rate", 9).alias("null_rate"))


@query
def column_uniqueness(spark, sf):
    tables = _both(spark, sf)
    profiles = profiling.column_profiles(tables, samples=False)
    return profiles.select("table_name", "ordinal", "column_name", "unique_count",
                           F.round("uniqueness_rate", 9).alias("uniqueness_rate"), "is_constant", "is_unique_key")


@query
def numeric_stats(spark, sf):
    tables = _both(spark, sf)
    return (profiling.column_ranges(tables).filter("min_num IS NOT NULL")
            .select("table_name", "column_name", "min_num", "max_num", F.round("mean_value", 5).alias("mean_value")))


@query
def text_min_max(spark, sf):
    tables = _both(spark, sf)
    return (profiling.column_ranges(tables)
            .filter("min_num IS NULL AND data_type IN ('string', 'timestamp_ntz') AND null_count < total_rows")
            .select("table_name", "column_name", "min_value", "max_value"))


@query
def sample_values(spark, sf):
    tables = inputs.load(spark, sf)
    ranges = settle(profiling.column_ranges(tables, estimates=True))
    cells_frame = profiling.distinct_cells(tables, rows=False, limits=profiling.sample_limits(ranges))
    return (profiling.sample_values(tables, cells_frame).join(ranges, ["table_name", "ordinal"])
            .select("table_name", "column_name", joined("sample_values", "|").alias("samples")))


@query
def duplicate_rows(spark, sf):
    tables = _both(spark, sf)
    return profiling.table_profiles(tables).select(
        "table_name", "total_rows", "total_columns", F.round("completeness_score", 9).alias("completeness_score"),
        "duplicate_row_count", "has_data_quality_issues")


@query
def overall_completeness(spark, sf):
    profiles = profiling.table_sizes(profiling.column_ranges(inputs.mixed(spark, sf)))
    return profiling.database_profile(profiles).select(
        "total_tables", F.round("overall_completeness", 9).alias("overall_completeness"))


@query
def sampled_profile(spark, sf):
    orders = inputs.load(spark, sf, "orders")["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    sample = {"orders": profiling.sample_rows(orders, 1000)}
    return profiling.column_profiles(sample, samples=False).select(
        "column_name", "total_rows", "null_count", "unique_count", "min_value", "max_value")


@query
def display_values(spark, sf):
    part = inputs.load(spark, sf, "part")["part"].select(
        "p_partkey", F.col("p_name").cast("binary").alias("p_name"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"),
        F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    return part.select(*[cells.display(f).alias(f.name) for f in part.schema.fields])


@query
def top_null_columns(spark, sf):
    tables = _both(spark, sf)
    ranges = settle(profiling.column_ranges(tables))
    issues = views.quality_issues(*(catalog.with_source(f, inputs.SOURCE) for f in (profiling.table_profiles(tables, ranges), ranges)))
    return (issues.select("table_name", "duplicate_row_count", F.explode("top_null_columns").alias("t"))
            .select("table_name", "duplicate_row_count", "t.rank", "t.column_name", F.round("t.null_rate", 9).alias("null_rate")))


@query
def quality_labels(spark, sf):
    tables = inputs.mixed(spark, sf)
    ranges = profiling.column_ranges(tables)
    sizes = views.table_report(profiling.table_sizes(ranges)).select("table_name", "completeness_pct", "completeness_class")
    return (ranges.join(sizes, "table_name")
            .select("table_name", "column_name", cells.percent(F.col("null_rate")).alias("null_rate_pct"),
                    cells.quality_label(1 - F.col("null_rate")).alias("quality_class"), "completeness_pct", "completeness_class"))


@query
def approximate_distinct(spark, sf):
    """Estimates from mergeable sketches, held against the exact counts: each within four standard errors."""
    tables = _both(spark, sf)
    exact = profiling.distinct_counts(profiling.distinct_cells(tables, rows=False))
    found = sketches.profiles_of(sketches.column_states(tables)).join(exact, ["table_name", "ordinal"], "left")
    unique = F.coalesce("unique_count", F.lit(0))
    near = F.abs(F.col("unique_estimate") - unique) <= 1 + sketches.error_bound() * unique
    return found.select("table_name", "column_name", "total_rows", "null_count", "min_num", "max_num", F.round("mean_value", 5).alias("mean_value"), near.alias("within_bound"))


# ---- cleaning ----------------------------------------------------------------------------------------------------

@query
def clean_strings(spark, sf):
    part = inputs.load(spark, sf, "part")["part"]
    raw = part.select(
        F.concat(F.lit(" \t"), "p_name", F.lit("  ")).alias(" P  Name "),
        F.when(F.col("p_type") == "PROMO", "   ").otherwise(F.col("p_type")).alias("P_Type"),
        F.concat("p_brand", F.lit("\n")).alias("p\tbrand"))
    return cleaning.clean(cleaning.normalise_header(raw))


def _dated(spark, sf) -> DataFrame:
    """Dates of orders written in several ways: month first, day first, named months, with clock and zone; some wrong, some blank."""
    orders = inputs.load(spark, sf, "orders")["orders"]
    day, late = F.col("o_orderdate"), F.col("o_orderpriority") == "5-LOW"
    ordered = (F.when(late, "31.31.2020").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
               .when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderstatus") == "O", F.date_format(day, "MM/dd/yyyy"))
               .otherwise(F.date_format(day, "MMM d, yyyy")))
    delivered = F.when(late, "12/31/1996").otherwise(F.date_format(day, "dd/MM/yyyy"))
    paid = F.when(F.col("o_orderstatus") == "P", F.date_format(day, " yyyy-MM-dd HH:mm:ss ")).otherwise(
        F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return orders.select("o_orderkey", ordered.alias("order_date"), delivered.alias("delivery_date"), paid.alias("paid_time"))


@query
def parse_dates(spark, sf):
    return cleaning.clean(_dated(spark, sf))


@query
def date_layouts(spark, sf):
    return cleaning.date_layouts(cleaning.clean_texts(_dated(spark, sf))).drop("layouts")


@query
def infer_types(spark, sf):
    tables = inputs.load(spark, sf, "orders", "part", "customer", "lineitem")
    dirty = {
        "orders": tables["orders"].select(
            F.col("o_orderkey").cast("string"), F.concat("o_custkey", F.lit(".0")).alias("o_custkey"),
            F.when(F.col("o_totalprice") > 480000, F.lit("1d")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
            F.when(F.col("o_orderstatus") == "F", "True").otherwise("false").alias("is_final"),
            F.lit(None).cast("string").alias("nothing")),
        "part": tables["part"].select(F.col("p_partkey").cast("string"), F.nullif("p_size", F.lit(1)).cast("string").alias("p_size"),
                                      F.col("p_retailprice").cast("string"), "p_name"),
        "customer": tables["customer"].select(F.col("c_acctbal").cast("string"), F.concat("c_custkey", F.lit("e0")).alias("c_custkey")),
        "lineitem": tables["lineitem"].select("l_quantity", "l_discount", "l_linenumber"),
    }
    return catalog.union_all([
        cleaning.type_flags(df).select(F.lit(t).alias("table_name"), "ordinal", "column_name", "inferred_type", "filled")
        for t, df in dirty.items()])


@query
def csv_tables(spark, sf):
    """Tables written as CSV, each with a delimiter of its own, and loaded again: names, types, filled and different cells, sums."""
    folder = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    given = inputs.load(spark, sf, "orders", "part", "customer", "nation", "documents")
    for (name, df), sep in zip(given.items(), (";", "\t", ",", ";", ","), strict=True):
        out = df.select(*[F.col(c).alias(f" {c.upper()} ") for c in df.columns])
        out.write.csv(f"{folder}/{name}.csv", header=True, sep=sep, escape='"', quoteAll=name == "documents", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    tables = load_tables(spark, folder)
    profiles = profiling.column_profiles(tables, samples=False)
    return profiles.select("table_name", "ordinal", "column_name", F.regexp_replace("data_type", "bigint|int", "whole").alias("data_type"), "total_rows", "null_count",
                           "unique_count", "min_num", "max_num", F.round("mean_value", 4).alias("mean_value"))


# ---- relationships -----------------------------------------------------------------------------------------------

@query
def explicit_edges(spark, sf):
    keys, columns = _estate(spark, sf)
    return relationships.with_cardinality(relationships.explicit_edges(keys), columns, keys).select(*EDGE)


@query
def implicit_edges(spark, sf):
    keys, columns = _estate(spark, sf)
    return relationships.with_cardinality(relationships.implicit_edges(columns, keys), columns, keys).select(*EDGE)


@query
def junctions(spark, sf):
    keys, _ = _estate(spark, sf)
    return relationships.junction_tables(keys).select(
        "source", "table_name", joined(F.array_sort("referred")).alias("referred"))


@query
def relationship_map(spark, sf):
    keys, columns = _estate(spark, sf)
    return relationships.relationships(columns, keys).select(*EDGE)


@query
def adjacency(spark, sf):
    keys, columns = _estate(spark, sf)
    arcs = relationships.adjacency(relationships.relationships(columns, keys))
    return arcs.select("source", "from_table", "to_table",
                       joined(F.transform("edges", lambda e: F.concat(e["from_column"], F.lit(">"), e["to_column"]))).alias("edges"))


@query
def edges_of_tables(spark, sf):
    keys, columns = _estate(spark, sf)
    return relationships.edge_lists(relationships.relationships(columns, keys)).select(
        "source", "table_name", joined("relationships", "; ").alias("relationships"))


@query
def er_diagram(spark, sf):
    keys, columns = _estate(spark, sf)
    edges = relationships.relationships(columns, keys)
    lines = relationships.diagram_lines(edges, columns.select("source", "table_name").distinct())
    return lines.select("source", "section", "sort_key", "line")


# ---- personal data -----------------------------------------------------------------------------------------------

@query
def pii_by_name(spark, sf):
    columns = inputs.Estate(spark, sf).fields().withColumn("is_foreign_key", F.lit(False))
    return pii.by_name(columns).select("source", "table_name", "column_name", "pii_type", "confidence")


@query
def pii_id_suppression(spark, sf):
    _, columns = _estate(spark, sf)
    return pii.by_name(columns).filter("pii_type = 'ID'").select("source", "table_name", "column_name", "confidence")


@query
def pii_values(spark, sf):
    tables, _, columns = _warehouse(spark, sf)
    return pii.value_hits(tables, columns).select(
        "table_name", "column_name", "entity_type", "pii_type", "hits", "total_rows",
        F.round("hit_rate", 9).alias("hit_rate"), "confidence", "sample_trigger")


@query
def pii_documents(spark, sf):
    return pii.matches_in_text(inputs.load(spark, sf, "documents")["documents"], "doc_id", "text")


@query
def pii_conversations(spark, sf):
    talk = inputs.load(spark, sf, "conversations")["conversations"]
    return pii.matches_in_text(spark.sql(inputs.SIGNED, conversations=talk), "turn_key", "text")


@query
def pii_findings(spark, sf):
    tables, _, columns = _warehouse(spark, sf)
    found = pii.best_findings(pii.scan(tables, columns, inputs.SOURCE))
    return pii.ordered(found).select("table_name", "column_name", "pii_type", "detection_method", "confidence", "sample_trigger")


def _flat_summary(s: DataFrame) -> DataFrame:
    by_type = F.transform(F.map_entries("by_pii_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("source", "columns_scanned", "rule_based_hits", "value_finding_rows", "findings_after_dedupe",
                    "total_pii_columns", joined("tables_with_pii").alias("tables_with_pii"), joined(by_type).alias("by_pii_type"))


@query
def pii_summary(spark, sf):
    tables, _, columns = _warehouse(spark, sf)
    return _flat_summary(pii.summary(pii.scan(tables, columns, inputs.SOURCE), columns))


@query
def pii_summary_of_estate(spark, sf):
    _, columns = _estate(spark, sf)
    return _flat_summary(pii.summary(pii.by_name(columns), columns))


@query
def findings_by_table(spark, sf):
    _, columns = _estate(spark, sf)
    lists = pii.findings_by_table(pii.best_findings(pii.by_name(columns)))
    text = F.transform("findings", lambda f: F.concat(f["column_name"], F.lit(":"), f["pii_type"]))
    counts = pii.pii_columns_per_table(pii.by_name(columns))
    return (lists.join(counts, ["source", "table_name"])
            .select("source", "table_name", joined(text).alias("findings"), "pii_column_count"))


# ---- snapshots and drift -----------------------------------------------------------------------------------------

@query
def schema_hash(spark, sf):
    return versions.schema_hash(inputs.Estate(spark, sf).fields())


@query
def snapshot_build(spark, sf):
    def text(c: str) -> Column:
        return joined(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))

    s = versions.snapshots(*inputs.history(spark, sf))
    score = F.transform(F.map_entries("completeness_scores"),
                        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string")))
    return s.select("snapshot_id", "source_key", "captured_at", joined("table_names").alias("table_names"),
                    text("column_counts").alias("column_counts"), text("row_counts").alias("row_counts"),
                    joined(score).alias("completeness_scores"), "schema_hash")


@query
def snapshot_list(spark, sf):
    headers, tables, _ = inputs.history(spark, sf)
    return versions.listing(headers, tables).select("snapshot_id", "source_path", "captured_at", "table_count")


@query
def latest_snapshots(spark, sf):
    headers, _, _ = inputs.history(spark, sf)
    return versions.latest(headers).select("source_key", "snapshot_id", "captured_at")


@query
def newest_reports(spark, sf):
    headers, _, _ = inputs.history(spark, sf)
    reports = headers.select("source_key", F.concat(F.lit("reports/"), "snapshot_id", F.lit(".html")).alias("path"),
                             F.date_trunc("day", "captured_at").cast("timestamp_ntz").alias("generated_at"))
    return views.newest_artifacts(reports)


@query
def history_of_source(spark, sf):
    headers, _, _ = inputs.history(spark, sf)
    return versions.of_source(headers, " Data//./user%201/ ").select("snapshot_id", "source_path", "captured_at")


@query
def consecutive_snapshots(spark, sf):
    headers, _, _ = inputs.history(spark, sf)
    return versions.consecutive(headers).select("snapshot_id_before", "snapshot_id_after", "source_key")


@query
def drift(spark, sf):
    def by_table(c: str) -> Column:
        return joined(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+"))))

    d = versions.drift(*inputs.history(spark, sf))
    return d.select(
        "snapshot_id_before", "snapshot_id_after", "source_key", joined("tables_added").alias("tables_added"),
        joined("tables_removed").alias("tables_removed"), by_table("columns_added").alias("columns_added"),
        by_table("columns_removed").alias("columns_removed"),
        joined(F.map_keys("completeness_changes")).alias("completeness_changes"),
        joined(F.map_keys("row_count_changes")).alias("row_count_changes"), "has_breaking_changes", "summary")


@query
def drift_tables(spark, sf):
    headers, tables, _ = inputs.history(spark, sf)
    changes = versions.table_changes(versions.consecutive(headers), tables)
    return changes.select("snapshot_id_before", "snapshot_id_after", "table_name", "change", "rows_before", "rows_after",
                          F.round("row_delta", 9).alias("row_delta"), F.round("score_delta", 9).alias("score_delta"))


@query
def stored_drift(spark, sf):
    """Two snapshots of one source in a version store: as given, then degraded."""
    store = VersionStore(spark, f"{shared_folder(spark).rstrip('/')}/versions-{uuid.uuid4().hex}")
    names = ("customer", "orders", "lineitem")
    for tables in (inputs.load(spark, sf, *names), {**inputs.degraded(spark, sf, *names), **inputs.load(spark, sf, "nation")}):
        report = store.detect_drift(dictionary.snapshot(dictionary.build(spark, tables, "Data/Warehouse", samples=False, find_pii=False)))
    by_table = lambda c: joined(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+"))))
    changes = [joined(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"][d] * 10000).cast("long").cast("string")))).alias(c)
               for c, d in (("completeness_changes", "delta"), ("row_count_changes", "delta_pct"))]
    return report.select("source_key", joined("tables_added").alias("tables_added"), joined("tables_removed").alias("tables_removed"),
                         by_table("columns_added").alias("columns_added"), by_table("columns_removed").alias("columns_removed"), *changes, "has_breaking_changes")


# ---- views -------------------------------------------------------------------------------------------------------

def _dictionary(spark, sf, samples: bool = False) -> dictionary.Dictionary:
    return dictionary.build(spark, inputs.mixed(spark, sf), inputs.SOURCE, inputs.star_keys(spark), samples=samples)


def _rollup_parts(spark, sf):
    """Tables, edges and findings of the given tables, without the column statistics a roll-up does not show."""
    tables, keys, columns = _warehouse(spark, sf, inputs.mixed(spark, sf))
    sizes = catalog.catalog_tables(columns, catalog.row_counts(tables, inputs.SOURCE), keys)
    return tables, sizes, relationships.relationships(columns, keys), pii.scan(tables, columns, inputs.SOURCE)


@query
def table_rollup(spark, sf):
    tables, sizes, edges, found = _rollup_parts(spark, sf)
    return views.table_rollup(sizes, catalog.with_source(profiling.table_profiles(tables), inputs.SOURCE), edges, found).select(
        "table_name", "row_count", "column_count", F.round("completeness_score", 9).alias("completeness_score"),
        "has_quality_issues", "pii_column_count", joined("relationships", "; ").alias("relationships"))


@query
def overall_stats(spark, sf):
    tables, sizes, edges, found = _rollup_parts(spark, sf)
    scores = catalog.with_source(profiling.table_sizes(profiling.column_ranges(tables)), inputs.SOURCE)
    return views.overall_stats(sizes, scores, edges, found).select(
        "total_tables", "total_columns", F.round("overall_completeness", 9).alias("overall_completeness"),
        "total_relationships", "total_pii_columns")


@query
def column_dictionary(spark, sf):
    tables, keys, columns = _warehouse(spark, sf, inputs.mixed(spark, sf))
    findings = pii.best_findings(pii.scan(tables, columns, inputs.SOURCE))
    d = views.column_dictionary(columns, catalog.with_source(profiling.column_ranges(tables), inputs.SOURCE), findings)
    kinds = F.transform("pii_findings", lambda f: f["pii_type"])
    return d.select("table_name", "ordinal", "column_name", "is_primary_key", "is_foreign_key", "foreign_key_references",
                    F.round("null_rate", 9).alias("null_rate"), "null_rate_pct", "quality_class", joined(kinds).alias("pii_types"))


@query
def table_detail(spark, sf):
    d = dictionary.table_detail(spark, inputs.mixed(spark, sf), "orders", inputs.SOURCE, inputs.star_keys(spark))
    kinds = F.transform("findings", lambda f: F.concat(f["column_name"], F.lit(":"), f["pii_type"]))
    column = F.explode(F.arrays_zip("profile", "table_schema")).alias("c")
    return d.select("table_name", "row_count", "column_count", F.round("completeness_score", 9).alias("completeness_score"), "has_quality_issues",
                    joined("relationships", "; ").alias("relationships"), F.coalesce(joined(kinds), F.lit("")).alias("findings"), column).select(
        "table_name", "row_count", "column_count", "completeness_score", "has_quality_issues", "relationships", "findings", "c.profile.ordinal", "c.profile.column_name",
        "c.table_schema.is_primary_key", "c.table_schema.foreign_key_references", "c.profile.null_count", "c.profile.unique_count")


@query
def dictionary_document(spark, sf):
    doc = dictionary.document(_dictionary(spark, sf, samples=True))

    def text(c: str, *fields: str) -> Column:
        return F.coalesce(joined(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))), F.lit(""))

    return doc.select("table_name", "row_count", F.round("completeness_score", 9).alias("completeness_score"), "duplicate_row_count",
                      text("columns", "column_name", "is_primary_key", "is_foreign_key").alias("columns"),
                      text("column_profiles", "column_name", "null_count", "unique_count").alias("profiles"),
                      text("foreign_keys", "fk_name", "referred_table").alias("foreign_keys"),
                      F.array_join(F.array_sort(F.transform("relationships", lambda e: F.concat_ws(".", e["from_table"], e["from_column"], e["to_table"], e["to_column"]))), ",").alias("edges"),
                      F.array_join(F.array_sort(F.transform("pii_findings", lambda f: F.concat_ws(":", f["column_name"], f["pii_type"]))), ",").alias("pii"))


@query
def database_document(spark, sf):
    doc = dictionary.database_document(_dictionary(spark, sf), "2024-01-01T00:00:00")
    arcs = F.transform("adjacency", lambda a: F.concat(a["from_table"], F.lit(">"), F.array_join(a["to_tables"], "+")))
    by_type = F.transform(F.map_entries("pii_summary.by_pii_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return doc.select("source", "generated_at", "total_tables", "total_columns", F.round("overall_completeness", 9).alias("overall_completeness"), "total_relationships",
                      "total_pii_columns", joined("tables_with_issues").alias("tables_with_issues"), joined(arcs).alias("adjacency"), joined(by_type).alias("by_pii_type"),
                      "schema_hash")


@query
def two_databases(spark, sf):
    """Two databases that share table names, one as given, one degraded: nothing of one shows under the other."""
    names = ("customer", "orders", "lineitem")
    parts = [dictionary.build(spark, tables, source, samples=False, find_pii=False)
             for source, tables in (("given", inputs.load(spark, sf, *names)), ("spoilt", inputs.degraded(spark, sf, *names)))]
    both = dictionary.combine(parts)
    stats = both.stats().select("source", "total_tables", F.round("overall_completeness", 9).alias("overall_completeness"))
    rates = both.column_dictionary().groupBy("source", "table_name").agg(F.count(F.lit(1)).alias("columns"), F.round(F.sum("null_rate"), 6).alias("null_rates"))
    notes = both.fallback_summaries().select("source", "table_name", "data_quality_notes")
    return both.rollup().join(rates, ["source", "table_name"]).join(notes, ["source", "table_name"]).join(stats, "source").select(
        "source", "table_name", "row_count", "column_count", F.round("completeness_score", 9).alias("completeness_score"), "has_quality_issues", "columns", "null_rates",
        "data_quality_notes", "total_tables", "overall_completeness")


# ---- texts -------------------------------------------------------------------------------------------------------

@query
def table_prompts(spark, sf):
    return dictionary.prompts(_dictionary(spark, sf)).select("table_name", "prompt")


@query
def fallback_summaries(spark, sf):
    """Profiles of the derived databases: size from the events, a score from their column counts."""
    estate = inputs.Estate(spark, sf)
    _, columns = _estate(spark, sf, estate)
    width = columns.groupBy("source", "table_name").agg(F.count(F.lit(1)).alias("width"))
    profiles = estate.sizes().join(width, ["source", "table_name"]).select(
        "source", "table_name", (F.lit(1.0) / F.col("width")).alias("completeness_score"),
        (F.col("row_count") - 1).alias("duplicate_row_count"), (F.col("row_count") > 3).alias("has_data_quality_issues"))
    return summaries.fallback_tables(profiles, pii.best_findings(pii.by_name(columns))).select(
        "source", "table_name", "suggested_business_name", "data_quality_notes", "pii_warning")


@query
def database_prompts(spark, sf):
    tables, keys, columns = _warehouse(spark, sf, inputs.mixed(spark, sf))
    totals = catalog.database_totals(catalog.catalog_tables(columns, catalog.row_counts(tables, inputs.SOURCE), keys))
    profiles = catalog.with_source(profiling.table_profiles(tables), inputs.SOURCE)
    return summaries.database_prompts(totals, summaries.fallback_tables(profiles, pii.best_findings(pii.by_name(columns))))


@query
def fallback_column_notes(spark, sf):
    tables, _, columns = _warehouse(spark, sf, inputs.mixed(spark, sf))
    return summaries.fallback_columns(columns, profiling.column_ranges(tables)).select("table_name", "column_name", "data_notes")


def _responses(spark, sf) -> DataFrame:
    """One model answer per order; how well-formed it is depends on the order's priority."""
    o = inputs.load(spark, sf, "orders")["orders"]
    body = F.to_json(F.struct(
        F.concat(F.lit('Order "'), F.col("o_orderkey").cast("string"), F.lit('" of a customer')).alias("business_description"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("Order "), "o_orderstatus")).alias("suggested_business_name"),
        F.nullif("o_orderstatus", F.lit("P")).alias("pii_warning"),
        F.array(F.struct(F.lit("o_orderkey").alias("column_name"), F.col("o_orderstatus").alias("business_description")),
                F.struct(F.lit("unknown").alias("column_name"), F.lit("x").alias("business_description")),
                F.struct(F.lit(" o_orderkey ").alias("column_name"), F.col("o_orderpriority").alias("business_description"))
                ).alias("columns")))
    kind = F.col("o_orderpriority")
    text = (F.when(kind == "1-URGENT", body).when(kind == "2-HIGH", F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
            .when(kind == "3-MEDIUM", F.concat(F.lit("Here you are:\n"), body, F.lit("\nAnything else?")))
            .when(kind == "4-NOT SPECIFIED", F.concat(F.lit(' {"business_description": "order '), F.col("o_orderkey").cast("string")))
            .otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    return o.select(F.lit("orders").alias("source"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("table_name"),
                    text.alias("text"))


@query
def parse_responses(spark, sf):
    return summaries.parse_responses(_responses(spark, sf)).select(
        "table_name", "parsed", "business_description", "suggested_business_name", "business_purpose", "pii_warning")


@query
def merge_tables(spark, sf):
    """Answers over fallback texts; one table has no answer."""
    responses = _responses(spark, sf)
    tables = responses.select("source", "table_name").union(spark.createDataFrame([("orders", "order_none")], "source string, table_name string"))
    fallback = tables.select("source", "table_name", *[F.concat(F.lit(f"{c} of "), "table_name").alias(c) for c in (
        "business_description", "suggested_business_name", "business_purpose", "data_quality_notes", "pii_warning")])
    return summaries.merge_tables(summaries.parse_responses(responses), fallback).drop("source")


@query
def parse_response_columns(spark, sf):
    responses = _responses(spark, sf)
    fallback = (responses.select("source", "table_name", F.explode(F.array(
        F.struct(F.lit(1).alias("ordinal"), F.lit("o_orderkey").alias("column_name")),
        F.struct(F.lit(2).alias("ordinal"), F.lit("o_custkey").alias("column_name")))).alias("c"))
        .select("source", "table_name", "c.*", F.lit(summaries.UNAVAILABLE).alias("business_description"),
                F.col("c.column_name").alias("suggested_business_name"), F.lit(None).cast("string").alias("data_notes")))
    return summaries.merge_columns(summaries.parse_response_columns(responses), fallback).drop("source")


@query
def reuse_summaries(spark, sf):
    """Texts were written before some tables got a column `discard`: only these are described again."""
    fields = inputs.Estate(spark, sf).fields()
    stored = versions.table_digests(fields.filter("column_name <> 'discard'"))
    return summaries.still_to_describe(versions.table_digests(fields), stored)
