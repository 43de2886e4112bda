"""Result frames a reader queries: roll-ups, column dictionary, quality issues, one table's detail.

Every frame that comes in carries a source column (catalog.with_source adds it to profiles), so several databases that share table names stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablelore.functions.cells import percent, quality_label
from tablelore.operators import pii, profiling, relationships

TABLE = ["source", "table_name"]


def table_rollup(tables: DataFrame, profiles: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per profiled table: size, completeness, quality flag, PII columns, edges."""
    return (tables.join(profiles.select(*TABLE, "completeness_score", "has_data_quality_issues"), TABLE)
            .join(pii.pii_columns_per_table(findings), TABLE, "left")
            .join(relationships.edge_lists(edges), TABLE, "left")
            .select(*TABLE, "row_count", "column_count", "completeness_score",
                    F.col("has_data_quality_issues").alias("has_quality_issues"),
                    F.coalesce("pii_column_count", F.lit(0)).cast("long").alias("pii_column_count"),
                    F.coalesce("relationships", F.array().cast("array<string>")).alias("relationships")))


def overall_stats(tables: DataFrame, profiles: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per source: tables, columns, completeness, edges, PII columns."""
    size = tables.groupBy("source").agg(F.count(F.lit(1)).alias("total_tables"),
                                        F.sum("column_count").cast("long").alias("total_columns"))
    score = (tables.select(*TABLE).join(profiles.select(*TABLE, "completeness_score"), TABLE)
             .groupBy("source").agg(F.avg("completeness_score").alias("overall_completeness")))
    n_edges = edges.groupBy("source").agg(F.count(F.lit(1)).alias("total_relationships"))
    n_pii = findings.groupBy("source").agg(F.count_distinct("table_name", "column_name").alias("total_pii_columns"))
    zero = F.lit(0).cast("long")
    return (size.join(score, "source", "left").join(n_edges, "source", "left").join(n_pii, "source", "left")
            .select("source", "total_tables", "total_columns",
                    F.coalesce("overall_completeness", F.lit(1.0)).alias("overall_completeness"),
                    F.coalesce("total_relationships", zero).alias("total_relationships"),
                    F.coalesce("total_pii_columns", zero).alias("total_pii_columns")))


def column_dictionary(columns: DataFrame, profiles: DataFrame, findings: DataFrame,
                      summaries: DataFrame | None = None) -> DataFrame:
    """Every column of every profiled table with its type, keys, quality, description and PII findings."""
    found = findings.groupBy(*TABLE, "column_name").agg(F.array_sort(F.collect_list(F.struct(
        "pii_type", "detection_method", "confidence", "sample_trigger"))).alias("pii_findings"))
    rates = profiles.select(*TABLE, "column_name", "null_rate")
    out = (columns.join(profiles.select(*TABLE).distinct(), TABLE, "left_semi")
           .join(rates, [*TABLE, "column_name"], "left")
           .join(found, [*TABLE, "column_name"], "left"))
    if summaries is not None:
        out = out.join(summaries.select(*TABLE, "column_name", "business_description",
                                        F.col("suggested_business_name").alias("business_name")),
                       [*TABLE, "column_name"], "left")
    else:
        out = out.withColumn("business_description", F.lit(None).cast("string")).withColumn(
            "business_name", F.lit(None).cast("string"))
    rate = F.coalesce("null_rate", F.lit(0.0))
    empty = F.array().cast("array<struct<pii_type:string,detection_method:string,confidence:double,sample_trigger:string>>")
    return out.select(
        *TABLE, "ordinal", "column_name", "data_type", "is_nullable", "is_primary_key", "is_foreign_key",
        "foreign_key_references", rate.alias("null_rate"), percent(rate).alias("null_rate_pct"),
        quality_label(1 - rate).alias("quality_class"), "business_description", "business_name",
        F.coalesce("pii_findings", empty).alias("pii_findings"))


def table_report(profiles: DataFrame) -> DataFrame:
    """Table profiles with the percentage and label a report shows."""
    return (profiles.withColumn("completeness_pct", percent(F.col("completeness_score")))
            .withColumn("completeness_class", quality_label(F.col("completeness_score"))))


def quality_issues(table_profiles: DataFrame, column_profiles: DataFrame, n: int = 3) -> DataFrame:
    """Flagged tables with their n columns of most missing cells."""
    worst = profiling.top_null_columns(column_profiles, n).groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.struct("rank", "column_name", "null_rate"))).alias("top_null_columns"))
    return (table_profiles.filter("has_data_quality_issues").join(worst, TABLE, "left")
            .select(*TABLE, "completeness_score", "duplicate_row_count", "top_null_columns"))


def table_detail(table: str, columns: DataFrame, column_profiles: DataFrame, rollup: DataFrame, findings: DataFrame,
                 summaries: DataFrame | None = None) -> DataFrame:
    """Schema, profile, edges, findings and description of one table; the name is filtered before any join."""
    at = F.col("table_name") == table
    schema = columns.filter(at).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", "column_name", "data_type", "is_nullable", "is_primary_key", "is_foreign_key",
        "foreign_key_references", "default_value"))).alias("table_schema"))
    profile = column_profiles.filter(at).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
        *column_profiles.drop(*TABLE).columns))).alias("profile"))
    out = (schema.join(profile, TABLE).join(rollup.filter(at), TABLE)
           .join(pii.findings_by_table(findings.filter(at)), TABLE, "left"))
    if summaries is not None:
        out = out.join(summaries.filter(at).select(*TABLE, F.struct("*").alias("summary")), TABLE, "left")
    return out


def newest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest report of each source (columns source_key, path, generated_at); a tie goes to the greater path."""
    newest = F.max_by(F.struct("path", "generated_at"), F.struct("generated_at", "path"))
    return artifacts.groupBy("source_key").agg(newest.alias("n")).select("source_key", "n.*")
