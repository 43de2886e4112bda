"""The whole dictionary of a set of tables, and where it is written."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelore.operators import catalog, pii, profiling, relationships, versions
from tablelore.plans import summaries, views
from tablelore.session import settle

TABLE = ["source", "table_name"]


@dataclass
class Dictionary:
    """Frames of one source, or of several; each has a source column.

    What was scanned for (row counts, profiles, findings) and the edges are settled: written once to the shared folder and read from there.
    """

    source: str
    columns: DataFrame
    tables: DataFrame
    keys: DataFrame
    edges: DataFrame
    column_profiles: DataFrame
    table_profiles: DataFrame
    findings: DataFrame
    raw_findings: DataFrame

    def rollup(self) -> DataFrame:
        return views.table_rollup(self.tables, self.table_profiles, self.edges, self.findings)

    def stats(self) -> DataFrame:
        return views.overall_stats(self.tables, self.table_profiles, self.edges, self.findings)

    def pii_summary(self) -> DataFrame:
        return pii.summary(self.raw_findings, self.columns)

    def column_dictionary(self, texts: DataFrame | None = None) -> DataFrame:
        return views.column_dictionary(self.columns, self.column_profiles, self.findings, texts)

    def fallback_summaries(self) -> DataFrame:
        return summaries.fallback_tables(self.table_profiles, self.findings)


def build(spark: SparkSession, tables: dict[str, DataFrame], source: str, keys: DataFrame | None = None,
          find_pii: bool = True, samples: bool = True, sample_size: int | None = None) -> Dictionary:
    """Catalogue, edges, profiles and findings of the given tables. Profiles cover every row unless sample_size is set."""
    keys = catalog.no_keys(spark) if keys is None else keys
    columns = settle(catalog.catalog_columns(catalog.field_frame(spark, tables, source), keys))
    profiled = tables if sample_size is None else {t: profiling.sample_rows(df, sample_size) for t, df in tables.items()}
    ranges = settle(profiling.column_ranges(profiled, estimates=samples))
    cells = profiling.distinct_cells(profiled, limits=profiling.sample_limits(ranges) if samples else None)
    found = settle(profiling.counts_and_samples(cells) if samples else profiling.distinct_counts(cells))
    counts, lists = found.drop("sample_values"), found.drop("unique_count") if samples else None
    raw = settle(pii.scan(tables, columns, source) if find_pii else pii.by_name(columns).limit(0))
    column_profiles = settle(profiling.column_profiles(profiled, samples, ranges, cells, counts, lists))
    return Dictionary(
        source=source, columns=columns, keys=keys,
        tables=settle(catalog.catalog_tables(columns, catalog.row_counts(tables, source), keys)),
        edges=settle(relationships.relationships(columns, keys)),
        column_profiles=catalog.with_source(column_profiles, source),
        table_profiles=catalog.with_source(profiling.table_profiles(profiled, ranges, counts), source),
        findings=pii.best_findings(raw), raw_findings=raw)


def combine(parts: list[Dictionary]) -> Dictionary:
    """One dictionary of several databases; tables of one name in two of them are two tables."""
    if twice := {d.source for d in parts if sum(x.source == d.source for x in parts) > 1}:
        raise ValueError(f"sources given twice: {', '.join(sorted(twice))}")
    frames = {f.name: reduce(DataFrame.unionByName, [getattr(d, f.name) for d in parts]) for f in fields(Dictionary) if f.name != "source"}
    return Dictionary(source=", ".join(d.source for d in parts), **frames)


def table_detail(spark: SparkSession, tables: dict[str, DataFrame], table: str, source: str, keys: DataFrame | None = None,
                 column_texts: DataFrame | None = None) -> DataFrame:
    """Schema, profile, edges, findings and descriptions of one table. Only that table is read; of the others, only their schemas."""
    own = {table: tables[table]}
    keys = catalog.no_keys(spark) if keys is None else keys
    every = settle(catalog.catalog_columns(catalog.field_frame(spark, tables, source), keys))
    columns = every.filter(F.col("table_name") == table)
    d = build(spark, own, source, keys)
    edges = relationships.relationships(every, keys).filter((F.col("from_table") == table) | (F.col("to_table") == table))
    return views.table_detail(table, columns, d.column_profiles, views.table_rollup(
        d.tables, d.table_profiles, edges, d.findings), d.findings, column_texts)


def document(d: Dictionary, table_texts: DataFrame | None = None, column_texts: DataFrame | None = None) -> DataFrame:
    """The dictionary as one nested row per table: schema, profile, edges, findings, texts."""
    schema = d.columns.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", "column_name", "data_type", "is_nullable", "is_primary_key", "is_foreign_key",
        "foreign_key_references", "default_value"))).alias("columns"))
    profile = d.column_profiles.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
        *[c for c in d.column_profiles.columns if c not in TABLE]))).alias("column_profiles"))
    fks = catalog.catalog_fks(d.keys).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
        "fk_position", "fk_name", "constrained_columns", "referred_schema", "referred_table", "referred_columns"
    ))).alias("foreign_keys"))
    edges = relationships.edges_by_table(d.edges).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
        "from_table", "from_column", "to_table", "to_column", "relationship_type", "is_explicit", "confidence"
    ))).alias("relationships"))
    out = (d.tables.join(schema, TABLE, "left").join(d.table_profiles, TABLE, "left")
           .join(profile, TABLE, "left").join(fks, TABLE, "left").join(edges, TABLE, "left")
           .join(pii.findings_by_table(d.findings).withColumnRenamed("findings", "pii_findings"), TABLE, "left"))
    if table_texts is not None:
        out = out.join(table_texts.select(*TABLE, F.struct(*[c for c in table_texts.columns if c not in TABLE]).alias("summary")),
                       TABLE, "left")
    if column_texts is not None:
        texts = column_texts.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(
            "ordinal", "column_name", "business_description", "suggested_business_name", "data_notes"))).alias("column_summaries"))
        out = out.join(texts, TABLE, "left")
    return out


def database_document(d: Dictionary, generated_at: str) -> DataFrame:
    """What is true of a database as a whole, one nested row a source: totals, completeness, tables with issues, who refers to whom, personal data."""
    stats = d.stats()
    issues = d.table_profiles.filter("has_data_quality_issues").groupBy("source").agg(F.array_sort(F.collect_list("table_name")).alias("tables_with_issues"))
    arcs = relationships.adjacency(d.edges).filter("to_table IS NOT NULL").groupBy("source", "from_table").agg(
        F.array_sort(F.collect_list("to_table")).alias("to_tables"))
    arcs = arcs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("from_table", "to_tables"))).alias("adjacency"))
    found = d.pii_summary()
    found = found.select("source", F.struct(*[c for c in found.columns if c != "source"]).alias("pii_summary"))
    digest = versions.schema_hash(d.columns)
    none = F.array().cast("array<string>")
    return (stats.join(issues, "source", "left").join(arcs, "source", "left").join(found, "source", "left").join(digest, "source", "left")
            .withColumn("tables_with_issues", F.coalesce("tables_with_issues", none))
            .withColumn("adjacency", F.coalesce("adjacency", F.array().cast("array<struct<from_table: string, to_tables: array<string>>>")))
            .withColumn("generated_at", F.lit(generated_at)))


def write_document(d: Dictionary, folder: str, kind: str, generated_at: str, table_texts: DataFrame | None = None, column_texts: DataFrame | None = None) -> str:
    """The whole dictionary as JSON in a folder named by kind and time: database (a line a source), tables (a line a table), manifest.json.

    The manifest is written last and names the other two with their number of lines; a folder without one is not complete.
    """
    spark = d.columns.sparkSession
    path = f"{folder.rstrip('/')}/dictionary_result_{kind}_{generated_at.replace(':', '-')}"
    parts = {"database": database_document(d, generated_at), "tables": document(d, table_texts, column_texts)}
    lines = {}
    for name, frame in parts.items():
        frame.write.mode("errorifexists").json(f"{path}/{name}")
        lines[name] = spark.read.text(f"{path}/{name}").count()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(json.dumps({"source": d.source, "kind": kind, "generated_at": generated_at, "lines": lines}).encode()))
    finally:
        out.close()
    return path


def prompts(d: Dictionary) -> DataFrame:
    return summaries.table_prompts(d.tables, d.columns, d.table_profiles, d.column_profiles, d.edges, d.findings)


def snapshot(d: Dictionary) -> tuple[DataFrame, DataFrame, DataFrame]:
    return versions.take_snapshot(d.source, d.columns, d.tables, d.table_profiles)
