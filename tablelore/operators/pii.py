"""Personal data: by column name first, then by the values of the columns no name rule caught."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelore.functions import cells, pii
from tablelore.operators.catalog import table_names, union_all

MIN_CONFIDENCE = 0.70
FINDING = ["source", "table_name", "column_name", "pii_type", "detection_method", "confidence", "sample_trigger"]


def by_name(columns: DataFrame) -> DataFrame:
    """Findings from column names. An ID hit on a declared foreign key is withdrawn."""
    hit = columns.withColumn("hit", pii.pii_of_name(F.col("column_name"))).filter("hit IS NOT NULL")
    return (hit.filter(~((F.col("hit.pii_type") == "ID") & F.col("is_foreign_key")))
            .select("source", "table_name", "column_name", F.col("hit.pii_type").alias("pii_type"),
                    F.lit("rule_based").alias("detection_method"), F.col("hit.confidence").alias("confidence"),
                    F.lit(None).cast("string").alias("sample_trigger")))


def _unnamed(tables: dict[str, DataFrame], columns: DataFrame, source: str | None) -> dict[str, list[T.StructField]]:
    """Text columns left for the value scan. Only name hits on text columns of the tables at hand come to the driver: fewer than their schemas hold."""
    texts = {(t, f.name): f for t in table_names(tables) for f in tables[t].schema.fields if isinstance(f.dataType, T.StringType)}
    here = columns.filter(F.col("table_name").isin(*tables))
    if source is not None:
        here = here.filter(F.col("source") == source)
    hits = by_name(here).filter(F.col("column_name").isin(*{c for _, c in texts}))
    named = {(r.table_name, r.column_name) for r in hits.select("table_name", "column_name").distinct().collect()}
    out: dict[str, list[T.StructField]] = {}
    for (t, c), f in texts.items():
        if (t, c) not in named:
            out.setdefault(t, []).append(f)
    return out


def _text_cells(tables: dict[str, DataFrame], fields: dict[str, list[T.StructField]]) -> DataFrame:
    """The cells to scan, one row per cell; only the columns in question are read."""
    def one(t: str) -> DataFrame:
        cell = F.array(*[F.struct(F.lit(f.name).alias("column_name"), cells.ref(f.name).alias("cell")) for f in fields[t]])
        return (tables[t].select(F.lit(t).alias("table_name"), F.inline(cell)))

    return union_all([one(t) for t in fields]).filter("cell IS NOT NULL")


def value_hits(tables: dict[str, DataFrame], columns: DataFrame,
               recognise: Callable[[Column], Column] | None = None, source: str | None = None) -> DataFrame | None:
    """Rows and hits per (table, column, entity), from one scan of the text columns no name rule caught.

    Only cells with a hit reach the aggregation, and equal hits are added up before they are shuffled.
    ``recognise`` may add entities that need a language model: a function from a text column to an
    array of struct(entity_type, score), usually a pandas_udf. ``source`` says whose tables these are, where columns hold several databases.
    """
    fields = _unnamed(tables, columns, source)
    if not fields:
        return None
    cell = F.col("cell")
    built_in = F.array_compact(F.array(*[
        F.when(flag, F.struct(F.lit(entity).alias("entity_type"), F.lit(pii.ENTITY_CONFIDENCE[entity]).alias("score")))
        for entity, flag in pii.entity_flags(cell).items()]))
    entities = built_in if recognise is None else F.concat(built_in, recognise(cell))
    found = (_text_cells(tables, fields).select("table_name", "column_name", "cell", F.inline(entities))
             .filter((F.col("score") >= MIN_CONFIDENCE) & pii.report_type(F.col("entity_type")).isNotNull()))
    hits = found.groupBy("table_name", "column_name", "entity_type").agg(
        F.count(F.lit(1)).alias("hits"), F.max("score").alias("confidence"), F.min(pii.trigger(cell)).alias("sample_trigger"))
    sizes = union_all([tables[t].agg(F.count(F.lit(1)).alias("total_rows")).withColumn("table_name", F.lit(t)) for t in fields])
    return (hits.join(sizes, "table_name")
            .withColumn("pii_type", pii.report_type(F.col("entity_type")))
            .withColumn("hit_rate", F.col("hits") / F.col("total_rows")))


def by_value(tables: dict[str, DataFrame], columns: DataFrame, source: str,
             recognise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Findings from cell values."""
    hits = value_hits(tables, columns, recognise, source)
    if hits is None:
        return by_name(columns).limit(0)
    return hits.select(F.lit(source).alias("source"), "table_name", "column_name", "pii_type",
                       F.lit("value_scan").alias("detection_method"), "confidence", "sample_trigger")


def best_findings(findings: DataFrame) -> DataFrame:
    """One finding per column and type: the surest, ties in a fixed order."""
    order = F.struct(-F.col("confidence"), F.col("detection_method"), F.col("sample_trigger"))
    best = F.min_by(F.struct("detection_method", "confidence", "sample_trigger"), order)
    return (findings.groupBy("source", "table_name", "column_name", "pii_type").agg(best.alias("b"))
            .select("source", "table_name", "column_name", "pii_type", "b.*"))


def scan(tables: dict[str, DataFrame], columns: DataFrame, source: str,
         recognise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every finding before the choice of the best."""
    return by_name(columns).unionByName(by_value(tables, columns, source, recognise))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("source", "table_name", "column_name", "pii_type")


def findings_by_table(findings: DataFrame) -> DataFrame:
    """The findings of each table as a list."""
    entry = F.struct("column_name", "pii_type", "detection_method", "confidence", "sample_trigger")
    return findings.groupBy("source", "table_name").agg(F.array_sort(F.collect_list(entry)).alias("findings"))


def pii_columns_per_table(findings: DataFrame) -> DataFrame:
    return findings.groupBy("source", "table_name").agg(F.count_distinct("column_name").alias("pii_column_count"))


def summary(found: DataFrame, columns: DataFrame) -> DataFrame:
    """Totals per source: raw hits by method, findings kept, columns and tables hit, findings by type."""
    raw = found.groupBy("source").agg(
        F.count_if(F.col("detection_method") == "rule_based").alias("rule_based_hits"),
        F.count_if(F.col("detection_method") != "rule_based").alias("value_finding_rows"))
    hits = found.select("source", "table_name", "column_name", "pii_type").distinct()
    per_type = hits.groupBy("source", "pii_type").agg(F.count(F.lit(1)).alias("n"))
    by_type = per_type.groupBy("source").agg(
        F.sum("n").alias("findings_after_dedupe"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "n")))).alias("by_pii_type"))
    per_table = hits.groupBy("source", "table_name").agg(F.count_distinct("column_name").alias("n"))
    kept = per_table.groupBy("source").agg(
        F.sum("n").alias("total_pii_columns"), F.array_sort(F.collect_list("table_name")).alias("tables_with_pii"))
    scanned = columns.groupBy("source").agg(F.count(F.lit(1)).alias("columns_scanned"))
    zero = F.lit(0).cast("long")
    return (scanned.join(raw, "source", "left").join(kept, "source", "left").join(by_type, "source", "left")
            .select("source", "columns_scanned", F.coalesce("rule_based_hits", zero).alias("rule_based_hits"),
                    F.coalesce("value_finding_rows", zero).alias("value_finding_rows"),
                    F.coalesce("findings_after_dedupe", zero).alias("findings_after_dedupe"),
                    F.coalesce("total_pii_columns", zero).alias("total_pii_columns"),
                    F.coalesce("tables_with_pii", F.array().cast("array<string>")).alias("tables_with_pii"),
                    F.coalesce("by_pii_type", F.create_map().cast("map<string,bigint>")).alias("by_pii_type")))


def matches_in_text(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every match in every text, one row per match; the checksums have been applied."""
    text = cells.ref(text_column)

    def labelled(entity: str) -> Column:
        kind = F.lit(pii.ENTITY_TYPES[entity]).alias("pii_type")
        return F.transform(pii.MATCHERS[entity](text),
                           lambda m: F.struct(kind, F.lit(entity).alias("entity_type"), m.alias("match")))

    found = [labelled(e) for e in pii.MATCHERS]
    return (df.select(cells.ref(id_column).alias(id_column), F.explode(F.concat(*found)).alias("m"))
            .select(id_column, "m.*"))
