"""Snapshots of a source over time, and the drift between one and the next.

Snapshots are kept in three flat frames, so that a history of any length is compared with joins:
  headers  (snapshot_id, source_path, source_key, captured_at, schema_hash)
  tables   (snapshot_id, table_name, column_count, row_count, completeness_score, table_digest)
  columns  (snapshot_id, table_name, column_name)
Digests form a tree: of column names, of a table's columns, of a database's tables. Columns are only read of tables whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelore.functions.names import source_key
from tablelore.session import settle

HEADER = "snapshot_id string, source_path string, source_key string, captured_at timestamp_ntz, schema_hash string"
COMPLETENESS_STEP = 0.02
ROW_COUNT_STEP = 0.05


def schema_hash(columns: DataFrame, by: str = "source") -> DataFrame:
    """md5 over one line per table, table:col1,col2, with tables and columns sorted by name.

    One digest over a database's names is sequential by definition. Lines are built per table first, so the final
    group receives one short text per table.
    """
    lines = columns.groupBy(by, "table_name").agg(
        F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("names"))
    ordered = F.array_sort(F.collect_list(F.struct("table_name", "names")))
    text = F.array_join(F.transform(ordered, lambda r: F.concat(r["table_name"], F.lit(":"), r["names"])), "\n")
    return lines.groupBy(by).agg(F.md5(text).alias("schema_hash"))


def table_digests(columns: DataFrame, by: str = "source") -> DataFrame:
    """One digest per table over the digests of its column names; equal digests are equal sets of columns."""
    leaves = F.array_sort(F.collect_list(F.md5("column_name")))
    return columns.groupBy(by, "table_name").agg(F.md5(F.array_join(leaves, "")).alias("table_digest"))


def database_digests(tables: DataFrame, by: str = "source") -> DataFrame:
    """One digest per database over the names and digests of its tables."""
    leaves = F.array_sort(F.collect_list(F.concat(F.md5("table_name"), F.col("table_digest"))))
    return tables.groupBy(by).agg(F.md5(F.array_join(leaves, "")).alias("database_digest"))


def snapshots(headers: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per snapshot with its names, counts and scores in maps."""
    def as_map(value: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", value)))).alias(value + "s")

    maps = tables.groupBy("snapshot_id").agg(
        F.array_sort(F.collect_list("table_name")).alias("table_names"),
        as_map("column_count"), as_map("row_count"), as_map("completeness_score"))
    return (headers.drop("schema_hash").join(maps, "snapshot_id", "left").join(schema_hash(columns, "snapshot_id"), "snapshot_id", "left"))


def take_snapshot(source_path: str, columns: DataFrame, tables: DataFrame, profiles: DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three flat frames of a snapshot taken now; write them at once, for the id is drawn when they run."""
    header = (columns.sparkSession.range(1)
              .select(F.uuid().alias("snapshot_id"), F.lit(source_path).alias("source_path"),
                      source_key(F.lit(source_path)).alias("source_key"),
                      F.localtimestamp().alias("captured_at")))
    digest = schema_hash(columns.select(F.lit("").alias("source"), "table_name", "column_name")).select("schema_hash")
    row = header.join(digest, how="left").first()  # one row; fixes the id for all three frames
    head = columns.sparkSession.createDataFrame([row], HEADER)
    sid = F.lit(row.snapshot_id).alias("snapshot_id")
    scores = profiles.select("table_name", "completeness_score")
    digests = table_digests(columns).select("table_name", "table_digest")
    return (head,
            tables.join(scores, "table_name", "left").join(digests, "table_name", "left")
            .select(sid, "table_name", "column_count", "row_count", "completeness_score", "table_digest"),
            columns.select(sid, "table_name", "column_name"))


def of_source(headers: DataFrame, path: str) -> DataFrame:
    """Snapshots (or drift reports) of one source, oldest first."""
    return headers.filter(F.col("source_key") == source_key(F.lit(path))).orderBy("captured_at")


def latest(frame: DataFrame, time: str = "captured_at", tie: str = "snapshot_id") -> DataFrame:
    """The newest row of each source."""
    newest = F.max_by(F.struct(*[F.col(c) for c in frame.columns]), F.struct(time, tie))
    return frame.groupBy("source_key").agg(newest.alias("newest")).select("newest.*")


def listing(headers: DataFrame, tables: DataFrame) -> DataFrame:
    """Snapshots with their number of tables, newest first."""
    n = tables.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("table_count"))
    return (headers.join(n, "snapshot_id", "left")
            .withColumn("table_count", F.coalesce("table_count", F.lit(0))).orderBy(F.desc("captured_at")))


def consecutive(headers: DataFrame) -> DataFrame:
    """Each snapshot with the one before it of the same source.

    Found per source and day first, then across days from one row per day: a source with most of the history is
    spread over its days.
    """
    day = headers.select("snapshot_id", "source_path", "source_key", "captured_at",
                         F.date_trunc("day", "captured_at").alias("day"))
    in_day = Window.partitionBy("source_key", "day").orderBy("captured_at", "snapshot_id")
    days = Window.partitionBy("source_key").orderBy("day")
    last_of_day = (day.groupBy("source_key", "day")
                   .agg(F.max_by("snapshot_id", F.struct("captured_at", "snapshot_id")).alias("last_id"))
                   .select("source_key", "day", F.lag("last_id").over(days).alias("id_before_day")))
    return (day.withColumn("id_in_day", F.lag("snapshot_id").over(in_day))
            .join(last_of_day, ["source_key", "day"])
            .select(F.coalesce("id_in_day", "id_before_day").alias("snapshot_id_before"),
                    F.col("snapshot_id").alias("snapshot_id_after"), "source_path", "source_key", "captured_at")
            .filter("snapshot_id_before IS NOT NULL"))


PAIR = ["snapshot_id_before", "snapshot_id_after"]


def _side(pairs: DataFrame, frame: DataFrame, end: str) -> DataFrame:
    return pairs.select(*PAIR).join(frame.withColumnRenamed("snapshot_id", end), end)


def row_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(1.0)).otherwise((after - before) / before)


def table_changes(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Both sides of every table of every pair, with the two reported changes; where tables carry digests, those too."""
    def side(end: str, tag: str) -> DataFrame:
        return _side(pairs, tables, end).select(
            *PAIR, "table_name", F.lit(True).alias(f"in_{tag}"),
            F.coalesce("row_count", F.lit(0)).cast("long").alias(f"rows_{tag}"),
            F.coalesce("completeness_score", F.lit(0.0)).alias(f"score_{tag}"),
            *([F.col("table_digest").alias(f"digest_{tag}")] if digested else []))

    digested = "table_digest" in tables.columns
    both = side(PAIR[0], "before").join(side(PAIR[1], "after"), [*PAIR, "table_name"], "full_outer")
    shared = F.col("in_before") & F.col("in_after")
    return (both
            .withColumn("score_delta", F.when(shared, F.col("score_after") - F.col("score_before")))
            .withColumn("row_delta", F.when(shared, row_change(F.col("rows_before"), F.col("rows_after"))))
            .withColumn("change", F.when(F.col("in_before").isNull(), "added")
                        .when(F.col("in_after").isNull(), "removed").otherwise("kept")))


def column_changes(changed: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns that came or went in the tables given as (pair, table_name)."""
    def side(end: str, before: int, after: int) -> DataFrame:
        return (changed.select(*PAIR, "table_name").join(columns.withColumnRenamed("snapshot_id", end), [end, "table_name"])
                .select(*PAIR, "table_name", "column_name", F.lit(before).alias("b"), F.lit(after).alias("a")))

    return (side(PAIR[0], 1, 0).unionByName(side(PAIR[1], 0, 1))
            .groupBy(*PAIR, "table_name", "column_name").agg(F.max("b").alias("b"), F.max("a").alias("a"))
            .filter("a <> b").select(*PAIR, "table_name", "column_name", (F.col("a") == 1).alias("added")))


def _gathered(frame: DataFrame, keep: Column, value: Column, name: str) -> DataFrame:
    """A map from table to value for the rows kept; a pair with none is absent."""
    return (frame.filter(keep).groupBy(*PAIR)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", value.alias("v"))))).alias(name)))


def drift(headers: DataFrame, tables: DataFrame, columns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One report per pair of snapshots; all consecutive pairs of each source unless some are named.

    Pairs and both sides of their tables are worked out once and settled. Columns are read of tables whose digests differ; tables stored without
    digests get them from their columns first.
    """
    pairs = settle(consecutive(headers) if pairs is None else pairs)
    if "table_digest" not in tables.columns:
        tables = tables.join(table_digests(columns, "snapshot_id"), ["snapshot_id", "table_name"], "left")
    changes = settle(table_changes(pairs, tables))
    differ = (F.col("change") == "kept") & ~F.col("digest_before").eqNullSafe(F.col("digest_after"))
    moved = (column_changes(changes.filter(differ), columns)
             .groupBy(*PAIR, "table_name", "added").agg(F.array_sort(F.collect_list("column_name")).alias("names")))
    per_pair = changes.groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.when(F.col("change") == "added", F.col("table_name")))).alias("tables_added"),
        F.array_sort(F.collect_list(F.when(F.col("change") == "removed", F.col("table_name")))).alias("tables_removed"),
        F.array_sort(F.collect_list(F.when(F.abs("score_delta") > COMPLETENESS_STEP, F.struct("table_name", F.struct(
            F.col("score_before").alias("before"), F.col("score_after").alias("after"),
            F.col("score_delta").alias("delta")))))).alias("scores"),
        F.array_sort(F.collect_list(F.when(F.abs("row_delta") > ROW_COUNT_STEP, F.struct("table_name", F.struct(
            F.col("rows_before").alias("before"), F.col("rows_after").alias("after"),
            F.col("row_delta").alias("delta_pct")))))).alias("rows"))
    out = (pairs.join(per_pair, PAIR, "left")
           .join(_gathered(moved, F.col("added"), F.col("names"), "columns_added"), PAIR, "left")
           .join(_gathered(moved, ~F.col("added"), F.col("names"), "columns_removed"), PAIR, "left"))
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,array<string>>")
    out = out.select(
        *PAIR, "source_path", "source_key", "captured_at",
        F.coalesce("tables_added", none).alias("tables_added"), F.coalesce("tables_removed", none).alias("tables_removed"),
        F.coalesce("columns_added", empty).alias("columns_added"),
        F.coalesce("columns_removed", empty).alias("columns_removed"),
        F.coalesce(F.map_from_entries("scores"),
                   F.create_map().cast("map<string,struct<before:double,after:double,delta:double>>")).alias("completeness_changes"),
        F.coalesce(F.map_from_entries("rows"),
                   F.create_map().cast("map<string,struct<before:bigint,after:bigint,delta_pct:double>>")).alias("row_count_changes"))

    def part(c: str, before: str, after: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(before), F.size(c).cast("string"), F.lit(after)))

    parts = F.concat_ws(
        "; ", part("tables_added", "", " table(s) added"), part("tables_removed", "", " table(s) removed"),
        part("columns_added", "columns added in ", " table(s)"), part("columns_removed", "columns removed in ", " table(s)"),
        part("completeness_changes", "completeness shifted in ", " table(s)"),
        part("row_count_changes", "row-count drift in ", " table(s)"))
    return (out
            .withColumn("has_breaking_changes", (F.size("tables_removed") > 0) | (F.size("columns_removed") > 0))
            .withColumn("summary", F.when(parts == "", "No drift detected between snapshots.")
                        .otherwise(F.concat(parts, F.lit(".")))))
