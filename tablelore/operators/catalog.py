"""Catalogue frames: which tables, columns and keys a source holds.

Every frame carries a ``source`` column, so one frame describes any number of databases.
Spark frames know no keys; declared keys come in as a ``keys`` frame (KEYS_SCHEMA).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablelore.functions.cells import is_numeric

FK_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("constrained_columns", T.ArrayType(T.StringType())),
    T.StructField("referred_schema", T.StringType()),
    T.StructField("referred_table", T.StringType()),
    T.StructField("referred_columns", T.ArrayType(T.StringType())),
    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
])

KEYS_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("primary_keys", T.ArrayType(T.StringType())),
    T.StructField("fks", T.ArrayType(FK_TYPE)),
])

FIELD_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("is_nullable", T.BooleanType(), False),
    T.StructField("default_value", T.StringType()),
])


def table_names(tables: dict[str, DataFrame]) -> list[str]:
    return sorted(tables)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_source(frame: DataFrame, source: str) -> DataFrame:
    """A frame on tables, such as their profiles, under the database they belong to."""
    return frame.select(F.lit(source).alias("source"), *[c for c in frame.columns if c != "source"])


def field_frame(spark: SparkSession, tables: dict[str, DataFrame], source: str,
                defaults: dict[tuple[str, str], object] | None = None) -> DataFrame:
    """One row per column of the given tables, read from their schemas; no data is touched."""
    defaults = defaults or {}
    rows = []
    for table in table_names(tables):
        for i, f in enumerate(tables[table].schema.fields, 1):
            default = defaults.get((table, f.name))
            rows.append((source, table, i, f.name, f.dataType.simpleString(), f.nullable,
                         None if default is None else str(default)))
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def numeric_fields(spark: SparkSession, tables: dict[str, DataFrame], source: str) -> DataFrame:
    """Whether each column holds numbers, by the class of its type."""
    rows = [(source, t, f.name, is_numeric(f.dataType)) for t in table_names(tables) for f in tables[t].schema.fields]
    return spark.createDataFrame(rows, "source string, table_name string, column_name string, is_numeric boolean")


def no_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KEYS_SCHEMA)


def plain_fk(fk: Column) -> Column:
    """Key metadata with missing lists turned into empty ones."""
    empty = F.array().cast("array<string>")
    return F.struct(
        fk["name"].alias("fk_name"),
        F.coalesce(fk["constrained_columns"], empty).alias("constrained_columns"),
        fk["referred_schema"].alias("referred_schema"),
        fk["referred_table"].alias("referred_table"),
        F.coalesce(fk["referred_columns"], empty).alias("referred_columns"),
        fk["options"].alias("options"),
    )


def catalog_fks(keys: DataFrame) -> DataFrame:
    """One row per declared foreign key, numbered as declared."""
    return (keys.select("source", "table_name", F.posexplode("fks").alias("fk_position", "fk"))
            .select("source", "table_name", "fk_position", plain_fk(F.col("fk")).alias("fk"))
            .select("source", "table_name", "fk_position", "fk.*"))


def fk_pairs(keys: DataFrame) -> DataFrame:
    """Column lists of each foreign key zipped into pairs; the longer list is cut."""
    n = F.least(F.size("constrained_columns"), F.size("referred_columns"))
    zipped = F.arrays_zip(
        F.slice("constrained_columns", F.lit(1), n).alias("from_column"),
        F.slice("referred_columns", F.lit(1), n).alias("to_column"))
    return (catalog_fks(keys)
            .select("source", "table_name", "fk_position",
                    F.nullif(F.col("referred_table"), F.lit("")).alias("to_table"),
                    F.posexplode(zipped).alias("pair_position", "pair"))
            .select("source", "table_name", "fk_position", "pair_position", "to_table",
                    F.col("pair.from_column").alias("from_column"), F.col("pair.to_column").alias("to_column")))


def fk_targets(keys: DataFrame) -> DataFrame:
    """The reference of each foreign-key column; the last declaration wins."""
    reference = F.concat_ws(".", "to_table", "to_column")
    return (fk_pairs(keys)
            .groupBy("source", "table_name", F.col("from_column").alias("column_name"))
            .agg(F.max_by(reference, F.struct("fk_position", "pair_position")).alias("foreign_key_references")))


def catalog_columns(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns with their key flags."""
    on = ["source", "table_name"]
    return (fields
            .join(keys.select(*on, "primary_keys"), on, "left")
            .join(fk_targets(keys), [*on, "column_name"], "left")
            .select(*on, "ordinal", "column_name", "data_type", "is_nullable",
                    F.coalesce(F.array_contains("primary_keys", F.col("column_name")), F.lit(False)).alias("is_primary_key"),
                    F.col("foreign_key_references").isNotNull().alias("is_foreign_key"),
                    "foreign_key_references", "default_value"))


def row_counts(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """Rows per table; a count reads no column."""
    return union_all([
        tables[t].agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(source).alias("source"), F.lit(t).alias("table_name"), "row_count")
        for t in table_names(tables)])


def catalog_tables(columns: DataFrame, counts: DataFrame, keys: DataFrame) -> DataFrame:
    """Tables with their row count, column count and primary key."""
    on = ["source", "table_name"]
    widths = columns.groupBy(*on).agg(F.count(F.lit(1)).alias("column_count"))
    return (counts.join(widths, on, "left").join(keys.select(*on, "primary_keys"), on, "left")
            .select(*on, "row_count", F.coalesce("column_count", F.lit(0)).cast("long").alias("column_count"),
                    F.coalesce("primary_keys", F.array().cast("array<string>")).alias("primary_keys")))


def database_totals(tables: DataFrame) -> DataFrame:
    return tables.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum("column_count").cast("long").alias("total_columns"))
