"""Profiles that can be added up: a state per table and column that holds counts, ranges, sums and a sketch of the distinct values.

States of parts of a table merge into the state of the whole, so they are kept (ProfileStore) and a grown table costs a scan of its new files. There is one
scan and no shuffle of cells; a state has a few kilobytes. Distinct counts are estimates: HyperLogLog with 2**precision registers, standard
error about 1.04 / sqrt(2**precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelore.functions import cells
from tablelore.operators import profiling
from tablelore.operators.catalog import table_names, union_all

PRECISION = 12
STATE = """table_name string, ordinal int, column_name string, data_type string, total_rows long, filled long, min_num double, max_num double, total double,
    min_value string, max_value string, sketch binary"""


def error_bound(precision: int = PRECISION, deviations: float = 4) -> float:
    """How far an estimate may be off, as a share of the true number, at so many standard errors."""
    return deviations * 1.04 / (1 << precision) ** 0.5


def _state_of(table: str, df: DataFrame, fields: list[tuple[int, T.StructField]], precision: int) -> DataFrame:
    folds, picks = ["count(1) AS n"], []
    for i, f in fields:
        c, number = profiling.present_sql(f), cells.is_numeric(f.dataType)
        shown = c if number or isinstance(f.dataType, profiling.ORDERED) else profiling.text_sql(f)
        # one value has one hash, whatever its type: 0.0 and -0.0 are one, nested cells go by their text, binary ones by their bytes
        same = f"({c}) + 0.0D" if cells.is_float(f.dataType) else c if isinstance(f.dataType, T.BinaryType) else shown
        folds += [f"count({c}) AS kept_{i}", f"min({shown}) AS low_{i}", f"max({shown}) AS high_{i}",
                  f"hll_sketch_agg(CASE WHEN ({c}) IS NOT NULL THEN xxhash64({same}) END, {precision}) AS sketch_{i}"]
        if number:
            folds.append(f"sum(CAST({c} AS DOUBLE)) AS total_{i}")
        low, high, total = (f"low_{i}", f"high_{i}", f"total_{i}") if number else ("NULL", "NULL", "NULL")
        picks.append(f"struct({profiling.literal_sql(table)} AS table_name, {i} AS ordinal, {profiling.literal_sql(f.name)} AS column_name, "
                     f"{profiling.literal_sql(f.dataType.simpleString())} AS data_type, n AS total_rows, kept_{i} AS filled, CAST({low} AS DOUBLE) AS min_num, "
                     f"CAST({high} AS DOUBLE) AS max_num, CAST({total} AS DOUBLE) AS total, CAST(low_{i} AS STRING) AS min_value, "
                     f"CAST(high_{i} AS STRING) AS max_value, sketch_{i} AS sketch)")
    return df.selectExpr(*folds).selectExpr(f"inline(array({', '.join(picks)}))")


def column_states(tables: dict[str, DataFrame], precision: int = PRECISION) -> DataFrame:
    """One row per table and column (STATE), from one scan each."""
    return union_all([_state_of(t, tables[t], list(enumerate(tables[t].schema.fields, 1)), precision) for t in table_names(tables)])


def merge_states(states: DataFrame, part: str) -> DataFrame:
    """The states of whole tables; `part` names the column that tells parts apart. Rows of a part that lacks a column count as missing there."""
    rows = states.groupBy("table_name", part).agg(F.max("total_rows").alias("n")).groupBy("table_name").agg(F.sum("n").alias("total_rows"))
    newest = F.max_by(F.struct("ordinal", "data_type"), F.col(part))
    merged = states.groupBy("table_name", "column_name").agg(
        newest.alias("newest"), F.sum("filled").alias("filled"), F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"), F.sum("total").alias("total"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.hll_union_agg("sketch").alias("sketch"))
    merged = merged.join(rows, "table_name").select("table_name", "newest.ordinal", "column_name", "newest.data_type", "total_rows", "filled", "min_num", "max_num",
                                                    "total", "min_value", "max_value", "sketch")
    # numbers are told by their values, their texts do not sort like them
    shown = [F.when(F.col(n).isNull(), F.col(t)).alias(t) for n, t in (("min_num", "min_value"), ("max_num", "max_value"))]
    return merged.select(*[c for c in merged.columns if c not in ("min_value", "max_value", "sketch")], *shown, "sketch")


def profiles_of(states: DataFrame) -> DataFrame:
    """Missing cells, ranges, means and estimated distinct counts of states; an estimate gives no key flag."""
    rows, filled = F.col("total_rows"), F.col("filled")
    return states.select(
        "table_name", "ordinal", "column_name", "data_type", "total_rows", (rows - filled).alias("null_count"),
        F.when(rows == 0, 0.0).otherwise((rows - filled) / rows).alias("null_rate"), "min_num", "max_num",
        F.when(filled > 0, F.col("total") / filled).alias("mean_value"), "min_value", "max_value", F.hll_sketch_estimate("sketch").alias("unique_estimate"))


class ProfileStore:
    """States of Parquet tables on disk, and which files they come from.

    <folder>/states  STATE and batch     <folder>/files  table_name, path, length, modified, first (of its generation), batch

    A batch is written states first, files last, and counts once its files are there. Where a file that was profiled is gone or has changed, the
    table starts anew: its next batch is marked as the first of a generation. One writer at a time.
    """

    FILES = "table_name string, path string, length long, modified timestamp, first long, batch long"

    def __init__(self, spark: SparkSession, folder: str, precision: int = PRECISION):
        self.spark, self.folder, self.precision = spark, folder.rstrip("/"), precision

    def _stored(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _files(self) -> DataFrame:
        """The files behind the tables as they are now."""
        every = self._stored("files", self.FILES)
        newest = every.groupBy("table_name").agg(F.max("first").alias("first"))
        return every.join(newest, ["table_name", "first"]).select(*every.columns)

    def _listed(self, table: str, path: str) -> DataFrame:
        """The Parquet files of a table; only their names are read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        return found.select(F.lit(table).alias("table_name"), "path", "length", F.col("modificationTime").alias("modified"))

    def update(self, tables: dict[str, str]) -> dict[str, int]:
        """Profiles what is new under the tables' paths; how many files were read of each."""
        known, identity = self._files(), ["table_name", "path", "length", "modified"]
        batch = (self._stored("files", self.FILES).agg(F.max("batch")).first()[0] or 0) + 1
        now = union_all([self._listed(t, tables[t]) for t in table_names(tables)])
        lost = {r.table_name for r in known.join(now, identity, "left_anti").select("table_name").distinct().collect()} & tables.keys()
        old = known.filter(~F.col("table_name").isin(*lost)) if lost else known
        fresh = now.join(old, identity, "left_anti").collect()  # a row a new file, as Spark's own file index has them
        paths: dict[str, list[str]] = {}
        for r in fresh:
            paths.setdefault(r.table_name, []).append(r.path)
        if not fresh:
            return dict.fromkeys(tables, 0)
        states = column_states({t: self.spark.read.parquet(*p) for t, p in paths.items()}, self.precision)
        states.withColumn("batch", F.lit(batch).cast("long")).coalesce(1).write.mode("append").parquet(f"{self.folder}/states")
        firsts = {r.table_name: r.first for r in old.select("table_name", "first").distinct().collect()}
        rows = [(r.table_name, r.path, r.length, r.modified, firsts.get(r.table_name, batch), batch) for r in fresh]
        self.spark.createDataFrame(rows, self.FILES).coalesce(1).write.mode("append").parquet(f"{self.folder}/files")
        return {t: len(paths.get(t, [])) for t in tables}

    def profiles(self) -> DataFrame:
        """profiles_of the tables as last updated."""
        live = self._files().select("table_name", F.col("batch")).distinct()
        states = self._stored("states", f"{STATE}, batch long").join(live, ["table_name", "batch"], "left_semi")
        return profiles_of(merge_states(states, "batch"))
