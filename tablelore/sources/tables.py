"""Where tables come from: a folder of CSV or Parquet files, or a database over JDBC."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelore.operators.catalog import KEYS_SCHEMA
from tablelore.sources.csv_folder import CsvFolder, load_csv_folder


class InputKind(Enum):
    CSV_FOLDER = "csv_folder"
    PARQUET_FOLDER = "parquet_folder"
    SQLITE_FILE = "sqlite_file"
    POSTGRES = "postgres"
    MYSQL = "mysql"


def _listing(spark: SparkSession, path: str) -> list[str] | None:
    """Names directly under a folder, on any file system Spark can reach; None if it is not a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return None
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def detect_input_kind(spark: SparkSession, path: str) -> InputKind:
    """Kind of input by suffix, then by URI scheme, then by what the folder holds."""
    p = path.strip()
    lower = p.lower()
    if lower.endswith((".sqlite", ".db")):
        return InputKind.SQLITE_FILE
    if lower.endswith(".sql"):
        raise ValueError("a .sql dump is not supported")
    if lower.startswith("postgresql://"):
        return InputKind.POSTGRES
    if lower.startswith("mysql://"):
        return InputKind.MYSQL
    try:
        names = _listing(spark, p)
    except Exception as e:  # noqa: BLE001  an unknown file system scheme
        raise ValueError(f"cannot tell the kind of input: {path}") from e
    if names is None:
        raise ValueError(f"cannot tell the kind of input: {path}")
    return InputKind.PARQUET_FOLDER if any(n.endswith(".parquet") for n in names) else InputKind.CSV_FOLDER


def load_parquet_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every Parquet file or folder directly under a folder, one table per stem."""
    names = [n for n in _listing(spark, folder) or [] if n.endswith(".parquet")]
    return {n[:-len(".parquet")]: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}


def jdbc_url(path: str, kind: InputKind) -> str:
    return f"jdbc:sqlite:{path}" if kind is InputKind.SQLITE_FILE else f"jdbc:{path}"


def load_jdbc(spark: SparkSession, url: str, tables: list[str], properties: dict[str, str] | None = None,
              split: dict[str, tuple[str, int, int, int]] | None = None) -> dict[str, DataFrame]:
    """Tables of a relational database.

    ``split`` names, per table, a numeric column with its bounds and the number of parallel reads; a table without it
    is read by one task. Needs the database's JDBC driver on the class path, so it has not been run offline.
    """
    out = {}
    for t in tables:
        extra = {}
        if split and t in split:
            column, low, high, parts = split[t]
            extra = {"column": column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
        out[t] = spark.read.jdbc(url, t, properties=properties or {}, **extra)
    return out


def jdbc_keys(spark: SparkSession, url: str, source: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Declared keys of a Postgres or MySQL database as a keys frame. Not run offline, as above."""
    def query(text: str) -> DataFrame:
        return spark.read.jdbc(url, f"({text}) q", properties=properties or {})

    used = query("SELECT c.table_name, c.constraint_name, c.constraint_type, k.column_name, k.ordinal_position, "
                 "k.position_in_unique_constraint FROM information_schema.table_constraints c "
                 "JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name "
                 "AND k.table_schema = c.table_schema AND k.table_name = c.table_name")
    refs = query("SELECT r.constraint_name, k.table_schema AS referred_schema, k.table_name AS referred_table, "
                 "k.column_name AS referred_column, k.ordinal_position AS position_in_unique_constraint "
                 "FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k "
                 "ON k.constraint_name = r.unique_constraint_name AND k.constraint_schema = r.unique_constraint_schema")

    def in_order(c: str):
        return F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", c))), lambda s: s[c])

    pks = used.filter("constraint_type = 'PRIMARY KEY'").groupBy("table_name").agg(in_order("column_name").alias("primary_keys"))
    fks = (used.filter("constraint_type = 'FOREIGN KEY'").join(refs, ["constraint_name", "position_in_unique_constraint"])
           .groupBy("table_name", "constraint_name", "referred_schema", "referred_table")
           .agg(in_order("column_name").alias("constrained_columns"), in_order("referred_column").alias("referred_columns"))
           .groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct(
               F.col("constraint_name").alias("name"), "constrained_columns", "referred_schema", "referred_table",
               "referred_columns"))).alias("f"))
           .select("table_name", F.transform("f", lambda x: F.struct(
               *[x[n].alias(n) for n in ("name", "constrained_columns", "referred_schema", "referred_table", "referred_columns")],
               F.lit(None).cast("map<string,string>").alias("options"))).alias("fks")))
    return (pks.join(fks, "table_name", "full_outer")
            .select(F.lit(source).alias("source"), *[f.name for f in KEYS_SCHEMA.fields[1:]]))


class Tables(dict):
    """Tables by name, with what was skipped or doubtful on the way (file, error) and the values lost from date columns (file, column, number)."""

    def __init__(self, tables: dict[str, DataFrame], csv: CsvFolder | None = None):
        super().__init__(tables)
        self.errors = csv.errors if csv else []
        self.lost = csv.lost if csv else []

    def load_errors(self, spark: SparkSession) -> DataFrame:
        return CsvFolder(errors=self.errors).load_errors(spark)

    def lost_values(self, spark: SparkSession) -> DataFrame:
        return CsvFolder(lost=self.lost).lost_values(spark)


def load_tables(spark: SparkSession, path: str, jdbc_tables: list[str] | None = None,
                properties: dict[str, str] | None = None, store: str | None = None) -> Tables:
    """Tables of any supported input, and the list of files skipped; the kind is taken from the path itself.

    A folder that holds Parquet and CSV gives both; two tables of one name are an error. CSV tables are written once to `store` (see load_csv_folder).
    """
    kind = detect_input_kind(spark, path)
    if kind is InputKind.CSV_FOLDER:
        csv = load_csv_folder(spark, path, store)
        return Tables(csv.tables, csv)
    if kind is InputKind.PARQUET_FOLDER:
        tables = load_parquet_folder(spark, path)
        if not any(n.endswith(".csv") for n in _listing(spark, path.strip()) or []):
            return Tables(tables)
        csv = load_csv_folder(spark, path, store)
        if both := sorted(tables.keys() & csv.tables.keys()):
            raise ValueError(f"Parquet and CSV tables of the same name: {', '.join(both)}")
        return Tables(tables | csv.tables, csv)
    return Tables(load_jdbc(spark, jdbc_url(path.strip(), kind), jdbc_tables or [], properties))
