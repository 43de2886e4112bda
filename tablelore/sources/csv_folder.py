"""A folder of CSV files as typed tables, one per file."""

from __future__ import annotations

import logging
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tablelore.functions import cells
from tablelore.operators import cleaning
from tablelore.operators.catalog import union_all
from tablelore.session import shared_folder

log = logging.getLogger(__name__)

DELIMITERS = (",", ";", "\t")
STEADY = 0.9  # where fewer lines agree on the number of delimiters and others occur too, the file is listed as doubtful
OVERFLOW = "__beyond_header"
AT_ONCE = 4  # files loaded at the same time; each is a few Spark jobs


@dataclass
class CsvFolder:
    """Tables of a folder, the files skipped or doubtful, and how many values of a date column did not fit its layout."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)
    lost: list[tuple[str, str, int]] = field(default_factory=list)

    def load_errors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.errors, "file string, error string")

    def lost_values(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.lost, "file string, column_name string, lost long")


def table_name(file_name):
    """File stem, as a column expression."""
    return F.regexp_extract(F.try_url_decode(file_name), r"^(.*)\.csv$", 1)


def _entries(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """(name, path, whether it is a folder) of what is called *.csv directly under a folder, by path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"not a folder: {folder}")
    return sorted((s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(path) if s.getPath().getName().endswith(".csv"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """file_path (of a file, or of a folder whose files are one table), file_name, value."""
    entries = _entries(spark, folder)
    reader, parts = spark.read.option("pathGlobFilter", "*.csv"), []
    if files := [path for _, path, is_folder in entries if not is_folder]:
        parts.append(reader.text(files).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), "value"))
    for name, path, is_folder in entries:
        if is_folder:
            parts.append(reader.text(path).select(F.lit(quote(path, safe="/:")).alias("file_path"), F.lit(quote(name)).alias("file_name"), "value"))
    return union_all(parts)


def file_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Delimiter of each file, whether a quoted line break makes it unsplittable, and whether the delimiter is doubtful (with the share of lines that agree on it): one pass over the text.

    Lines vote with their number of delimiters outside quotes, those without any for none, which counts as a comma unless quotes hold line breaks; the most
    votes win. Lines alike in their numbers are added up first, and only then spelled out as votes.
    """
    lines = _lines(spark, folder).filter(~F.col("value").rlike(r"^\s*$"))
    quoted = F.contains("value", F.lit('"'))
    bare = F.when(quoted, F.regexp_replace("value", '"[^"]*"', "")).otherwise(F.col("value"))
    open_quote = quoted & ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    number = {d: F.col(f"n_{i}") for i, d in enumerate(DELIMITERS)}
    alike = (lines.select("file_path", "file_name", open_quote.alias("open_quote"), bare.alias("bare"))
             .select("file_path", "file_name", "open_quote",
                     *[(F.length("bare") - F.length(F.replace("bare", F.lit(d), F.lit("")))).alias(f"n_{i}") for i, d in enumerate(DELIMITERS)])
             .groupBy("file_path", "file_name", "open_quote", *number.values()).agg(F.count(F.lit(1)).alias("lines")))
    none = (sum(number.values()) == 0).cast("int")  # a line with no delimiter votes once for a file of one column
    counts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d).alias("delimiter"), n.alias("n"))
                       for i, (d, n) in enumerate([*number.items(), ("", none)])])
    per_count = (alike.select("file_path", "file_name", "open_quote", "lines", F.explode(counts).alias("c"))
                 .groupBy("file_path", "file_name", "c.place", "c.delimiter", "c.n")
                 .agg(F.sum("lines").alias("lines"), F.max("open_quote").alias("open_quote")))
    per_delimiter = per_count.groupBy("file_path", "file_name", "place", "delimiter").agg(
        F.max(F.when(F.col("n") > 0, F.col("lines"))).alias("agreeing"), F.sum("lines").alias("lines"),
        F.max("open_quote").alias("multi_line"))
    share = F.coalesce(F.col("agreeing") / F.col("lines"), F.lit(0.0))
    best = Window.partitionBy("file_path", "file_name").orderBy(F.desc("share"), "place")
    votes = (per_delimiter.withColumn("share", share).filter("delimiter <> '' OR NOT multi_line")
             .withColumn("rank", F.row_number().over(best)).withColumn("used", F.when((F.col("delimiter") == "") | (F.col("share") == 0), ",").otherwise(F.col("delimiter"))))
    first = F.max_by(F.struct("used", "share", "multi_line"), -F.col("rank"))
    found = votes.groupBy("file_path", "file_name").agg(first.alias("first"), F.collect_list(F.when((F.col("share") > 0) & (F.col("delimiter") != ""), F.col("delimiter"))).alias("seen"))
    rival = F.exists("seen", lambda d: d != F.col("first.used"))
    return found.select("file_path", table_name(F.col("file_name")).alias("table_name"), F.col("first.used").alias("delimiter"), F.col("first.multi_line").alias("multi_line"),
                        F.col("first.share").alias("share"), ((F.col("first.share") < STEADY) & rival).alias("doubtful")).orderBy("file_path")


def _header(raw: list[str | None]) -> list[str]:
    """Names of the header row; empty ones are numbered, repeated ones get a suffix."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(raw):
        name = name or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_raw(spark: SparkSession, path: str, delimiter: str, multi_line: bool) -> DataFrame:
    """All columns as text, plus a column that catches a field beyond the header."""
    reader = spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=multi_line, nullValue="\u0001",
                                emptyValue="", maxCharsPerColumn=-1, encoding="UTF-8")
    first = reader.csv(path, header=False).first()
    if first is None:
        raise ValueError("no header row")
    names = cleaning.normalise_header(
        spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in _header(list(first))]))).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
    return reader.schema(schema).csv(path, header=True)


def load_table(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = True, store: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """One file, cleaned and typed, and the values lost per date column. A row with more fields than the header fails the file.

    Types, the order of day and month, and over-long rows are found in one pass. It runs before repeated rows are dropped, which changes none of
    them. The typed rows are written to `store` as Parquet once, so the text is not parsed and its rows are not compared again.
    """
    raw = read_raw(spark, path, delimiter, multi_line)
    columns = [c for c in raw.columns if c != OVERFLOW]
    beyond = F.when(cells.ref(OVERFLOW).isNotNull(), "x").alias(OVERFLOW)
    texts = cleaning.clean_texts(raw.select(*[cells.null_tokens_to_null(cells.ref(c)).alias(c) for c in columns], beyond))
    flags = {r.column_name: r for r in cleaning.type_flags(texts, dates=True).collect()}  # one row per column
    if flags[OVERFLOW].filled:
        raise ValueError(f"{flags[OVERFLOW].filled} row(s) have more fields than the header")
    times = {c: flags[c].day_first for c in columns if flags[c].day_first is not None}
    rows = cleaning.parse_times(texts.drop(OVERFLOW), times).dropDuplicates()
    typed = cleaning.apply_types(rows, {c: flags[c].inferred_type for c in columns})
    lost = {c: flags[c].lost for c in times if flags[c].lost}
    if store is None:
        return typed, lost
    typed.write.parquet(store)
    return spark.read.schema(typed.schema).parquet(store), lost


def load_csv_folder(spark: SparkSession, folder: str, store: str | None = None) -> CsvFolder:
    """Every CSV file directly under a folder, written once as typed Parquet under `store` (a new shared folder if none is given).

    A folder called *.csv is one table too, of all its files, each with a header, as Spark writes them. A bad file is skipped and listed under
    errors; one whose delimiter is doubtful is loaded and listed there too.
    """
    files = [path for _, path, _ in _entries(spark, folder)]
    if not files:
        raise ValueError(f"no .csv files in {folder}")
    layout = {unquote(r.file_path.split("/")[-1]): r for r in file_layout(spark, folder).collect()}  # one row per file; Spark writes its paths URL-encoded
    out = CsvFolder()
    store = (store or f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}").rstrip("/")

    def place(i: int, stem: str) -> str:
        return f"{store}/{i}-{re.sub(r'[^A-Za-z0-9_-]', '_', stem[:-len('.csv')])}"

    def load(i: int, f: str) -> tuple[DataFrame, dict[str, int]] | Exception:
        stem = f.split("/")[-1]
        try:
            if stem not in layout:
                raise ValueError("its layout was not found")
            return load_table(spark, f, layout[stem].delimiter, layout[stem].multi_line, place(i, stem))
        except Exception as e:  # noqa: BLE001  a bad file must not stop the others
            return e

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for f, got in zip(files, pool.map(load, range(len(files)), files), strict=True):
            if isinstance(got, Exception):
                log.warning("skipped %s: %s", f, got)
                out.errors.append((f, str(got)))
                continue
            stem = f.split("/")[-1]
            out.tables[stem[:-len(".csv")]], lost = got
            out.lost += [(f, c, n) for c, n in sorted(lost.items())]
            if (found := layout[stem]).doubtful:
                log.warning("doubtful delimiter in %s", f)
                out.errors.append((f, f"loaded, but its delimiter {found.delimiter!r} is doubtful: {found.share:.0%} of the lines agree, and others occur"))
    if not out.tables:
        raise ValueError(f"all CSV files failed to load in {folder}")
    return out
