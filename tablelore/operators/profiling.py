"""Exact profiles of whole tables.

Two scans per table. The first folds the cheap statistics into one row per task, so nothing but those rows is
shuffled. The second turns each row into narrow (table, column, key) cells and de-duplicates them: every distinct
count of every table, and the duplicate-row count, comes out of that one shuffle. Equal cells collapse before the
shuffle, so a value that fills a third of a column costs no more than any other. Samples come out of it too: the first scan tells about how many
different long texts a column has, and so which few of them must travel with their digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tablelore.functions import cells
from tablelore.operators.catalog import table_names, union_all
from tablelore.session import settle

SAMPLES = 5
CANDIDATES = 96  # long texts that travel for a column's samples
LONG_TEXT = 64  # octets; longer cells travel as digests
PREFIX = 4  # digits of a digest that rows are counted by
SORTED = 10_000  # so many rows are put in order at once
ROW = 0  # ordinal of the pseudo-column that stands for the whole row
NULL_RATE_LIMIT = 0.3


# Wide projections are written as SQL text: one parse per table instead of a call into the JVM per function.

def _name(field: T.StructField) -> str:
    return "`" + field.name.replace("`", "``") + "`"


def literal_sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def present_sql(field: T.StructField) -> str:
    """The cell with NaN turned into NULL."""
    c = _name(field)
    return f"CASE WHEN NOT isnan({c}) THEN {c} END" if cells.is_float(field.dataType) else c


def text_sql(field: T.StructField) -> str:
    c = _name(field)
    if isinstance(field.dataType, T.StringType):
        return c
    if isinstance(field.dataType, T.BinaryType):
        return f"'<bytes:' || octet_length({c}) || '>'"
    if cells.is_nested(field.dataType):
        return f"to_json({c})"
    return f"CAST({present_sql(field)} AS STRING)"


# ---- first scan: counts, ranges, means ---------------------------------------------------------------------------

ORDERED = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)  # typed order equals text order


def is_text(field: T.StructField) -> bool:
    """Cells of any length: these travel as digests where they are long."""
    return isinstance(field.dataType, T.StringType) or cells.is_nested(field.dataType)


def _fold(table: str, df: DataFrame, fields: list[tuple[int, T.StructField]], estimates: bool) -> DataFrame:
    folds, picks = ["count(1) AS n"], []
    for i, f in fields:
        c = present_sql(f)
        number = cells.is_numeric(f.dataType)
        if not number and not isinstance(f.dataType, ORDERED):
            c = text_sql(f)
        folds += [f"count({present_sql(f)}) AS kept_{i}", f"min({c}) AS low_{i}", f"max({c}) AS high_{i}"]
        if number:
            folds.append(f"avg(CAST({c} AS DOUBLE)) AS mean_{i}")
        low, high, mean = (f"low_{i}", f"high_{i}", f"mean_{i}") if number else ("NULL", "NULL", "NULL")
        estimate = ""
        if estimates:
            if is_text(f):
                folds.append(f"approx_count_distinct(CASE WHEN octet_length({c}) > {LONG_TEXT} THEN {c} END) AS long_{i}")
            estimate = f", {f'long_{i}' if is_text(f) else 'CAST(NULL AS BIGINT)'} AS long_estimate"
        picks.append(
            f"struct({i} AS ordinal, {literal_sql(f.name)} AS column_name, {literal_sql(f.dataType.simpleString())} AS data_type,"
            f" n - kept_{i} AS null_count, CAST({low} AS DOUBLE) AS min_num, CAST({high} AS DOUBLE) AS max_num,"
            f" CAST({mean} AS DOUBLE) AS mean_value, CAST(low_{i} AS STRING) AS min_value,"
            f" CAST(high_{i} AS STRING) AS max_value{estimate})")
    return (df.selectExpr(*folds)
            .selectExpr(f"{literal_sql(table)} AS table_name", "n AS total_rows", f"inline(array({', '.join(picks)}))"))


def _scan_one(table: str, df: DataFrame, estimates: bool) -> list[DataFrame]:
    """Columns of fixed width fold in generated code; texts cannot, and would slow the others down. Each column is
    still read once, for a scan reads only the columns it folds."""
    numbered = list(enumerate(df.schema.fields, 1))
    fixed = [x for x in numbered if cells.is_numeric(x[1].dataType) or isinstance(x[1].dataType, ORDERED)]
    texts = [x for x in numbered if x not in fixed]
    return [_fold(table, df, part, estimates) for part in (fixed, texts) if part]


def column_ranges(tables: dict[str, DataFrame], estimates: bool = False) -> DataFrame:
    """Missing cells, minimum, maximum and mean of every column; with `estimates` also about how many different long texts a column holds."""
    out = union_all([part for t in table_names(tables) for part in _scan_one(t, tables[t], estimates)])
    return out.withColumn("null_rate", F.when(F.col("total_rows") == 0, 0.0).otherwise(
        F.col("null_count") / F.col("total_rows")))


# ---- second scan: distinct cells and rows ------------------------------------------------------------------------

# Types whose equal values have equal texts: their cells are compared as they are and turned into text afterwards, once a distinct value.
PLAIN = (T.DateType, T.TimestampNTZType, T.BooleanType, T.DecimalType)


def _key_sql(field: T.StructField) -> tuple[str, str] | None:
    """The kind of a column's cells and the fixed-width key they are compared by; None for texts."""
    kind, c = field.dataType, _name(field)
    if isinstance(kind, T.IntegralType):
        return "bigint", f"CAST({c} AS BIGINT)"
    if isinstance(kind, T.FloatType):  # by its shortest digits, so that samples show them; 0.0 and -0.0 are one value
        return "double", f"CAST(CAST({present_sql(field)} AS STRING) AS DOUBLE) + 0.0D"
    if isinstance(kind, T.DoubleType):
        return "double", present_sql(field)
    return (kind.simpleString(), c) if isinstance(kind, PLAIN) else None


def _text_cell(slot: int, field: T.StructField, limit: str | None) -> str:
    """Where a text's identity goes: short ones as they are, or a digest of anything longer.

    A long text whose md5 is below `limit` travels beside its digest: samples are taken from these.
    """
    c, text = _name(field), text_sql(field)
    long = f"octet_length({text}) > {LONG_TEXT}"
    digest = order = sample = "NULL"
    if isinstance(field.dataType, T.BinaryType):
        digest, order = f"unhex(sha2({c}, 256))", f"md5({c})"
    elif is_text(field):
        digest = f"CASE WHEN {long} THEN unhex(sha2({text}, 256)) END"
        sample = "NULL" if limit is None else f"CASE WHEN {long} AND md5({text}) < '{limit}' THEN {text} END"
        text = f"CASE WHEN NOT ({long}) THEN {text} END"
    return (f"struct({slot} AS slot, CAST({text} AS STRING) AS k_text, CAST({digest} AS BINARY) AS k_digest, CAST({order} AS STRING) AS k_order,"
            f" CAST({sample} AS STRING) AS k_sample)")


def _row_digest(schema: T.StructType) -> str:
    """Identity of a whole row: each cell as length and text, so no two different rows can spell the same."""
    parts = []
    for f in schema.fields:
        if cells.is_float(f.dataType):
            text = f"CAST({present_sql(f)} + 0.0D AS STRING)"  # 0.0 and -0.0 are one value
        elif isinstance(f.dataType, T.BinaryType):
            text = f"hex({_name(f)})"
        else:
            text = text_sql(f)
        if isinstance(f.dataType, T.StringType) or cells.is_nested(f.dataType):
            text = f"octet_length({text}) || ':' || {text}"
        parts.append(f"coalesce({text}, '-')")
    return f"unhex(sha2(concat_ws(',', {', '.join(parts)}), 256))"


CELL = {"k_long": "bigint", "k_double": "double", "k_text": "string", "k_digest": "binary", "k_order": "string", "k_sample": "string"}


def sample_limits(ranges: DataFrame) -> dict[tuple[str, int], str]:
    """Per column of long texts a limit for their md5, from column_ranges with estimates: about CANDIDATES different texts lie below it.

    So many that fewer than SAMPLES of them would be a chance below 1e-15; where a column has not more, all of them. One row a text column comes to
    the driver.
    """
    out = {}
    for r in ranges.filter("long_estimate > 0").select("table_name", "ordinal", "long_estimate").collect():
        share = CANDIDATES / r.long_estimate
        out[r.table_name, r.ordinal] = "g" if share >= 1 else f"{int(share * (1 << 48)):012x}"
    return out


def _distinct(parts: list[tuple[DataFrame, list[str]]], kept: str) -> DataFrame:
    """The different cells of one kind, of all tables: a struct of slot and key for each cell that `kept` lets through."""
    return union_all([df.selectExpr(f"inline(array({', '.join(structs)}))") for df, structs in parts]).filter(kept).distinct()


def distinct_cells(tables: dict[str, DataFrame], rows: bool = True, columns: bool = True,
                   limits: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """Every distinct non-missing cell of every column, and every distinct row digest, of all tables.

    Cells are compared kind by kind: a slot, which stands for table and column, and a key of that kind's type. So a number costs 16 bytes of a task's
    memory and of the shuffle, and no column of one kind carries the empty fields of another.
    """
    slots: list[tuple[str, int]] = []
    kinds: dict[str, list[tuple[DataFrame, list[str]]]] = {}
    for t in table_names(tables):
        own: dict[str, list[str]] = {}
        for i, f in enumerate(tables[t].schema.fields, 1) if columns else ():
            slots.append((t, i))
            key = _key_sql(f)
            cell = f"struct({len(slots)} AS slot, {key[1]} AS k)" if key else _text_cell(len(slots), f, (limits or {}).get((t, i)))
            own.setdefault(key[0] if key else "text", []).append(cell)
        if rows:
            slots.append((t, ROW))
            own["row"] = [f"struct({len(slots)} AS slot, {_row_digest(tables[t].schema)} AS k)"]
        for kind, structs in own.items():
            kinds.setdefault(kind, []).append((tables[t], structs))
    # never null, so that no join on them adds a filter below the shuffle of one of its sides
    names = f"coalesce(element_at(array({', '.join(literal_sql(t) for t, _ in slots)}), slot), '') AS table_name"
    ordinals = f"coalesce(element_at(array({', '.join(str(i) for _, i in slots)}), slot), 0) AS ordinal"
    out = []
    for kind, parts in sorted(kinds.items()):
        found = _distinct(parts, "k_text IS NOT NULL OR k_digest IS NOT NULL" if kind == "text" else "k IS NOT NULL")
        held = {c: c for c in found.columns if c in CELL} or {{"bigint": "k_long", "double": "k_double", "row": "k_digest"}.get(kind, "k_text"): "k"}
        out.append(found.selectExpr("slot", names, ordinals, *[f"CAST({held.get(c, 'NULL')} AS {kind_of}) AS {c}" for c, kind_of in CELL.items()]))
    return union_all(out)


def _slot_counts(cells_frame: DataFrame) -> DataFrame:
    return cells_frame.groupBy("slot", "table_name", "ordinal").agg(F.count(F.lit(1)).alias("unique_count"))


def distinct_counts(cells_frame: DataFrame) -> DataFrame:
    return _slot_counts(cells_frame).drop("slot")


# ---- samples -----------------------------------------------------------------------------------------------------

def sample_values(tables: dict[str, DataFrame], cells_frame: DataFrame | None = None, n: int = SAMPLES) -> DataFrame:
    """Up to n distinct non-missing values per column: those whose text has the smallest md5.

    Of a column with many different cells only about CANDIDATES are ranked, those with an md5 below a limit that follows from their exact number: so
    cells are not sorted. Cells given must have been made with sample_limits, for long texts are only there below these; without cells both scans are
    run here.
    """
    if cells_frame is None:
        cells_frame = distinct_cells(tables, rows=False, limits=sample_limits(column_ranges(tables, estimates=True)))
    value = F.coalesce(F.col("k_text"), F.col("k_long").cast("string"), F.col("k_double").cast("string"), F.col("k_sample"))
    order = F.coalesce("k_order", F.md5(value), F.lit("z"))  # never null, or the join would filter cells below the shuffle; "z" is above every limit
    w = Window.partitionBy("table_name", "ordinal").orderBy("sample_order")
    held, wanted = F.col("unique_count"), CANDIDATES * n / SAMPLES
    share = F.lpad(F.lower(F.hex(F.floor(F.lit(wanted * (1 << 48)) / held))), 12, "0")
    below = _slot_counts(cells_frame).select("slot", F.when(held <= wanted, "g").otherwise(share).alias("below"))
    # No filter goes on the cells here: this way the plan that counts them and the plan that samples them share a shuffle.
    picked = (cells_frame
              .select("slot", "table_name", "ordinal", order.alias("sample_order"), value.alias("value"))
              .join(F.broadcast(below), "slot").filter(F.col("sample_order") < F.col("below"))
              .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))
    lists = picked.groupBy("table_name", "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("sample_order", "value"))).alias("s"))
    return lists.select("table_name", "ordinal", F.col("s.value").alias("sample_values"))


def counts_and_samples(cells_frame: DataFrame) -> DataFrame:
    """Distinct counts and samples of every column in one plan, so that the cells are made and shuffled once."""
    return distinct_counts(cells_frame).join(sample_values({}, cells_frame), ["table_name", "ordinal"], "left")


# ---- profiles ----------------------------------------------------------------------------------------------------

def column_profiles(tables: dict[str, DataFrame], samples: bool = True, ranges: DataFrame | None = None,
                    cells_frame: DataFrame | None = None, counts: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """The full profile of every column of every table; counts and lists of samples that are there already are taken. With samples the first scan is run at once, for the second depends on it."""
    if ranges is None:
        ranges = settle(column_ranges(tables, estimates=True)) if samples else column_ranges(tables)
    if cells_frame is None:
        cells_frame = distinct_cells(tables, rows=False, limits=sample_limits(ranges) if samples else None)
    counts = distinct_counts(cells_frame) if counts is None else counts
    on = ["table_name", "ordinal"]
    out = ranges.join(counts, on, "left")
    if samples:
        out = out.join(sample_values(tables, cells_frame) if lists is None else lists, on, "left")
        sample = F.coalesce("sample_values", F.array().cast("array<string>"))
    unique = F.coalesce("unique_count", F.lit(0)).cast("long")
    out = out.select(
        *on, "column_name", "data_type", "total_rows", "null_count", "null_rate", unique.alias("unique_count"),
        F.when(F.col("total_rows") == 0, 0.0).otherwise(unique / F.col("total_rows")).alias("uniqueness_rate"),
        "min_num", "max_num", "mean_value", "min_value", "max_value",
        *([sample.alias("sample_values")] if samples else []),
        (unique == 1).alias("is_constant"),
        ((F.col("total_rows") > 0) & (unique == F.col("total_rows"))).alias("is_unique_key"))
    return out


def table_sizes(ranges: DataFrame) -> DataFrame:
    """Rows, columns and completeness per table, from the first scan."""
    return ranges.groupBy("table_name").agg(
        F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.when(F.max("total_rows") == 0, 1.0).otherwise(F.avg(1 - F.col("null_rate"))).alias("completeness_score"),
        F.bool_or(F.col("null_rate") > NULL_RATE_LIMIT).alias("has_sparse_column"))


TABLE_PROFILE_SCHEMA = """table_name string, total_rows long, total_columns long, completeness_score double,
    duplicate_row_count long, has_data_quality_issues boolean"""


def table_profiles(tables: dict[str, DataFrame], ranges: DataFrame | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """Rows, completeness, duplicate rows and the quality flag of every table; no tables give no rows."""
    if not tables:
        return SparkSession.active().createDataFrame([], TABLE_PROFILE_SCHEMA)
    ranges = column_ranges(tables) if ranges is None else ranges
    counts = distinct_counts(distinct_cells(tables, columns=False)) if counts is None else counts
    distinct_rows = counts.filter(F.col("ordinal") == ROW).select("table_name", F.col("unique_count").alias("distinct_rows"))
    duplicates = F.col("total_rows") - F.coalesce("distinct_rows", F.lit(0))
    return (table_sizes(ranges).join(distinct_rows, "table_name", "left")
            .select("table_name", "total_rows", "total_columns", "completeness_score",
                    duplicates.cast("long").alias("duplicate_row_count"),
                    (F.col("has_sparse_column") | (duplicates > 0)).alias("has_data_quality_issues")))


def database_profile(profiles: DataFrame) -> DataFrame:
    """Totals over all tables; every table weighs the same."""
    return profiles.agg(F.count(F.lit(1)).alias("total_tables"),
                        F.coalesce(F.avg("completeness_score"), F.lit(1.0)).alias("overall_completeness"))


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """A repeatable sample of n rows: those whose JSON text has the smallest md5.

    Digests are counted by their first digits, a bounded table; all rows below the digits where the count reaches n are in, without being sorted. Only
    the rows that share these digits are looked at again, by their next digits, until few are left or all of them are equal.
    """
    if n <= 0:
        return df.limit(0)
    text = F.to_json(F.struct(*[cells.ref(c) for c in df.columns]), {"ignoreNullFields": "false"})
    key = "__order"
    keyed, prefix, taken = df.withColumn(key, F.md5(text)), "", []
    while True:
        digits = len(prefix) + PREFIX
        rest = keyed.filter(F.col(key).startswith(prefix)) if prefix else keyed
        sizes = rest.groupBy(F.left(key, F.lit(digits)).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        last, below = None, 0
        for r in sorted(sizes.collect()):  # 16 ** PREFIX rows at most
            if below + r.n > n:
                last = r
                break
            below += r.n
        if last is None:  # all of them
            return _all_rows([*taken, rest], key)
        taken.append(rest.filter(F.col(key) < last.p))
        n -= below
        if n == 0:
            return _all_rows(taken, key)
        prefix = last.p
        if last.low == last.high:  # equal rows: any n of them
            return _all_rows([*taken, keyed.filter(F.col(key) == last.low).limit(n)], key)
        if last.n <= SORTED or digits + PREFIX > 32:
            return _all_rows([*taken, keyed.filter(F.col(key).startswith(prefix)).orderBy(key).limit(n)], key)


def _all_rows(parts: list[DataFrame], key: str) -> DataFrame:
    return union_all(parts).drop(key)


def top_null_columns(profiles: DataFrame, n: int = 3) -> DataFrame:
    """The n columns of each table of each source with most missing cells; ties in schema order."""
    w = Window.partitionBy("source", "table_name").orderBy(F.desc("null_rate"), "ordinal")
    return (profiles.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("source", "table_name", "rank", "column_name", "null_rate"))
