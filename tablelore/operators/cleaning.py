"""Cleaning and typing of raw text tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelore.functions import cells

LONG_LIMIT = 9.2e18  # floats beyond this stay floats
EXACT_LIMIT = float(1 << 53)  # whole numbers below this are exact as doubles
WHOLE_TEXT = r"^[+-]?[0-9]+([.]0*)?$"  # a whole number written out
WIDE = "decimal(38,0)"


def normal_name(name: str) -> str:
    """Trimmed, lower case, white space runs turned into one underscore."""
    return re.sub(r"\s+", "_", name.strip().lower())


def normalise_header(df: DataFrame) -> DataFrame:
    names = [normal_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after normalising: {', '.join(twice)}")
    return df.toDF(*names)


def is_time_name(name: str) -> bool:
    return "date" in name.lower() or "time" in name.lower()


def is_time_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType) and is_time_name(field.name)


def _cleaned(field: T.StructField, parse_numeric_dates: bool) -> Column:
    c = cells.ref(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.nullif(cells.strip(c), F.lit(""))  # what is blank is empty once stripped
    if parse_numeric_dates and is_time_name(field.name) and cells.is_numeric(field.dataType):
        since = F.make_dt_interval(secs=(c.cast("decimal(38,0)") / 1_000_000_000).cast("decimal(18,6)"))  # it counts nanoseconds
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since
    return c


def clean_texts(df: DataFrame, parse_numeric_dates: bool = False) -> DataFrame:
    """Trim texts, turn blanks into NULL; texts that name a time are left as they are."""
    return df.select(*[_cleaned(f, parse_numeric_dates).alias(f.name) for f in df.schema.fields])


def parse_times(df: DataFrame, day_first: dict[str, bool]) -> DataFrame:
    """The named text columns as times, each in its own order of day and month."""
    return df.select(*[cells.parse_timestamp(cells.ref(c), day_first[c]).alias(c) if c in day_first else cells.ref(c) for c in df.columns])


def _date_folds(i: int, c: Column) -> list[Column]:
    """How many values fit which layouts: all there is to know of a column to choose one order for it."""
    mask, month, day = F.col(f"mask_{i}"), cells.bits_of("month"), cells.bits_of("day")

    def fits(bits: int) -> Column:
        return F.count_if(mask.bitwiseAND(bits) != 0)

    every = (1 << len(cells.LAYOUTS)) - 1
    return [F.count(c).alias(f"n_{i}"), fits(month).alias(f"month_{i}"), fits(day).alias(f"day_{i}"), fits(every & ~day).alias(f"as_month_{i}"),
            fits(every & ~month).alias(f"as_day_{i}"), F.bit_or(mask).alias(f"seen_{i}")]


def _day_first(i: int) -> Column:
    """More values read with the day first than with the month first; month first otherwise."""
    return F.col(f"day_{i}") > F.col(f"month_{i}")


def _with_masks(df: DataFrame) -> DataFrame:
    masks = {f"mask_{i}": cells.layout_mask(cells.ref(f.name)) for i, f in enumerate(df.schema.fields) if is_time_text(f)}
    return df.withColumns(masks) if masks else df


def date_layouts(df: DataFrame) -> DataFrame:
    """Per text column named like a date or time, from one pass: filled values, how many fit with the month and with the day first, the one
    order the column is read in, the layouts seen (a bit each), values read, and values lost because they fit no layout of that order."""
    folds, picks = [], []
    for i, f in enumerate(df.schema.fields):
        if is_time_text(f):
            folds += _date_folds(i, cells.ref(f.name))
            read = F.when(_day_first(i), F.col(f"as_day_{i}")).otherwise(F.col(f"as_month_{i}"))
            picks.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f"n_{i}").alias("filled"), F.col(f"month_{i}").alias("month_first_fits"),
                                  F.col(f"day_{i}").alias("day_first_fits"), _day_first(i).alias("day_first"), F.coalesce(f"seen_{i}", F.lit(0)).alias("layouts"),
                                  read.alias("parsed"), (F.col(f"n_{i}") - read).alias("lost")))
    if not picks:
        return df.sparkSession.createDataFrame([], "column_name string, filled long, month_first_fits long, day_first_fits long, day_first boolean, "
                                                   "layouts int, parsed long, lost long")
    return _with_masks(df).agg(*folds).select(F.inline(F.array(*picks)))


def clean_cells(df: DataFrame, parse_numeric_dates: bool = False) -> DataFrame:
    """Trim texts, parse columns named like dates, turn blanks into NULL.

    A text column that names times is read with the day first or with the month first, never both: whichever fits more of its values. That is one
    pass over such columns, and a row each to the driver. Values of the other order are lost; date_layouts counts them.
    """
    texts = clean_texts(df, parse_numeric_dates)
    if not any(is_time_text(f) for f in df.schema.fields):
        return texts
    return parse_times(texts, {r.column_name: r.day_first for r in date_layouts(texts).collect()})


def clean(df: DataFrame, parse_numeric_dates: bool = False) -> DataFrame:
    """Clean every cell, then drop rows that repeat."""
    return clean_cells(df, parse_numeric_dates).dropDuplicates()


def _text_flags(df: DataFrame, texts: list[tuple[int, str, bool]]) -> DataFrame:
    """type_flags of text columns, given as (ordinal, name, whether it is read as a time).

    Cells come one a row, so that one short piece of code folds all of them: folds of many columns side by side are too long to be compiled.
    """
    def cells_of(frame: DataFrame, value) -> DataFrame:
        return frame.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(timed).alias("timed"), value(name).alias("c")) for i, name, timed in texts])))

    none = cells_of(df.sparkSession.range(1), lambda name: F.lit(None).cast("string"))  # a column without a row is listed too
    rows = cells_of(df, cells.ref).unionByName(none)
    timed, c, v, wide, written = (F.col(x) for x in ("timed", "c", "v", "wide", "written"))
    with_times = any(t for _, _, t in texts)
    if with_times:
        rows = rows.withColumn("mask_0", F.when(timed, cells.layout_mask(c)))
    text = F.when(~timed, c)
    rows = rows.select("*", text.alias("u"), cells.number(text).alias("v"))
    digits = F.coalesce(v.isNotNull() & F.col("u").rlike(WHOLE_TEXT), F.lit(False))  # every whole number written out is a number
    rows = rows.withColumn("written", digits).withColumn("wide", F.when(written, F.col("u").try_cast(WIDE)))
    small = (v % 1 == 0) & (F.abs(v) < EXACT_LIMIT)
    # a number written out whole must come back from a double as it was, or the column may not be double
    inexact = written & (F.abs(v) >= EXACT_LIMIT) & ~F.coalesce(v.try_cast(WIDE) == wide, F.lit(False))
    folds = [F.count(v).alias("num"), F.count_if(small | (written & wide.try_cast("bigint").isNotNull())).alias("whole"), F.count_if(small | (written & wide.isNotNull())).alias("wide"),
             F.count_if(inexact).alias("inexact"), F.count_if(F.col("u").rlike(cells.BOOLEAN_TEXT)).alias("bool")]
    found = rows.groupBy("ordinal", "timed").agg(*(_date_folds(0, c) if with_times else [F.count(c).alias("n_0")]), *folds)
    n = F.col("n_0")
    kind = (F.when(timed, "timestamp_ntz").when(n == 0, "string").when(F.col("whole") == n, "bigint").when(F.col("wide") == n, WIDE)
            .when((F.col("num") == n) & (F.col("inexact") == 0), "double").when(F.col("bool") == n, "boolean").otherwise("string"))
    day_first, lost = F.lit(None).cast("boolean"), F.lit(None).cast("long")
    if with_times:
        day_first = F.when(timed, _day_first(0))
        lost = F.when(timed, n - F.when(_day_first(0), F.col("as_day_0")).otherwise(F.col("as_month_0")))
    names = F.array(*[F.lit(name) for _, name, _ in texts])
    place = F.array_position(F.array(*[F.lit(i) for i, _, _ in texts]), F.col("ordinal")).cast("int")
    return found.select("ordinal", F.element_at(names, place).alias("column_name"), kind.alias("inferred_type"), n.alias("filled"), day_first.alias("day_first"), lost.alias("lost"))


def type_flags(df: DataFrame, dates: bool = False) -> DataFrame:
    """What the values of each column allow, and how many there are: one row per column, from one pass over its text columns and one over the others.

    With `dates`, text columns that name times are timestamps, and day_first and lost are as in date_layouts; NULL for all other columns.
    """
    texts = [(i, f.name, dates and is_time_text(f)) for i, f in enumerate(df.schema.fields, 1) if isinstance(f.dataType, T.StringType)]
    folds, picks = [], []
    for i, f in enumerate(df.schema.fields):
        c = cells.ref(f.name)
        if isinstance(f.dataType, T.StringType):
            continue
        if cells.is_float(f.dataType):
            v = cells.present(f)
            folds += [F.count(v).alias(f"n_{i}"), F.count_if((v % 1 == 0) & (F.abs(v) < LONG_LIMIT)).alias(f"whole_{i}")]
            kind = F.when((F.col(f"n_{i}") > 0) & (F.col(f"whole_{i}") == F.col(f"n_{i}")), "bigint").otherwise(
                f.dataType.simpleString())
        else:
            kind = F.lit(f.dataType.simpleString())
            folds.append(F.count(c).alias(f"n_{i}"))
        picks.append(F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"), kind.alias("inferred_type"),
                              F.col(f"n_{i}").alias("filled"), F.lit(None).cast("boolean").alias("day_first"), F.lit(None).cast("long").alias("lost")))
    parts = [_text_flags(df, texts)] if texts else []
    if picks:
        parts.append(df.agg(*folds).select(F.explode(F.array(*picks)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def to_type(field: T.StructField, kind: str) -> Column:
    c = cells.ref(field.name)
    if kind == field.dataType.simpleString():
        return c
    if kind == "bigint":
        return F.coalesce(c.try_cast("bigint"), c.try_cast(WIDE).try_cast("bigint"), cells.number(c).try_cast("bigint")) if isinstance(
            field.dataType, T.StringType) else cells.present(field).try_cast("bigint")
    if kind == WIDE:
        return F.coalesce(c.try_cast(WIDE), cells.number(c).try_cast(WIDE))
    if kind == "double":
        return cells.number(c)
    return c.try_cast(kind)


def apply_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[to_type(f, kinds[f.name]).alias(f.name) for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """The table with each text column as long, decimal(38,0), double, boolean or string.

    Whole numbers too large for a long are decimals; where they do not fit either, or stand among fractions, the text stays: no type merges two values written out whole.

    The schema depends on the data, so one row per column comes to the driver before the casts are planned.
    """
    kinds = {r.column_name: r.inferred_type for r in type_flags(df).collect()}
    return apply_types(df, kinds)
