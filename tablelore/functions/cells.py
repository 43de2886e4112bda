"""Column expressions for single cells: missing values, display text, string cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The texts a CSV reader treats as missing (the pandas default list).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CLOCK = "[[' ']['T']HH:mm[:ss[.SSSSSS]][' '][XXX][XX]]"

# Layouts of a date or time, in the order they are tried: which of day and month comes first where both are numbers, what a
# text looks like, the pattern it is read by.
LAYOUTS = (
    ("", r"^[0-9]{4}-[0-9]{1,2}-[0-9]", "yyyy-M-d" + CLOCK),
    ("", r"^[0-9]{4}/[0-9]{1,2}/[0-9]", "yyyy/M/d" + CLOCK),
    ("", r"^[0-9]{8}$", "yyyyMMdd"),
    ("month", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy" + CLOCK),
    ("day", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy" + CLOCK),
    ("month", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "M-d-yyyy" + CLOCK),
    ("day", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-yyyy" + CLOCK),
    ("day", r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}", "d.M.yyyy" + CLOCK),
    ("", r"^[0-9]{1,2}[ -][A-Za-z]{3}[ -][0-9]{4}", "d[ ][-]MMM[ ][-]yyyy" + CLOCK),
    ("", r"^[0-9]{1,2} [A-Za-z]{3,} [0-9]{4}", "d MMMM yyyy" + CLOCK),
    ("", r"^[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}", "MMM d[,] yyyy" + CLOCK),
    ("", r"^[A-Za-z]{3,} [0-9]{1,2},? [0-9]{4}", "MMMM d[,] yyyy" + CLOCK),
)

NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"


def ref(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric by class, so an interval type is not mistaken for an integer."""
    return isinstance(dtype, T.NumericType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def missing(field: T.StructField) -> Column:
    """NULL and NaN alike."""
    c = ref(field.name)
    return c.isNull() | F.isnan(c) if is_float(field.dataType) else c.isNull()


def present(field: T.StructField) -> Column:
    """The cell with NaN turned into NULL."""
    c = ref(field.name)
    return F.when(~F.isnan(c), c) if is_float(field.dataType) else c


def cell_text(field: T.StructField) -> Column:
    """Text form of a cell; NULL stays NULL."""
    c = present(field)
    if isinstance(field.dataType, T.StringType):
        return c
    if isinstance(field.dataType, T.BinaryType):
        return F.concat(F.lit("<bytes:"), F.octet_length(c).cast("string"), F.lit(">"))
    if isinstance(field.dataType, T.VariantType) or is_nested(field.dataType):
        return F.to_json(c) if not isinstance(field.dataType, T.VariantType) else c.cast("string")
    return c.cast("string")


def display(field: T.StructField) -> Column:
    """Text shown to a reader; a missing cell shows as empty."""
    return F.coalesce(cell_text(field), F.lit(""))


def strip(c: Column) -> Column:
    """Drop outer white space of any script, not only blanks. A text that begins and ends with a visible ASCII character needs no pattern."""
    bare = c.between("!", "~\U0010FFFF") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(bare, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def _read(c: Column, shape: str, pattern: str) -> Column:
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(pattern)))


def layout_mask(c: Column) -> Column:
    """The layouts that fit a text, one bit each; 0 when none does."""
    mask = F.lit(0)
    for i, (_, shape, pattern) in enumerate(LAYOUTS):
        mask = mask.bitwiseOR(F.when(_read(c, shape, pattern).isNotNull(), 1 << i).otherwise(0))
    return mask


def bits_of(order: str) -> int:
    """The layouts of one order of day and month, as a mask."""
    return sum(1 << i for i, (o, _, _) in enumerate(LAYOUTS) if o == order)


def parse_timestamp(c: Column, day_first: bool = False) -> Column:
    """The time a text names; NULL when it has no layout. Where day and month are numbers, only one order is read."""
    other = "month" if day_first else "day"
    return F.coalesce(*[_read(c, shape, pattern) for order, shape, pattern in LAYOUTS if order != other]).cast("timestamp_ntz")


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_TEXT) | c.rlike(INFINITY_TEXT)


def number(c: Column) -> Column:
    """Text to double under the guard above: a bare cast also takes texts such as 1d."""
    return F.when(is_number_text(c), c.try_cast("double"))


def quality_label(score: Column) -> Column:
    return F.when(score > 0.95, "good").when(score > 0.80, "warn").otherwise("bad")


def percent(rate: Column) -> Column:
    return F.round(rate * 100, 2)
