"""Column expressions over table and column names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Affixes dropped from a table name before matching.
TABLE_PREFIX = "olist_"
TABLE_SUFFIX = "_dataset"


def entity_core(table_name: Column, prefix: str = TABLE_PREFIX, suffix: str = TABLE_SUFFIX) -> Column:
    """orders for olist_orders_dataset."""
    n = F.lower(table_name)
    if prefix:
        n = F.when(n.startswith(prefix), F.substring(n, F.lit(len(prefix) + 1), F.length(n))).otherwise(n)
    if suffix:
        n = F.when(n.endswith(suffix), F.substring(n, F.lit(1), F.length(n) - len(suffix))).otherwise(n)
    return F.btrim(n, F.lit("_"))


def name_key(column_name: Column) -> Column:
    """The form two column names are compared in."""
    return F.btrim(F.lower(column_name))


def id_stem(key: Column) -> Column:
    """customer for customer_id, given a name key; NULL for other names."""
    stem = F.btrim(F.substring(key, F.lit(1), F.length(key) - 3), F.lit("_"))
    return F.when(key.endswith("_id") & (stem != ""), stem)


def stem_is_core(stem: Column, core: Column) -> Column:
    """Singular or plural form of the same word."""
    return (core == stem) | (core == F.concat(stem, F.lit("s"))) | (F.rtrim(core, F.lit("s")) == stem)


def stem_near_core(stem: Column, core: Column) -> Column:
    """The stem is one part of the table word, or its beginning."""
    return F.array_contains(F.split(core, "_"), stem) | core.startswith(stem)


def stem_overlaps_core(stem: Column, core: Column) -> Column:
    return (F.length(stem) >= 3) & (core.contains(stem) | stem.contains(core))


def owns_id(key: Column, core: Column) -> Column:
    """The table's own identifier, as in orders.order_id."""
    stem = id_stem(key)
    own = core.isin(stem, F.concat(stem, F.lit("s"))) & (key == F.concat(stem, F.lit("_id")))
    return F.coalesce(own, F.lit(False))


def title(text: Column) -> Column:
    """Each run of letters starts with a capital, the rest is lower case; other characters stay."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r)))))
    return F.array_join(cap, "")


def diagram_name(name: Column) -> Column:
    """Bare when it is an identifier, else quoted."""
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), name).otherwise(
        F.concat(F.lit('"'), escaped, F.lit('"')))


def diagram_label(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def source_key(path: Column) -> Column:
    """One key for the spellings of a source path: decoded, trimmed, case-folded, no doubled or closing slash."""
    p = F.lower(F.btrim(F.coalesce(F.try_url_decode(F.btrim(path)), path)))
    uri = p.rlike("^[a-z]+://")
    flat = F.rtrim(F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"/(\./|/)*", "/"), F.lit("/"))
    return F.when(uri, p).otherwise(F.when(flat == "", p).otherwise(flat))
