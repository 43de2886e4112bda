import datetime as dt
import hashlib
import math
import random

from pyspark.sql import functions as F, types as T

from tablelore.operators import catalog, profiling as P
from tablelore.plans import views

NAN = float("nan")


def by_column(frame):
    return {(r.table_name, r.column_name): r for r in frame.collect()}


def test_missing_values_and_ranges(spark):
    df = spark.createDataFrame(
        [(1, NAN, "b", True, None, bytearray(b"xyz")), (2, 2.0, None, False, None, bytearray(b"xyz")),
         (2, 4.0, "a", None, None, None), (2, None, "a", True, None, bytearray(b""))],
        "i int, d double, s string, b boolean, n string, x binary")
    p = by_column(P.column_profiles({"t": df}))
    assert [(p["t", c].null_count, p["t", c].unique_count) for c in "idsbnx"] == [(0, 2), (2, 2), (1, 2), (1, 2), (4, 0), (1, 2)]
    d = p["t", "d"]
    assert (d.min_num, d.max_num, d.mean_value) == (2.0, 4.0, 3.0) and d.null_rate == 0.5 and d.uniqueness_rate == 0.5
    assert (p["t", "s"].min_value, p["t", "s"].max_value) == ("a", "b")
    assert p["t", "n"].min_value is None and not p["t", "n"].is_constant and p["t", "n"].sample_values == []
    assert (p["t", "b"].min_value, p["t", "b"].max_value) == ("false", "true")
    assert sorted(p["t", "x"].sample_values) == ["<bytes:0>", "<bytes:3>"]
    assert not p["t", "i"].is_unique_key


def test_constant_and_key(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "k"), (3, "x", "k")], "id long, c string, k string")
    p = by_column(P.column_profiles({"t": df}, samples=False))
    assert p["t", "id"].is_unique_key and p["t", "c"].is_constant and p["t", "k"].is_constant and not p["t", "k"].is_unique_key


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    p = by_column(P.column_profiles({"t": df}))
    assert p["t", "a"].null_rate == 0.0 and p["t", "a"].uniqueness_rate == 0.0 and not p["t", "b"].is_unique_key
    t = P.table_profiles({"t": df}).first()
    assert (t.total_rows, t.completeness_score, t.duplicate_row_count, t.has_data_quality_issues) == (0, 1.0, 0, False)


def test_duplicate_rows_treat_missing_alike(spark):
    df = spark.createDataFrame([(None, NAN), (None, None), (None, NAN), ("", 0.0), ("", -0.0), ("1:-", None), ("1:-", None)],
                               "s string, d double")
    t = P.table_profiles({"t": df}).first()
    assert t.duplicate_row_count == 4 and t.has_data_quality_issues


def test_row_digest_keeps_neighbouring_cells_apart(spark):
    df = spark.createDataFrame([("a,1:b", "c"), ("a", "1:b,1:c"), ("a", None), (None, "a"), ("-", None)], "x string, y string")
    assert P.table_profiles({"t": df}).first().duplicate_row_count == 0


def test_quality_flag_is_strict(spark):
    df = spark.createDataFrame([(i, None if i < 3 else i) for i in range(10)], "a int, b int")
    assert not P.table_profiles({"t": df}).first().has_data_quality_issues  # exactly 0.3
    df = spark.createDataFrame([(i, None if i < 4 else i) for i in range(10)], "a int, b int")
    assert P.table_profiles({"t": df}).first().has_data_quality_issues


def test_nested_dates_and_decimals(spark):
    schema = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
                           T.StructField("d", T.DateType()), T.StructField("t", T.TimestampNTZType()),
                           T.StructField("c", T.DecimalType(10, 2)), T.StructField("f", T.FloatType())])
    from decimal import Decimal
    row = ([1, 2], {"k": 1}, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3), Decimal("1.50"), 0.5)
    other = ([2, 1], {"k": 1}, dt.date(2023, 1, 2), dt.datetime(2024, 1, 2, 4), Decimal("2.50"), float("nan"))
    df = spark.createDataFrame([row, row, other], schema)
    p = by_column(P.column_profiles({"t": df}))
    assert [p["t", c].unique_count for c in "amdtcf"] == [2, 1, 2, 2, 2, 1]
    assert p["t", "c"].mean_value == (1.5 + 1.5 + 2.5) / 3 and p["t", "d"].min_value == "2023-01-02" and p["t", "f"].null_count == 1
    assert P.table_profiles({"t": df}).first().duplicate_row_count == 1


def test_samples_by_brute_force_with_hot_and_long_values(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["long " * 30 + str(i) for i in range(40)]
    rows = [(rng.choice(words), rng.choice([None, 1, 2, 3])) for _ in range(400)] + [("long " * 30 + "0", 1)] * 300
    df = spark.createDataFrame(rows, "s string, n long").repartition(5)
    got = {r.ordinal: r.sample_values for r in P.sample_values({"t": df}).collect()}
    md5 = lambda v: hashlib.md5(v.encode()).hexdigest()
    assert got[1] == sorted({s for s, _ in rows}, key=md5)[:5]
    assert got[2] == sorted({str(n) for _, n in rows if n is not None}, key=md5)[:5]


def test_profiles_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 9), rng.choice([NAN, None, 1.5, -2.0]), rng.choice(["", "a", None, "b" * 70, "b" * 71])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, b double, c string").repartition(6)
    gone = lambda v: v is None or (isinstance(v, float) and math.isnan(v))
    p = by_column(P.column_profiles({"t": df}))
    for i, c in enumerate("abc"):
        kept = [r[i] for r in rows if not gone(r[i])]
        assert (p["t", c].null_count, p["t", c].unique_count) == (500 - len(kept), len(set(kept)))
    whole = {tuple(None if gone(v) else v for v in r) for r in rows}
    assert P.table_profiles({"t": df}).first().duplicate_row_count == 500 - len(whole)


def test_one_shuffle_serves_counts_and_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    plan = P.column_profiles({"t": df})
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in text and "WindowGroupLimit" in text


def test_sample_rows_is_repeatable(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("b"))
    a = P.sample_rows(df, 20).collect()
    b = P.sample_rows(df.repartition(7), 20).collect()
    assert len(a) == 20 and sorted(a) == sorted(b) and P.sample_rows(df.limit(0), 20).count() == 0
    assert P.sample_rows(df, 0).count() == 0 and P.sample_rows(df, 500).count() == P.sample_rows(df, 900).count() == 500
    key = F.md5(F.to_json(F.struct("id", "b")))
    assert sorted(a) == sorted(df.orderBy(key).limit(20).collect())


def test_large_samples_and_equal_rows_are_not_sorted_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "PREFIX", 1)
    monkeypatch.setattr(P, "SORTED", 50)
    df = spark.range(20_000).select("id")
    want = {r.id for r in df.orderBy(F.md5(F.to_json(F.struct("id")))).limit(12_345).collect()}
    got = P.sample_rows(df, 12_345)
    assert {r.id for r in got.collect()} == want and got.count() == 12_345
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=12345" not in plan and "rangepartitioning" not in plan
    same = spark.range(5000).select(F.lit("x").alias("s")).union(spark.range(100).select(F.col("id").cast("string")))
    for n in (1, 60, 3000, 5099, 5100, 6000):
        assert P.sample_rows(same, n).count() == min(n, 5100)


def test_samples_of_many_long_texts_travel_below_a_limit(spark):
    text = F.concat(F.repeat(F.lit("long "), F.lit(20)), F.col("id").cast("string"))
    df = spark.range(20_000).select(text.alias("s"), F.when(F.col("id") < 3, text).alias("few"), F.lit(None).cast("string").alias("none"), F.array(text).alias("nested"))
    ranges = P.column_ranges({"t": df}, estimates=True)
    limits = P.sample_limits(ranges)
    assert set(limits) == {("t", 1), ("t", 2), ("t", 4)} and limits["t", 2] == "g"
    cells = P.distinct_cells({"t": df}, limits=limits)
    travelling = {r.ordinal: r.n for r in cells.filter("k_sample IS NOT NULL").groupBy("ordinal").agg(F.count("*").alias("n")).collect()}
    assert 40 < travelling[1] < 200 and travelling[2] == 3
    p = {r.column_name: r.sample_values for r in P.column_profiles({"t": df}).collect()}
    assert p["s"] == [r.s for r in df.select("s").distinct().orderBy(F.md5("s")).limit(5).collect()]
    assert len(p["few"]) == 3 and p["none"] == [] and len(p["nested"]) == 5


def test_states_merge_and_only_new_files_are_read(spark, tmp_path):
    from tablelore.operators import sketches

    def part(a, b):
        return spark.range(a, b).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id"))).alias("s"))

    table, other = str(tmp_path / "grown"), str(tmp_path / "other")
    part(0, 3000).coalesce(2).write.parquet(table)
    part(0, 10).coalesce(1).write.parquet(other)
    store = sketches.ProfileStore(spark, str(tmp_path / "store"))
    assert store.profiles().count() == 0
    assert store.update({"grown": table, "other": other}) == {"grown": 2, "other": 1}
    part(2000, 6000).withColumn("more", F.lit(1)).coalesce(1).write.mode("append").parquet(table)
    assert store.update({"grown": table, "other": other}) == {"grown": 1, "other": 0}
    assert store.update({"grown": table, "other": other}) == {"grown": 0, "other": 0}
    p = {(r.table_name, r.column_name): r for r in store.profiles().collect()}
    whole = spark.read.option("mergeSchema", "true").parquet(table)
    fresh = {r.column_name: r for r in sketches.profiles_of(sketches.column_states({"grown": whole})).collect()}
    for c in ("id", "x", "s", "more"):
        a, b = p["grown", c], fresh[c]
        assert (a.total_rows, a.null_count, a.min_num, a.max_num, a.mean_value) == (b.total_rows, b.null_count, b.min_num, b.max_num, b.mean_value)
        assert a.unique_estimate == b.unique_estimate  # a merged sketch is the sketch of the whole
    assert abs(p["grown", "id"].unique_estimate - 6000) < 6000 * sketches.error_bound() and p["grown", "s"].min_value == "t0"
    assert p["other", "x"].unique_estimate == 7 and p["grown", "more"].null_count == 3000
    part(0, 5).coalesce(1).write.mode("overwrite").parquet(other)  # what was profiled is gone: the table starts anew
    assert store.update({"grown": table, "other": other})["other"] == 1
    assert {r.column_name: r.total_rows for r in store.profiles().filter("table_name = 'other'").collect()} == {"id": 5, "x": 5, "s": 5}


def test_quality_issues_and_report(spark):
    df = spark.createDataFrame([(None, None, None, 1), (None, None, 2, 1), (None, 3, 2, 1)], "a int, b int, c int, d int")
    ranges = catalog.with_source(P.column_ranges({"t": df, "fine": df.select("d").limit(1)}), "db")
    issues = views.quality_issues(catalog.with_source(P.table_profiles({"t": df, "fine": df.select("d").limit(1)}, ranges), "db"), ranges).collect()
    assert [(i.table_name, [x.column_name for x in i.top_null_columns]) for i in issues] == [("t", ["a", "b", "c"])]
    r = {x.table_name: x for x in views.table_report(P.table_sizes(ranges)).collect()}
    assert (r["t"].completeness_pct, r["t"].completeness_class) == (50.0, "bad") and r["fine"].completeness_class == "good"


def test_no_tables_are_complete(spark):
    found = P.database_profile(P.table_profiles({})).first()
    assert (found.total_tables, found.overall_completeness) == (0, 1.0)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_made_once_for_counts_and_samples(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("d"), F.concat(F.lit("t"), F.col("id") % 900).alias("s"), F.lit(None).cast("string").alias("none"),
                                  F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 400).cast("int")).alias("day"), (F.col("id") % 3).cast("decimal(9,2)").alias("dec"))
    got = P.counts_and_samples(P.distinct_cells({"t": df, "u": df.limit(2)}, limits={}))
    rows = {(r.table_name, r.ordinal): r for r in got.collect()}
    assert [rows["t", i].unique_count for i in (0, 1, 2, 3, 5, 6)] == [3000, 3000, 7, 900, 400, 3] and ("t", 4) not in rows and rows["u", 0].unique_count == 2
    plan = plan_of(got).split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 5  # every kind of cells but, at most, one
    for i, c in ((1, "id"), (2, "d"), (3, "s"), (5, "day"), (6, "dec")):
        text = F.col(c).cast("string")
        assert rows["t", i].sample_values == [r.v for r in df.select(text.alias("v")).distinct().orderBy(F.md5("v")).limit(5).collect()]


def test_a_number_is_compared_by_its_slot_and_itself(spark):
    plan = plan_of(P.distinct_cells({"t": spark.range(5)}, rows=False))
    assert "keys=[slot" in plan and "k_text" not in plan.split("HashAggregate(keys=[slot")[-1]
