import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelore.functions import cells
from tablelore.operators import catalog, cleaning, pii, profiling, relationships
from tablelore.sources import csv_folder
from tablelore.sources.tables import InputKind, detect_input_kind, jdbc_url, load_parquet_folder, load_tables


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "plain.csv").write_text(
        "ID, Full  Name ,Order Date,price,zip,flag\n1, Ann ,2024-01-02,1.5,00123,True\n2,NULL,01/31/2024,2,7,false\n"
        "2,NULL,01/31/2024,2,7,false\n3,  ,not a date,N/A,8,TRUE\n")
    (tmp_path / "semi.csv").write_text("a;b\n1,5;x\n2,5;y\n")
    (tmp_path / "tabs.csv").write_text("a\tb\n1\tx\n1.0\ty\n")
    (tmp_path / "quoted.csv").write_text('k,text\n1,"two\nlines, and ""quotes"""\n2,"a,b"\n3,short\n')
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfname,bad\nx,\xff1\n")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3,4,5\n")
    (tmp_path / "short.csv").write_text("a,b\n1\n2,3\n")
    (tmp_path / "twice.csv").write_text("a b,A  B\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header_only.csv").write_text("x,y\n")
    (tmp_path / "odd.csv").write_text("v\n1d\n1.0f\n2\n")
    (tmp_path / "notes.txt").write_text("not a table")
    return str(tmp_path)


def test_folder(spark, folder):
    loaded = csv_folder.load_csv_folder(spark, folder)
    assert sorted(loaded.tables) == ["bom", "header_only", "odd", "plain", "quoted", "semi", "short", "tabs"]
    assert sorted(f.split("/")[-1] for f, _ in loaded.errors) == ["empty.csv", "ragged.csv", "twice.csv"]
    assert loaded.load_errors(spark).count() == 3
    t = loaded.tables["plain"]
    assert t.dtypes == [("id", "bigint"), ("full_name", "string"), ("order_date", "timestamp_ntz"), ("price", "double"),
                        ("zip", "bigint"), ("flag", "boolean")]
    rows = sorted(t.collect())
    assert rows[0][:5] == (1, "Ann", dt.datetime(2024, 1, 2), 1.5, 123) and len(rows) == 3
    assert rows[2][1:4] == (None, None, None) and rows[1][2] == dt.datetime(2024, 1, 31)
    assert loaded.tables["semi"].columns == ["a", "b"] and loaded.tables["tabs"].dtypes[0] == ("a", "bigint")
    q = {r.k: r.text for r in loaded.tables["quoted"].collect()}
    assert q == {1: 'two\nlines, and "quotes"', 2: "a,b", 3: "short"}
    b = loaded.tables["bom"].first()
    assert b.name == "x" and b.bad == "�1"
    assert sorted(loaded.tables["short"].collect(), key=str) == [(1, None), (2, 3)]
    assert loaded.tables["odd"].dtypes == [("v", "string")]


def test_layout(spark, folder):
    found = {r.table_name: (r.delimiter, r.multi_line) for r in csv_folder.file_layout(spark, folder).collect()}
    assert found["semi"] == (";", False) and found["tabs"] == ("\t", False)
    assert found["quoted"] == (",", True) and found["odd"] == (",", False)  # only files that need it lose their splits


def test_folder_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_folder.load_csv_folder(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        csv_folder.load_csv_folder(spark, str(tmp_path))
    (tmp_path / "bad.csv").write_text("")
    with pytest.raises(ValueError):
        csv_folder.load_csv_folder(spark, str(tmp_path))


def test_clean_keeps_order_of_steps(spark):
    df = spark.createDataFrame([(" a ", "1"), ("a", "1"), ("", "1.0"), ("\t", "1.0")], "s string, n string")
    out = cleaning.clean(df)
    assert {tuple(r) for r in out.collect()} == {(None, "1.0"), ("a", "1")} and out.count() == 2
    typed = cleaning.infer_types(cleaning.clean(spark.createDataFrame([("1",), ("1.0",)], "n string")))
    assert [r.n for r in typed.collect()] == [1, 1]  # kept: rows are compared before they are typed


def test_numeric_dates_only_on_request(spark):
    df = spark.createDataFrame([(1_500_000_000,)], "event_time long")
    assert cleaning.clean(df).first()[0] == 1_500_000_000
    assert cleaning.clean(df, parse_numeric_dates=True).first()[0] == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)


def test_types(spark):
    df = spark.createDataFrame([("1", "1e3", "inf", None, "True", 1.0), ("+2.", ".5", "2", None, "x", 2.0)],
                               "a string, b string, c string, d string, e string, f double")
    assert {r.column_name: r.inferred_type for r in cleaning.type_flags(df).collect()} == {
        "a": "bigint", "b": "double", "c": "double", "d": "string", "e": "string", "f": "bigint"}
    assert cleaning.infer_types(df).dtypes[-1] == ("f", "bigint")


def test_kinds(spark, tmp_path):
    assert detect_input_kind(spark, "x/My.SQLITE") is InputKind.SQLITE_FILE
    assert detect_input_kind(spark, "a.db") is InputKind.SQLITE_FILE
    assert detect_input_kind(spark, "postgresql://h/d") is InputKind.POSTGRES
    assert detect_input_kind(spark, " mysql://h/d") is InputKind.MYSQL
    assert detect_input_kind(spark, str(tmp_path)) is InputKind.CSV_FOLDER
    assert jdbc_url("postgresql://h/d", InputKind.POSTGRES) == "jdbc:postgresql://h/d"
    for bad in ("dump.sql", str(tmp_path / "none"), "odd://thing"):
        with pytest.raises(ValueError):
            detect_input_kind(spark, bad)
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert detect_input_kind(spark, str(tmp_path)) is InputKind.PARQUET_FOLDER
    assert load_tables(spark, str(tmp_path))["t"].count() == 3
    assert list(load_parquet_folder(spark, str(tmp_path))) == ["t"]


def test_shop_from_csv_end_to_end(spark, tmp_path):
    """A small shop in the shape of the sample data: no declared keys, one literal NULL."""
    (tmp_path / "staffs.csv").write_text(
        "staff_id,first_name,email,phone,active,store_id,manager_id\n1,Ada,ada@shop.example,(831) 555-5554,1,1,NULL\n"
        + "".join(f"{i},N{i},n{i}@shop.example,(831) 555-55{i},1,1,1\n" for i in range(10, 19)))
    (tmp_path / "stores.csv").write_text("store_id,store_name,zip_code\n1,Main,95060\n")
    tables = csv_folder.load_csv_folder(spark, str(tmp_path)).tables
    keys = catalog.no_keys(spark)
    columns = catalog.catalog_columns(catalog.field_frame(spark, tables, "shop"), keys)
    e = [(r.from_table, r.from_column, r.to_table, r.confidence) for r in relationships.relationships(columns, keys).collect()]
    assert e == [("staffs", "store_id", "stores", 0.95)]
    p = {(r.table_name, r.column_name): r for r in profiling.column_ranges(tables).collect()}
    assert p["staffs", "manager_id"].null_count == 1 and p["staffs", "manager_id"].null_rate == 0.1
    named = {(r.table_name, r.column_name) for r in pii.by_name(columns).collect()}
    assert ("staffs", "active") not in named and ("stores", "zip_code") in named


def test_odd_file_names_and_mixed_folders_load_whole(spark, tmp_path):
    for name in ("q#1.csv", "caf%41.csv", "a b.csv", "é.csv", "plain.csv"):
        (tmp_path / name).write_text("a;b\n1;x\n2;y\n")
    got = csv_folder.load_csv_folder(spark, str(tmp_path))
    assert not got.errors and {n: sorted(t.columns) for n, t in got.tables.items()} == {n: ["a", "b"] for n in ("q#1", "caf%41", "a b", "é", "plain")}
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert set(load_tables(spark, str(tmp_path))) == {"q#1", "caf%41", "a b", "é", "plain", "p"}


LAYOUT_CASES = [
    ("2020-01-01T00:00:00Z", "2020-01-01 00:00:00"), ("2020-01-01T10:00", "2020-01-01 10:00:00"), ("2020-01-01 05:00:00+02:00", "2020-01-01 03:00:00"),
    ("2020-01-01 05:00:00 +0200", "2020-01-01 03:00:00"), ("2020-1-5", "2020-01-05 00:00:00"), ("2020/01/05 07:08:09.25", "2020-01-05 07:08:09.25"), ("20200105", "2020-01-05 00:00:00"),
    ("Jan 5, 2020", "2020-01-05 00:00:00"), ("January 5 2020", "2020-01-05 00:00:00"), ("5 Jan 2020", "2020-01-05 00:00:00"), ("05-Jan-2020 10:30", "2020-01-05 10:30:00"),
    ("5 January 2020", "2020-01-05 00:00:00"), ("MAY 5, 2020", "2020-05-05 00:00:00"), ("never", None), ("2020-13-01", None), ("5 Foo 2020", None), ("", None), ("12", None), (None, None),
]


def test_date_layouts_of_any_order(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LAYOUT_CASES)], "i int, t string")
    for day_first in (False, True):
        got = rows.select("i", cells.parse_timestamp(cells.ref("t"), day_first).cast("string").alias("d")).orderBy("i").collect()
        assert [(LAYOUT_CASES[r.i][0], r.d) for r in got] == LAYOUT_CASES


def test_one_column_never_mixes_day_first_and_month_first(spark):
    rows = [("01/02/2020", "01/02/2020", "01.02.2020", "x"), ("31/12/2020", "12/31/2020", "31.12.2020", "x"), ("12/31/2020", "Jan 5, 2020", "2020-02-03", None), ("", "03-04-2020", " ", None)]
    df = spark.createDataFrame(rows, "european_date string, american_date string, dotted_date string, some_time string")
    texts = cleaning.clean_texts(df)
    got = {r.column_name: (r.filled, r.month_first_fits, r.day_first_fits, r.day_first, r.parsed, r.lost) for r in cleaning.date_layouts(texts).collect()}
    assert got["american_date"] == (4, 3, 2, False, 4, 0) and got["dotted_date"] == (3, 0, 2, True, 3, 0) and got["some_time"] == (2, 0, 0, False, 0, 2)
    assert got["european_date"] == (3, 2, 2, False, 2, 1)  # a tie is read with the month first
    read = {tuple(None if v is None else v.date().isoformat() for v in r) for r in cleaning.clean_cells(df).collect()}
    assert read == {("2020-01-02", "2020-01-02", "2020-02-01", None), (None, "2020-12-31", "2020-12-31", None), ("2020-12-31", "2020-01-05", "2020-02-03", None),
                    (None, "2020-03-04", None, None)}
    more = df.union(spark.createDataFrame([("30/11/2020", None, None, None)], df.schema))
    assert sorted(str(r[0]) for r in cleaning.clean_cells(more).select("european_date").collect()) == ["2020-02-01 00:00:00", "2020-11-30 00:00:00", "2020-12-31 00:00:00", "None", "None"]
    assert cleaning.date_layouts(spark.createDataFrame([(1,)], "a int")).count() == 0
    empty = cleaning.date_layouts(df.limit(0)).collect()
    assert {(r.filled, r.day_first, r.parsed, r.lost) for r in empty} == {(0, False, 0, 0)}


def test_loaded_tables_are_parquet_with_errors_and_lost_values(spark, folder):
    tables = load_tables(spark, folder)
    assert sorted(f.split("/")[-1] for f, _ in tables.errors) == ["empty.csv", "ragged.csv", "twice.csv"] and tables.load_errors(spark).count() == 3
    assert [(f.split("/")[-1], c, n) for f, c, n in tables.lost] == [("plain.csv", "order_date", 1)] and tables.lost_values(spark).count() == 1
    plan = profiling.table_sizes(profiling.column_ranges(tables))._jdf.queryExecution().executedPlan().toString()
    assert "Scan csv" not in plan and "parquet" in plan.lower()
    assert all("FileScan csv" not in t._jdf.queryExecution().executedPlan().toString() for t in tables.values())


def test_float_zeros_are_one_value(spark):
    table = spark.createDataFrame([(0.0,), (-0.0,), (0.1,)], "x float")
    assert profiling.distinct_cells({"t": table}, rows=False).count() == 2


def test_large_whole_numbers_stay_apart(spark):
    rows = [("12345678901234567890", "12345678901234567890", "9007199254740993", "1" * 39, "9223372036854775807", "1e300", "9999999999999998"),
            ("12345678901234567891", "12345678901234567891", "9007199254740992", "1" * 38 + "2", "-9223372036854775808", "2.5e20", "0.5"),
            ("1e3", "0.5", "0.5", "7", "2.0", "3", "1")]
    df = spark.createDataFrame(rows, "id string, mixed string, odd string, long string, edge string, real string, even string")
    typed = cleaning.infer_types(df)
    assert [t for _, t in typed.dtypes] == ["decimal(38,0)", "string", "string", "string", "bigint", "double", "double"]
    assert all(typed.select(c).distinct().count() == 3 for c in typed.columns)
    assert sorted(int(r.id) for r in typed.collect()) == [1000, 12345678901234567890, 12345678901234567891]
    assert sorted(r.edge for r in typed.collect()) == [-(2**63), 2, 2**63 - 1]
    ids = typed.select("id")
    p = profiling.column_ranges({"t": ids}).first()
    assert p.null_count == 0 and profiling.distinct_cells({"t": ids}, rows=False).count() == 3


def test_delimiter_with_most_votes_is_taken_and_doubt_is_listed(spark, tmp_path):
    (tmp_path / "semi.csv").write_text("a;b;c\n" + "1;x;y\n" * 7 + "2;x\n3;x\n4,0;x\n")
    (tmp_path / "one.csv").write_text("note\nfoo\nbar\nbaz\n")
    (tmp_path / "said.csv").write_text("note\nfoo\nbar; baz\n")
    got = csv_folder.load_csv_folder(spark, str(tmp_path))
    assert got.tables["semi"].columns == ["a", "b", "c"] and got.tables["semi"].count() == 4
    assert got.tables["one"].columns == got.tables["said"].columns == ["note"] and got.tables["said"].count() == 2
    assert sorted((f.split("/")[-1], "doubtful" in e) for f, e in got.errors) == [("said.csv", True), ("semi.csv", True)]


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    spark.range(100).select("id", F.concat(F.lit("a;b "), F.col("id")).alias("text")).repartition(4).write.csv(str(tmp_path / "parts.csv"), header=True, sep="\t")
    (tmp_path / "one.csv").write_text("a;b\n1;2\n")
    tables = load_tables(spark, str(tmp_path))
    assert sorted(tables) == ["one", "parts"] and not tables.errors
    assert tables["parts"].columns == ["id", "text"] and tables["parts"].count() == 100 and tables["one"].columns == ["a", "b"]


def test_code_for_types_does_not_grow_with_the_columns(spark):
    def patterns(n: int) -> int:
        df = spark.range(3).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(n)])
        return cleaning.type_flags(df)._jdf.queryExecution().executedPlan().toString().upper().count("RLIKE")

    assert patterns(30) == patterns(2)


def test_types_of_empty_and_blank_columns(spark):
    df = spark.createDataFrame([], "a string, made_date string, n double")
    assert [tuple(r) for r in cleaning.type_flags(df, dates=True).orderBy("ordinal").collect()] == [
        (1, "a", "string", 0, None, None), (2, "made_date", "timestamp_ntz", 0, False, 0), (3, "n", "double", 0, None, None)]


def test_strip_with_and_without_a_pattern(spark):
    texts = ["a b", " a", "a ", " a", "~", "é", "　", "\x0b!", "a\n", "", "!\u0085", "~\U0010ffff z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(cells.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("r")).collect()
    assert all(x.s == x.r for x in out)
    assert [r.t for r in cleaning.clean_texts(df).collect()] == [x.r or None for x in out]
