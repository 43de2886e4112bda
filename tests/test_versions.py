import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablelore.operators import catalog, versions
from tablelore.plans import dictionary, views
from tablelore.sources.version_store import VersionStore, WriteConflict

# The tables and columns behind the known schema hash.
MUSIC = {
    "Album": "AlbumId ArtistId Title",
    "Artist": "ArtistId Name",
    "Customer": "Address City Company Country CustomerId Email Fax FirstName LastName Phone PostalCode State SupportRepId",
    "Employee": "Address BirthDate City Country Email EmployeeId Fax FirstName HireDate LastName Phone PostalCode ReportsTo State Title",
    "Genre": "GenreId Name",
    "Invoice": "BillingAddress BillingCity BillingCountry BillingPostalCode BillingState CustomerId InvoiceDate InvoiceId Total",
    "InvoiceLine": "InvoiceId InvoiceLineId Quantity TrackId UnitPrice",
    "MediaType": "MediaTypeId Name",
    "Playlist": "Name PlaylistId",
    "PlaylistTrack": "PlaylistId TrackId",
    "Track": "AlbumId Bytes Composer GenreId MediaTypeId Milliseconds Name TrackId UnitPrice",
}


def test_known_schema_hash(spark):
    rows = [("music", t, c) for t, cs in MUSIC.items() for c in reversed(cs.split())]
    out = versions.schema_hash(spark.createDataFrame(rows, "source string, table_name string, column_name string"))
    assert out.first().schema_hash == "9479ee5027481950c2a6d4a7c4bc364a"


def history(spark, states):
    """states: [(id, path, time, {table: (rows, score, [columns])})]"""
    h = spark.createDataFrame([(i, p, t) for i, p, t, _ in states], "snapshot_id string, source_path string, captured_at timestamp_ntz")
    h = h.withColumn("source_key", versions.source_key(F.col("source_path")))
    t = spark.createDataFrame([(i, n, len(c), r, s) for i, _, _, ts in states for n, (r, s, c) in ts.items()],
                              "snapshot_id string, table_name string, column_count long, row_count long, completeness_score double")
    c = spark.createDataFrame([(i, n, x) for i, _, _, ts in states for n, (_, _, cs) in ts.items() for x in cs],
                              "snapshot_id string, table_name string, column_name string")
    return h, t, c


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


STATES = [
    ("s1", "data/A", day(1), {"kept": (100, 0.90, ["a", "b"]), "gone": (1, 1.0, ["x"]), "zero": (0, 1.0, ["z"]), "still": (0, 1.0, ["z"]),
                              "near": (100, 0.90, ["n"])}),
    ("s2", " DATA/a/ ", day(3), {"kept": (106, 0.87, ["b", "c", "d"]), "new": (1, 1.0, ["y"]), "zero": (4, 1.0, ["z"]), "still": (0, 1.0, ["z"]),
                                 "near": (105, 0.885, ["n"])}),
    ("s3", "data/a", day(3, 5), {"kept": (106, 0.87, ["b", "c", "d"]), "new": (1, 1.0, ["y"]), "zero": (4, 1.0, ["z"]), "still": (0, 1.0, ["z"]),
                                 "near": (105, 0.885, ["n"])}),
    ("s4", "data/a", day(20), {"kept": (106, None, ["b", "c", "d"]), "new": (1, 1.0, ["y", "y2"]), "zero": (4, 1.0, ["z"]),
                               "still": (0, 1.0, ["z"]), "near": (105, 0.885, ["n"])}),
    ("o1", "other", day(2), {"t": (1, 1.0, ["a"])}),
]


def test_drift(spark):
    d = {r.snapshot_id_after: r for r in versions.drift(*history(spark, STATES)).collect()}
    assert sorted(d) == ["s2", "s3", "s4"] and [d[k].snapshot_id_before for k in sorted(d)] == ["s1", "s2", "s3"]
    a = d["s2"]
    assert (a.tables_added, a.tables_removed) == (["new"], ["gone"])
    assert a.columns_added == {"kept": ["c", "d"]} and a.columns_removed == {"kept": ["a"]} and a.has_breaking_changes
    assert list(a.completeness_changes) == ["kept"] and abs(a.completeness_changes["kept"].delta + 0.03) < 1e-9
    assert {k: round(v.delta_pct, 6) for k, v in a.row_count_changes.items()} == {"kept": 0.06, "zero": 1.0}  # 5 % is not enough
    assert a.summary == ("1 table(s) added; 1 table(s) removed; columns added in 1 table(s); columns removed in 1 table(s); "
                         "completeness shifted in 1 table(s); row-count drift in 2 table(s).")
    b = d["s3"]
    assert b.summary == "No drift detected between snapshots." and not b.has_breaking_changes
    assert (b.tables_added, b.columns_added, b.row_count_changes) == ([], {}, {})
    c = d["s4"]
    assert c.columns_added == {"new": ["y2"]} and not c.has_breaking_changes
    assert c.completeness_changes["kept"].after == 0.0  # a missing score counts as zero


def test_lists_and_latest(spark):
    h, t, c = history(spark, STATES)
    assert [r.snapshot_id for r in versions.listing(h, t).collect()] == ["s4", "s3", "s2", "o1", "s1"]
    assert {r.source_key: r.snapshot_id for r in versions.latest(h).collect()} == {"data/a": "s4", "other": "o1"}
    assert [r.snapshot_id for r in versions.of_source(h, "Data//A").collect()] == ["s1", "s2", "s3", "s4"]
    s = versions.snapshots(h, t, c).filter("snapshot_id = 'o1'").first()
    assert (s.table_names, s.row_counts, s.column_counts, s.completeness_scores) == (["t"], {"t": 1}, {"t": 1}, {"t": 1.0})
    newest = views.newest_artifacts(h.select("source_key", F.col("snapshot_id").alias("path"), F.col("captured_at").alias("generated_at")))
    assert {r.source_key: r.path for r in newest.collect()} == {"data/a": "s4", "other": "o1"}


def test_previous_snapshot_with_a_hot_source(spark):
    """One source with nearly all snapshots, many a day."""
    rows = [(f"{i:05d}", "hot", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=97 * i)) for i in range(600)]
    rows += [("c1", "cold", day(1)), ("c2", "cold", day(9))]
    h = spark.createDataFrame(rows, "snapshot_id string, source_path string, captured_at timestamp_ntz").withColumn(
        "source_key", F.col("source_path"))
    got = {r.snapshot_id_after: r.snapshot_id_before for r in versions.consecutive(h.repartition(5)).collect()}
    assert got == {**{f"{i:05d}": f"{i - 1:05d}" for i in range(1, 600)}, "c2": "c1"}


def _dictionary(spark, n):
    t = spark.range(n).select("id", F.when(F.col("id") > 1, F.lit("x")).alias("email"))
    return dictionary.build(spark, {"t": t}, "Data/Shop", catalog.no_keys(spark))


def test_store_round_trip(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert store.read("headers").count() == 0 and store.drift_history("Data/Shop").count() == 0
    assert store.detect_drift(dictionary.snapshot(_dictionary(spark, 10))).count() == 0
    r = store.detect_drift(dictionary.snapshot(_dictionary(spark, 20))).collect()
    assert len(r) == 1 and r[0].row_count_changes["t"].delta_pct == 1.0 and not r[0].has_breaking_changes
    assert "completeness_changes" in r[0].asDict() and r[0].summary.endswith("row-count drift in 1 table(s).")
    assert store.snapshots("data/shop/").count() == 2 and store.drift_history(" data/shop ").count() == 1
    assert store.latest_snapshot("data/shop").count() == 1
    store.save(_parts(spark, 1, path="Other"))
    assert all(store._home("data/shop") in f for name in ("headers", "tables", "columns") for f in store.read(name, "data/shop").inputFiles())


def test_document(spark, tmp_path):
    d = _dictionary(spark, 4)
    path = dictionary.write_document(d, str(tmp_path), "parquet_folder", "2024-01-01T00:00:00")
    assert path.endswith("dictionary_result_parquet_folder_2024-01-01T00-00-00")
    whole = spark.read.json(f"{path}/database").first()
    assert (whole.source, whole.total_tables, whole.total_columns, whole.generated_at) == ("Data/Shop", 1, 2, "2024-01-01T00:00:00")
    assert whole.tables_with_issues == ["t"] and whole.adjacency == [] and whole.pii_summary.by_pii_type.EMAIL == 1 and whole.overall_completeness == 0.75
    assert json.loads((tmp_path / path.split("/")[-1] / "manifest.json").read_text())["lines"] == {"database": 1, "tables": 1}
    back = spark.read.json(f"{path}/tables").first()
    assert back.table_name == "t" and back.row_count == 4 and [c.column_name for c in back.columns] == ["id", "email"]
    assert back.pii_findings[0].pii_type == "EMAIL" and back.column_profiles[1].null_count == 2
    assert d.rollup().first().pii_column_count == 1 and d.stats().first().total_columns == 2
    assert d.pii_summary().first().rule_based_hits == 1
    prompt = dictionary.prompts(d).first().prompt
    assert "  - id: bigint (nullable=" in prompt and "PK=False" in prompt
    assert "  - email: null_rate=0.500, uniqueness_rate=0.250" in prompt and "  (none detected)" in prompt
    assert "  - email: EMAIL via rule_based (confidence=0.95)" in prompt


def _parts(spark, i, rows=100, names=("a", "b"), path="Data/Shop"):
    head = spark.createDataFrame([(f"s{i:03d}", path, path.lower(), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "h")], versions.HEADER)
    columns = spark.createDataFrame([(f"s{i:03d}", t, c) for t in ("t", "u") for c in (names if t == "t" else ("x",))], "snapshot_id string, table_name string, column_name string")
    digests = versions.table_digests(columns, "snapshot_id")
    tables = spark.createDataFrame([(f"s{i:03d}", "t", 2, rows, 1.0), (f"s{i:03d}", "u", 1, 5, 1.0)],
                                   "snapshot_id string, table_name string, column_count long, row_count long, completeness_score double")
    return head, tables.join(digests, ["snapshot_id", "table_name"]), columns


def test_a_long_history_is_compared_by_two_snapshots(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    for i in range(12):
        store.save(_parts(spark, i))
    read = []
    compared = store.compared

    def watched(*args):
        frames = compared(*args)
        read.extend(f for frame in frames[1:] for f in frame.inputFiles())
        return frames

    store.compared = watched
    r = store.detect_drift(_parts(spark, 12, 200, ("b", "c"))).first()
    assert {f.split("/data/")[1].split("/")[0] for f in read} == {"s011", "s012"}
    assert (r.snapshot_id_before, r.snapshot_id_after) == ("s011", "s012") and r.columns_added == {"t": ["c"]} and r.columns_removed == {"t": ["a"]}
    # packed, everything reads as before, from few files
    before = {n: sorted(map(str, store.read(n, "data/shop").collect())) for n in ("headers", "tables", "columns", "drift")}
    store.compact("data/shop")
    store.clean_up("data/shop")
    assert {n: sorted(map(str, store.read(n).collect())) for n in before} == before
    assert len(store._names(f"{store._home('data/shop')}/log")) == 2 and store._names(f"{store._home('data/shop')}/data") == ["s012"]
    store.compact("data/shop")  # nothing new
    r = store.detect_drift(_parts(spark, 13, 200, ("b", "c", "d"))).first()
    assert (r.snapshot_id_before, r.columns_added) == ("s012", {"t": ["d"]})
    assert [x.number for x in store.snapshots("Data//shop/").collect()] == list(range(14)) and store.latest_snapshot("data/shop").first().snapshot_id == "s013"
    assert store.all_drift("data/shop").count() == 13 and store.drift_history("data/shop").count() == 2
    store.compact("data/shop")
    store.clean_up("data/shop")
    assert store.read("headers").count() == 14 and store.read("drift").count() == 2


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    first, second = (VersionStore(spark, str(tmp_path / "store")) for _ in range(2))
    first.save(_parts(spark, 1))
    late = second._write_parts(_parts(spark, 2))
    first.save(_parts(spark, 3))
    with pytest.raises(WriteConflict):
        second._publish(*late)
    assert [r.snapshot_id for r in second.snapshots("data/shop").collect()] == ["s001", "s003"]  # files never published are not seen
    assert second.read("tables").select("snapshot_id").distinct().count() == 2
    second.save(_parts(spark, 4))
    assert second.read("headers").count() == 3


def test_columns_are_read_of_changed_tables_only(spark):
    """Columns of tables with equal digests are missing here; if they were read, they would look removed."""
    h, t, c = history(spark, STATES)
    t = t.join(versions.table_digests(c, "snapshot_id"), ["snapshot_id", "table_name"])
    few = c.filter("table_name IN ('kept', 'new')")
    whole, part = (sorted(map(str, versions.drift(h, t, x).collect())) for x in (c, few))
    assert whole == part == sorted(map(str, versions.drift(h, t.drop("table_digest"), c).collect()))


def test_cluster_settings():
    from tablelore.session import cluster_settings

    assert cluster_settings(1 << 20)["spark.sql.shuffle.partitions"] == "200"
    assert cluster_settings(10 << 40)["spark.sql.shuffle.partitions"] == str((10 << 40) // (256 << 20))
    assert cluster_settings(100 << 40)["spark.sql.shuffle.partitions"] == "409600"
