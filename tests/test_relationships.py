"""Edges against the rules applied pair by pair in plain Python."""

import random

from tablelore.operators import catalog, relationships as rel
from tablelore.session import settle

FIELDS = "source string, table_name string, ordinal int, column_name string, data_type string, is_nullable boolean, default_value string"


def frames(spark, tables):
    """tables: {(source, table): (columns, pk, [(cols, referred, referred cols)])}"""
    fields = [(s, t, i, c, "bigint", True, None) for (s, t), (cols, _, _) in tables.items() for i, c in enumerate(cols, 1)]
    keys = [(s, t, pk, [(f"f{i}", c, None, r, rc, None) for i, (c, r, rc) in enumerate(fks)])
            for (s, t), (_, pk, fks) in tables.items()]
    k = spark.createDataFrame(keys, catalog.KEYS_SCHEMA)
    return catalog.catalog_columns(spark.createDataFrame(fields, FIELDS), k), k


def edges(spark, tables):
    c, k = frames(spark, tables)
    return rel.relationships(c, k)


def core(t):
    n = t.lower()
    n = n[6:] if n.startswith("olist_") else n
    n = n[:-8] if n.endswith("_dataset") else n
    return n.strip("_")


def expected_implicit(tables):
    """The rules, naively: every column against every other table of its source."""
    out = set()
    for (s, t), (cols, pk, fks) in tables.items():
        declared = {a for c, _, rc in fks for a, _ in zip(c, rc)}
        for c in cols:
            low = c.lower()
            stem = (low[:-3].strip("_") or None) if low.endswith("_id") else None
            if c in declared or pk == [c]:
                continue
            if stem and low == stem + "_id" and core(t) in (stem, stem + "s"):
                continue
            best = []
            for (s2, o), (ocols, opk, _) in tables.items():
                if s2 != s or o == t:
                    continue
                by_low = {x.lower(): x for x in ocols}
                k = core(o)
                exact = bool(stem) and (k == stem or k == stem + "s" or k.rstrip("s") == stem)
                score = 0.95 if low in {x.lower() for x in opk} else 0.0
                if stem:
                    if exact and low in by_low:
                        score = max(score, 0.95)
                    elif exact or stem in k.split("_") or k.startswith(stem):
                        score = max(score, 0.80)
                    elif len(stem) >= 3 and (stem in k or k in stem):
                        score = max(score, 0.60)
                if score < 0.6 or (stem and low not in by_low and stem + "_id" not in by_low):
                    continue
                if low in by_low:
                    to = by_low[low]
                elif len(opk) == 1:
                    to = opk[0]
                else:
                    to = by_low[stem + "_id"]
                best.append((-score, o, to))
            if best:
                score, o, to = min(best)
                out.add((s, t, c, o, to, -score))
    return out


def test_random_catalogues_against_pairwise_rules(spark):
    rng = random.Random(7)
    words = ["order", "item", "user", "cat", "order_item", "us", "s"]
    shapes = ["{}", "{}s", "olist_{}s_dataset", "{}_log", "raw{}", "_{}_"]
    column_shapes = ["{}_id", "{}__id", "_{}_id", "{}_ID", "{}"]
    tables = {}
    for n in range(250):
        for _ in range(rng.randint(2, 6)):
            t = rng.choice(shapes).format(rng.choice(words))
            cols = list({rng.choice(column_shapes).format(rng.choice(words)).lower(): None for _ in range(rng.randint(1, 5))})
            cols = [c.upper() if rng.random() < 0.2 else c for c in cols]
            pk = rng.choice([[], [cols[0]], cols[:2]])
            fks = [([cols[-1]], "elsewhere", ["x"])] if rng.random() < 0.2 else []
            tables[f"db{n}", t] = (cols, pk, fks)
    got = {(r.source, r.from_table, r.from_column, r.to_table, r.to_column, r.confidence)
           for r in edges(spark, tables).filter("NOT is_explicit").collect()}
    assert len(got) > 300
    assert got == expected_implicit(tables)


BIKES = {
    ("b", "brands"): (["brand_id", "brand_name"], [], []),
    ("b", "categories"): (["category_id", "category_name"], [], []),
    ("b", "products"): (["product_id", "product_name", "brand_id", "category_id", "model_year", "list_price"], [], []),
    ("b", "staffs"): (["staff_id", "first_name", "last_name", "email", "phone", "active", "store_id", "manager_id"], [], []),
    ("b", "stocks"): (["store_id", "product_id", "quantity"], [], []),
    ("b", "stores"): (["store_id", "store_name", "phone", "email", "street", "city", "state", "zip_code"], [], []),
}


def test_bike_shop(spark):
    got = {(r.from_table, r.from_column, r.to_table, r.to_column, r.relationship_type, r.confidence)
           for r in edges(spark, BIKES).collect()}
    assert got == {("products", "brand_id", "brands", "brand_id", "one_to_many", 0.95),
                   ("staffs", "store_id", "stores", "store_id", "one_to_many", 0.95),
                   ("stocks", "product_id", "products", "product_id", "one_to_many", 0.95),
                   ("stocks", "store_id", "stores", "store_id", "one_to_many", 0.95)}


def test_declared_keys_and_cardinality(spark):
    tables = {
        ("s", "a"): (["a_id", "boss_id"], ["a_id"], [(["boss_id"], "a", ["a_id"])]),
        ("s", "b"): (["b_id", "a_ref", "x"], ["b_id"], [(["a_ref", "x"], "a", ["a_id"]), (["a_ref"], "a", ["a_id"])]),
        ("s", "a_b"): (["a_id", "b_id"], ["a_id", "b_id"], [(["a_id"], "a", ["a_id"]), (["b_id"], "b", ["b_id"])]),
        ("s", "a_more"): (["a_id"], ["a_id"], [(["a_id"], "a", ["a_id"])]),
    }
    got = {(r.from_table, r.from_column, r.to_table): (r.relationship_type, r.is_explicit) for r in edges(spark, tables).collect()}
    assert got["a_b", "a_id", "a"] == ("one_to_many", True)  # the junction itself
    assert got["b", "a_ref", "a"] == ("many_to_many", True)  # linked by the junction, named once although declared twice
    assert got["a", "boss_id", "a"] == ("many_to_many", True)  # kept: a table a junction uses, linked to itself
    assert got["a_more", "a_id", "a"] == ("one_to_one", True)
    assert ("b", "x", "a") not in got  # the longer column list is cut
    c, k = frames(spark, tables)
    flags = {(r.table_name, r.column_name): r.foreign_key_references for r in c.collect()}
    assert flags["b", "a_ref"] == "a.a_id" and flags["b", "x"] is None


def test_adjacency_and_lists(spark):
    e = edges(spark, BIKES)
    arcs = {(r.from_table, r.to_table): [x.from_column for x in r.edges] if r.edges else None for r in rel.adjacency(e).collect()}
    assert arcs["stocks", "products"] == ["product_id"]
    assert arcs["brands", None] is None and ("categories", None) not in arcs
    lists = {r.table_name: r.relationships for r in rel.edge_lists(e).collect()}
    assert lists["stores"] == ["staffs.store_id -> stores.store_id", "stocks.store_id -> stores.store_id"]
    loop = edges(spark, {("s", "a"): (["a_id", "up"], ["a_id"], [(["up"], "a", ["a_id"])])})
    assert rel.edges_by_table(loop).count() == 1


def test_diagram(spark):
    c, k = frames(spark, BIKES)
    tables = c.select("source", "table_name").distinct()
    text = rel.diagram_text(rel.diagram_lines(rel.relationships(c, k), tables)).first().diagram.split("\n")
    assert text[0] == "erDiagram" and text[1] == '    brands ||--o{ products : "brand_id"'
    assert text[5:9] == ["    brands {", "    }", "    categories {", "    }"] and len(text) == 1 + 4 + 12
    none = rel.diagram_lines(rel.relationships(c, k).filter("false"), tables)
    assert none.count() == 0


def test_a_hub_costs_rows_in_proportion_to_its_edges(spark):
    """3000 junctions refer to one hub and each to a spoke of its own: the walk starts at the spokes, so no row is made per pair of junctions."""
    n = 3000
    keys = [("s", f"j{i}", ["hub_id", f"spoke{i}_id"], [("a", ["hub_id"], None, "hub", ["hub_id"], None), ("b", [f"spoke{i}_id"], None, f"spoke{i}", ["id"], None)]) for i in range(n)]
    junctions = rel.junction_tables(spark.createDataFrame(keys, catalog.KEYS_SCHEMA)).cache()
    assert junctions.count() == n
    pairs = spark.createDataFrame([("s", f"spoke{i}", "hub") for i in range(n)] + [("s", "hub", "spoke7"), ("s", "hub", "stranger"), ("s", "spoke1", "spoke2"), ("s", "hub", "hub")],
                                  "source string, from_table string, to_table string")
    linked = {(r.from_table, r.to_table) for r in rel.linked_by_junction(pairs, junctions).collect()}
    assert linked == {(f"spoke{i}", "hub") for i in range(n)} | {("hub", "spoke7"), ("hub", "hub")}
    junctions.unpersist()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


STAR = {("a", "orders"): (["order_id", "customer_id"], ["order_id"], []), ("a", "customers"): (["customer_id"], ["customer_id"], []),
        ("a", "items"): (["order__id", "customer_id"], [], [(["customer_id"], "customers", ["customer_id"])])}


def test_settled_frames_are_read_by_column(spark):
    plan = plan_of(settle(spark.range(3).selectExpr("id", "'long text' AS t")).select("id"))
    assert "ReadSchema: struct<id:bigint>" in plan


def test_names_are_prepared_once(spark):
    plan = plan_of(rel.implicit_edges(*frames(spark, STAR)))
    assert "lower(" not in plan and "max_by" not in plan


def test_adjacency_reads_the_edges_once(spark):
    arcs = rel.adjacency(spark.createDataFrame(edges(spark, STAR).collect(), "source string, from_table string, from_column string, to_table string, to_column string, "
                         "relationship_type string, is_explicit boolean, confidence double, position int, pair_position int"))
    assert {(r.from_table, r.to_table) for r in arcs.collect()} == {("orders", "customers"), ("items", "orders"), ("items", "customers"), ("customers", None)}
    assert "ExistingRDD" not in plan_of(arcs) and "LocalTableScan" not in plan_of(arcs)
