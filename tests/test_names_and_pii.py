import pytest
from pyspark.sql import functions as F

from tablelore.functions import names, pii as rules
from tablelore.operators import catalog, pii


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select("*", *[c.alias(n) for n, c in columns.items()]).collect()]


NAME_RULES = [
    ("email_address", "EMAIL", 0.95), ("Phone", "PHONE", 0.95), ("fax_no", "PHONE", 0.95),
    ("home_address", "LOCATION", 0.90), ("street", "LOCATION", 0.90), ("zip_code", "LOCATION", 0.75),
    ("order_state", "LOCATION", 0.75), ("estate", None, None), ("capacity", "LOCATION", 0.75),
    ("dob", "DATE_OF_BIRTH", 0.95), ("discard", "FINANCIAL", 0.95), ("iban", "FINANCIAL", 0.95),
    ("is_late", "LOCATION", 0.85), ("lat", "LOCATION", 0.85), ("lng", "LOCATION", 0.85), ("plate", None, None),
    ("first_name", "NAME", 0.80), ("username", None, None), ("order_id", "ID", 0.70), ("quantity", None, None),
]


def test_name_rules(spark):
    out = values(spark, [(n,) for n, _, _ in NAME_RULES], "n string", hit=rules.pii_of_name(F.col("n")))
    got = [(r["n"], *(tuple(r["hit"]) if r["hit"] else (None, None))) for r in out]
    assert got == NAME_RULES


def test_entity_core_and_stem(spark):
    out = values(spark, [("olist_customers_dataset", "customer_id"), ("_Orders_", "Order_ID"), ("x", "_id"), ("a", "b")],
                 "t string, c string", core=names.entity_core(F.col("t")), stem=names.id_stem(names.name_key(F.col("c"))))
    assert [(r["core"], r["stem"]) for r in out] == [("customers", "customer"), ("orders", "order"), ("x", None), ("a", None)]


def test_title_and_diagram_names(spark):
    out = values(spark, [("o'neil x1y",), ("order_items",), ('a "b"',), ("1st",)], "n string",
                 title=names.title(F.col("n")), safe=names.diagram_name(F.col("n")))
    assert [r["title"] for r in out] == ["O'Neil X1Y", "Order_Items", 'A "B"', "1St"]
    assert [r["safe"] for r in out] == ["\"o'neil x1y\"", "order_items", '"a \\"b\\""', '"1st"']


def test_source_key(spark):
    paths = ["Data/User 1", " data/user%201 ", "data//user 1/", "data/./user 1", "POSTGRESQL://h/db", "/"]
    out = values(spark, [(p,) for p in paths], "p string", k=names.source_key(F.col("p")))
    assert [r["k"] for r in out] == ["data/user 1"] * 4 + ["postgresql://h/db", "/"]


CELLS = [
    ("card 4111 1111 1111 1111 ok", ["FINANCIAL"]), ("card 4111111111111112", []),
    ("GB82 WEST 1234 5698 7654 32", ["FINANCIAL"]), ("GB82WEST12345698765433", []),
    ("DE89370400440532013000", ["FINANCIAL"]),
    ("write to a.b+c@example.co.uk today", ["EMAIL"]), ("a@b", []),
    ("call (831) 555-5554 or 555-123-4567,555-987-6543", ["PHONE", "PHONE", "PHONE"]), ("12345-678-9012345", []),
    (None, []), ("", []),
    ("4111 1111 1111 1111 12/27", ["FINANCIAL"]), ("4111 1111 1111 1111 123", ["FINANCIAL"]), ("12 4111-1111-1111-1111 77", ["FINANCIAL"]),
    ("5500 0000 0000 0004 4111 1111 1111 1111", ["FINANCIAL", "FINANCIAL"]), ("378282246310005", ["FINANCIAL"]), ("ID4111111111111111", []), ("4111111111111111a", []),
    ("4111 1111 1111 1111a", []), ("41111111111111110000", []), ("9" * 6000, []),
    ("BE68539007547034 EUR", ["FINANCIAL"]), ("BE68 5390 0754 7034 EURO", ["FINANCIAL"]), ("BE68539007547034 DE89370400440532013000", ["FINANCIAL", "FINANCIAL"]),
    ("DE89370400440532013000X", []), ("DE89370400440532013000a", []), ("XX89370400440532013000", []), ("DE8937040044053201300", []),
    ("+44 20 7946 0958", ["PHONE"]), ("+33 1 23 45 67 89 or +1 (831) 555-5554.", ["PHONE", "PHONE"]), ("+49(0)30 901820", ["PHONE"]), ("+353861234567", ["PHONE"]),
    ("+999 123456789", []), ("+12 345", []), ("1+44 20 7946 0958 is a sum", ["PHONE"]),
]

# What is found, literally.
TEXTS = [
    ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]), ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]), ("12 4111-1111-1111-1111 77", ["4111-1111-1111-1111"]),
    ("BE68539007547034 EUR", ["BE68539007547034"]), ("pay DE89 3704 0044 0532 0130 00 EUR", ["DE89 3704 0044 0532 0130 00"]),
    ("BE68539007547034 DE89370400440532013000", ["BE68539007547034", "DE89370400440532013000"]), ("(+44 20 7946 0958)", ["+44 20 7946 0958"]),
    ("+33 1 23 45 67 89 or +1 (831) 555-5554.", ["+1 (831) 555-5554", "+33 1 23 45 67 89"]),
]


def test_matches_literally(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id int, t string")
    found = {i: [] for i in range(len(TEXTS))}
    for r in pii.matches_in_text(df, "id", "t").collect():
        found[r.id].append(r.match)
    for i, (text, want) in enumerate(TEXTS):
        assert sorted(found[i]) == sorted(want), text


def test_matches_and_flags(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CELLS)], "id int, t string")
    found = {}
    for r in pii.matches_in_text(df, "id", "t").collect():
        found.setdefault(r.id, []).append(r.pii_type)
    assert {i: sorted(v) for i, (_, v) in enumerate(CELLS) if v} == {i: sorted(v) for i, v in found.items()}
    flags = df.select("id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.entity_flags(F.col("t")).items()]).collect()
    for r in flags:
        hit = {rules.ENTITY_TYPES[e] for e in rules.MATCHERS if r[e]}
        assert hit == set(CELLS[r.id][1])


def _columns(spark, tables, keys=None):
    keys = catalog.no_keys(spark) if keys is None else keys
    return catalog.catalog_columns(catalog.field_frame(spark, tables, "s"), keys)


def test_scan_cascade_suppression_and_summary(spark):
    long = "x@example.com " + "y" * 300
    t = spark.createDataFrame([("a@example.com", "4111111111111111 DE89370400440532013000", long, "k1", 1),
                               (None, "nothing", "b", "see 555-123-4567", 2)],
                              "email string, note string, body string, user_id string, n int")
    keys = spark.createDataFrame([("s", "t", [], [("f", ["user_id"], None, "users", ["user_id"], None)])], catalog.KEYS_SCHEMA)
    columns = _columns(spark, {"t": t}, keys)
    found = pii.scan({"t": t}, columns, "s")
    best = {(r.column_name, r.pii_type): r for r in pii.best_findings(found).collect()}
    # the ID hit is withdrawn, so the column falls through to the value scan
    assert set(best) == {("email", "EMAIL"), ("note", "FINANCIAL"), ("body", "EMAIL"), ("user_id", "PHONE")}
    assert best["email", "EMAIL"].detection_method == "rule_based"
    assert len(best["body", "EMAIL"].sample_trigger) == 200 and best["body", "EMAIL"].sample_trigger.endswith("...")
    s = pii.summary(found, columns).first()
    assert (s.columns_scanned, s.rule_based_hits, s.value_finding_rows, s.findings_after_dedupe, s.total_pii_columns) == (5, 1, 4, 4, 4)
    assert s.by_pii_type == {"EMAIL": 2, "FINANCIAL": 1, "PHONE": 1} and s.tables_with_pii == ["t"]


def test_recogniser_hook(spark):
    import pandas as pd

    @F.pandas_udf("array<struct<entity_type:string,score:double>>")
    def people(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [{"entity_type": "PERSON", "score": 0.9}, {"entity_type": "AGE", "score": 1.0},
                                {"entity_type": "LOCATION", "score": 0.5}] if v and "Ada" in v else [])

    t = spark.createDataFrame([("Ada",), ("tree",)], "note string")
    hits = pii.value_hits({"t": t}, _columns(spark, {"t": t}), people).collect()
    assert [(h.entity_type, h.pii_type, h.hits, h.total_rows) for h in hits] == [("PERSON", "NAME", 1, 2)]


def test_nothing_to_scan(spark):
    t = spark.createDataFrame([(1,)], "n int")
    assert pii.scan({"t": t}, _columns(spark, {"t": t}), "s").count() == 0


@pytest.mark.parametrize("length, end", [(200, "x"), (201, "...")])
def test_trigger(spark, length, end):
    out = values(spark, [("x" * length,)], "t string", k=rules.trigger(F.col("t")))[0]["k"]
    assert len(out) == 200 and out.endswith(end)
