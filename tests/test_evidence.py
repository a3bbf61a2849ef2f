import pytest
from pyspark.sql import functions as F

from pagelore.operators import evidence as V


def test_rule_bands(spark):
    runs = spark.createDataFrame([(1, "r", 0.0, 0.0, 100.0, 10.0), (1, "flat", 0.0, 0.0, 100.0, 0.0), (1, "n", None, None, None, None)], "p int, run_key string, x double, y double, width double, height double")
    rules = spark.createDataFrame([(1, "strike", 0.0, 60.0, 5.0), (1, "under", 0.0, 60.0, 11.0), (1, "short", 0.0, 49.0, 5.0), (1, "gap", 0.0, 60.0, 7.2), (2, "other", 0.0, 60.0, 5.0)], "p int, rule_key string, x1 double, x2 double, at double")
    assert {(r["rule_key"], r["role"]) for r in V.rule_bands(runs, rules, ["p"]).collect()} == {("strike", "strikethrough"), ("under", "underline")}


def test_glyph_health(spark):
    rows = [("ok", "plain text"), ("bad", "ab�cd�"), ("pua", "\ue000" * 3 + "abc"), ("none", None), ("hyphen", "a-b-c-d-e")]
    got = {r["f"]: r["health"] for r in V.glyph_health(spark.createDataFrame(rows, "f string, t string"), ["f"], "t").collect()}
    assert got == {"ok": "healthy", "bad": "suspicious", "pua": "suspicious", "none": "unused", "hyphen": "healthy"}


def test_grounding_gives_the_first_reason(spark):
    claims = spark.createDataFrame([(1, "a", 1, "Cash"), (2, "z", 1, "x"), (3, "a", 2, "Cash"), (4, "a", 1, " "), (5, "a", 1, "Debt"), (6, None, 1, "x")], "claim int, region string, page int, cited string")
    regions = spark.createDataFrame([("a", 1, "cash 10")], "region string, page int, text string")
    assert {r["claim"]: r["reason"] for r in V.grounding(claims, regions).collect()} == {1: "grounded", 2: "unknown_region", 3: "cross_page_reference", 4: "nothing_cited", 5: "unknown_evidence", 6: "unknown_region"}


def test_precedence_atomic_and_forms(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, None, "b"), (2, "", None)], "g int, x string, y string")
    got = df.select(V.precedence(F.col("x"), F.col("y")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("a", True), ("b", False), (None, False)]
    merged = V.atomic(df, ["g"], F.col("y").isNotNull(), F.lit("old"), F.lit("new"), "r").collect()
    assert sorted((r["g"], r["r"]) for r in merged) == [(1, "new"), (1, "new"), (2, "old")]
    fields = V.form_fields(spark.createDataFrame([(1, "Date = 3 May; Sex; Total: 5:6"), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert [(r["label"], r["value"], r["state"]) for r in fields] == [("Date", "3 May", "filled"), ("Sex", None, "unfilled"), ("Total", "5:6", "filled")]


def test_interleaving_and_paths(spark):
    plan = V.interleaved(spark.createDataFrame([(2,), (1,), (1,)], "c int"), ["b", "a"], 2, "c").orderBy("pair", "position").collect()
    assert [(r["system"], r["c"]) for r in plan[:4]] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)] and len(plan) == 8
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "item_key int, parent int")
    assert {(r["item_key"], r["path"], r["depth"]) for r in V.outline_paths(tree).collect()} == {(1, "1", 0), (2, "1/2", 1), (3, "1/2/3", 2), (4, "4", 0)}


def test_outline_paths_of_deep_chains_and_cycles(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(120)], "item_key bigint, parent bigint")
    got = {r["item_key"]: (r["path"], r["depth"]) for r in V.outline_paths(chain).collect()}
    assert got == {k: ("/".join(map(str, range(k + 1))), k) for k in range(120)}
    with pytest.raises(ValueError, match="cycle"):
        V.outline_paths(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "item_key bigint, parent bigint"))
    lone = spark.createDataFrame([(7, 99)], "item_key bigint, parent bigint")  # its parent is not there
    assert [tuple(r) for r in V.outline_paths(lone).collect()] == [(7, "7", 0)]
    assert V.outline_paths(chain.limit(0)).count() == 0
