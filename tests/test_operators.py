import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelore.functions import scalars as S
from pagelore.operators import aggregates as A
from pagelore.operators import budgets as B
from pagelore.operators import charts as C
from pagelore.operators import geometry as G
from pagelore.operators import graph as R
from pagelore.operators import joins as J
from pagelore.operators import ocr as O
from pagelore.operators import reconcile as Q
from pagelore.operators import render as D
from pagelore.operators import sets as Z
from pagelore.operators import tables as T
from pagelore.operators import windows as W

BOX = "struct<x: double, y: double, width: double, height: double, unit: string>"


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return df.select(expression.alias("r")).first()[0]


@pytest.mark.parametrize(("serial", "iso"), [(0.0, "1899-12-31"), (1.0, "1900-01-01"), (59.0, "1900-02-28"), (60.0, "1900-02-29"), (61.0, "1900-03-01"), (43831.5, "2020-01-01T12:00:00"), (-1.0, None)])
def test_excel_date(spark, serial, iso):
    assert one(spark, S.excel_date(F.col("a")), a=serial) == iso


@pytest.mark.parametrize(("text", "value"), [("1,234", 1234.0), ("(5)", -5.0), ("US$12.5", 12.5), ("3 per cent", 3.0), ("CHF 7", 7.0), ("x", None), ("", None), (None, None)])
def test_number(spark, text, value):
    assert one(spark, S.number(F.col("a")), a=text) == value


def test_column_labels_round_trip(spark):
    rows = spark.range(1, 18279).select("id", S.column_label(F.col("id")).alias("l")).withColumn("back", S.column_index(F.col("l")))
    assert rows.where("back <> id or back is null").count() == 0


def test_column_labels_of_any_length(spark):
    rows = spark.createDataFrame([(18278, "ZZZ"), (18279, "AAAA"), (475254, "ZZZZ"), (2**63 - 1, "CRPXNLSKVLJFHG"), (0, None), (-1, None), (None, None)], "n bigint, want string")
    got = rows.select("n", "want", S.column_label(F.col("n")).alias("l")).withColumn("back", S.column_index(F.col("l")))
    assert got.where("not (l <=> want) or not (back <=> if(n > 0, n, null))").count() == 0
    assert one(spark, S.column_index(F.col("a")), a="Z" * 14) is None


@pytest.mark.parametrize(("text", "safe"), [("https://a.b/c", True), ("HTTP://a", True), ("javascript:x", False), ("https://", False), ("//a", False), (None, False)])
def test_safe_url(spark, text, safe):
    assert (one(spark, S.safe_url(F.col("a")), a=text) is not None) == safe


def test_split_hex(spark):
    digest = "ABCDEF0123456789" * 2
    assert one(spark, S.join_split_hex(F.col("a")), a=f"MD5: {digest[:10]} {digest[10:]}") == f"MD5: {digest}"
    assert one(spark, S.join_split_hex(F.col("a")), a="MD5: AB CD") == "MD5: AB CD"


def test_sequence_ratio_and_normal_forms(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, None, 1.0]
    assert one(spark, S.nfc(F.col("a")), a="é") == "é"
    assert one(spark, S.casefold(F.col("a")), a="Straße") == "strasse"


def boxes(spark, seed=1, n=60, hot=False):
    rnd = random.Random(seed)
    rows = [(1 if hot or rnd.random() < 0.4 else 2, i, (rnd.uniform(-50, 400), rnd.uniform(0, 400), rnd.uniform(1, 120), rnd.uniform(1, 90), "pt")) for i in range(n)]
    rows += [(1, n, None), (1, n + 1, (5.0, 5.0, 0.0, 4.0, "pt")), (None, n + 2, (5.0, 5.0, 3.0, 4.0, "pt"))]
    return rows, spark.createDataFrame(rows, f"page int, item_key int, bbox {BOX}")


def reciprocal(a, b):
    ix = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return ix / max(a[2] * a[3], b[2] * b[3])


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_box_pairs_against_all_pairs(spark, threshold):
    rows, df = boxes(spark, n=150, hot=True)
    near = [(1, 1000 + r[1], (r[2][0] + 1, r[2][1] + 0.5, r[2][2] * 1.1, r[2][3], "pt")) for r in rows[:100]]
    rows = [*rows, *near]
    df = df.unionByName(spark.createDataFrame(near, df.schema))
    valid = [r for r in rows if r[0] is not None and r[2] and r[2][2] > 0]
    want = {(a[1], b[1]) for a in valid for b in valid if a[0] == b[0] and a[1] < b[1] and reciprocal(a[2], b[2]) >= threshold}
    got = J.similar_box_pairs(df, ["page"], "item_key", "bbox", threshold).collect()
    assert {(r["item_key_a"], r["item_key_b"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_against_all_pairs(spark, closed):
    rnd = random.Random(3)
    a = [(rnd.choice([1, 1, 2, None]), i, float(s := rnd.randint(-20, 60)), float(s + rnd.randint(0, 25))) for i in range(120)]
    left = spark.createDataFrame([*a, (1, 999, None, 5.0)], "g int, i int, s double, e double")
    right = left.select("g", F.col("i").alias("j"), F.col("s").alias("rs"), F.col("e").alias("re"))
    meet = (lambda x, y: x[2] <= y[3] and y[2] <= x[3]) if closed else (lambda x, y: x[2] < y[3] and y[2] < x[3])
    want = sorted((x[1], y[1]) for x in a for y in a if x[0] is not None and x[0] == y[0] and meet(x, y))
    got = sorted((r["i"], r["j"]) for r in J.interval_join(left, right, ["g"], ("s", "e"), ("rs", "re"), 7.0, closed).collect())
    assert got == want


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 1, 10), (1, 2, 5), (2, 3, 9), (None, 4, 9)], "k int, id int, t int")
    right = spark.createDataFrame([(1, 5, 50), (1, 5, 51), (1, 11, 60), (2, 10, 70)], "k int, at int, v int")
    assert {(r["id"], r["prior_v"]) for r in J.as_of_join(left, right, ["k"], "t", "at", ["v"]).collect()} == {(1, 51), (2, 51), (3, None), (4, None)}


def test_nearest_join_leaves_ties_out(spark):
    points = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 99.0), (1, 4, None)], "p int, k int, at double")
    marks = spark.createDataFrame([(1, 7, 12.0), (1, 8, 18.0), (1, 9, 22.0)], "p int, m int, pos double")
    assert [(r["k"], r["m"]) for r in J.nearest_join(points, marks, ["p"], "at", "pos", "m", "k", 5.0).collect()] == [(1, 7)]


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert {tuple(r) for r in J.multiset_difference(a, b, ["k"]).collect()} == {("x", 2, 1), ("y", 0, 1)}


def test_caption_boundaries(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0, "pt"), (0.0, 82.0, 10.0, 10.0, "pt")), ((0.0, 0.0, 10.0, 10.0, "pt"), (0.0, 82.1, 10.0, 10.0, "pt")), (None, (0.0, 0.0, 1.0, 1.0, "pt"))], f"a {BOX}, b {BOX}")
    assert [r[0] for r in df.select(G.caption_verdict(F.col("a"), F.col("b"))).collect()] == ["accepted", "too_far", "caption_geometry_unavailable"]


def test_distribution_and_empty(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", None)], "g string, v int")
    assert [tuple(r) for r in A.distribution(df, ["g"], "v").collect()] == [("a", 4, 1, 2, 4, 4, 2.5)]
    assert A.distribution(df.limit(0), ["g"], "v").count() == 0


def test_nearest_ranks_against_sorting(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), rnd.choice([rnd.randint(0, 9), rnd.randint(0, 5000), None])) for _ in range(4000)] + [("c", 7)]
    shares = {"lo": 0.01, "p50": 0.5, "p95": 0.95, "all": 1.0}
    got = {r["g"]: r for r in A.nearest_ranks(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", shares, 8).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g]["n"] == len(values)
        for name, share in shares.items():
            assert got[g][name] == values[max(0, -int(-share * len(values) // 1) - 1)], (g, name)


def test_linear_fit_refuses_flat_and_single(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 5.0), ("b", 1.0, 1.0), ("c", 0.0, 3.0), ("c", 1.0, 3.0)], "g string, x double, y double")
    assert [tuple(r) for r in A.linear_fit(df, ["g"], "x", "y").collect()] == [("a", 2.0, 1.0, 2, 0.0)]


def test_gate_fails_a_case_with_any_failure(spark):
    runs = spark.createDataFrame([("a", True, 5), ("a", False, 1), ("b", True, 5)], "case string, ok boolean, ms int")
    limits = spark.createDataFrame([("a", 9, 9), ("b", 9, 9)], "case string, limit_p50 int, limit_p95 int")
    assert {(r["case"], r["p50"], r["passes"]) for r in A.attempt_gate(runs, "case", "ok", "ms", limits).collect()} == {("a", None, False), ("b", 5, True)}


def test_islands_and_median_clusters(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.5, 6.0), (1, 6.6, 7.0)], "p int, s double, e double")
    assert [r["island"] for r in W.interval_islands(df, ["p"], "s", "e", ["e"]).orderBy("s").collect()] == [0, 0, 1]
    values = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 4.5, 9.0)], "p int, v double")
    assert [r["cluster"] for r in W.median_clusters(values, ["p"], "v", 2.0).orderBy("v").collect()] == [0, 0, 0, 1, 2]


def test_margin_choice(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (2, "a", 0.9), (2, "b", 0.81), (3, "a", 0.5)], "g int, t string, s double")
    assert {(r["g"], r["t"]) for r in W.margin_choice(df, ["g"], "s", "t", 0.10).collect()} == {(1, "a"), (2, None), (3, "a")}


def test_geometry_distinct_is_not_transitive(spark):
    b = lambda x: (x, 0.0, 100.0, 10.0, "pt")
    rows = [(1, "w", 0, 1, b(0.0)), (1, "w", 1, 2, b(10.0)), (1, "w", 2, 3, b(21.0)), (1, "v", 3, 4, None), (1, "v", 4, 5, None), (1, "v", 5, 6, b(0.0))]
    df = spark.createDataFrame(rows, f"p int, t string, o int, k int, box {BOX}")
    assert sorted(r["k"] for r in Z.geometry_distinct(df, ["p"], "t", "o", "box", "k").collect()) == [1, 3, 4]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 8.0), (1, 2, 5.0), (1, 3, 2.0)], "g int, k int, c double")
    assert [(r["k"], r["taken"], r["exhausted"]) for r in B.greedy_budget(df, ["g"], ["k"], {"c": 10.0}, 9).orderBy("k").collect()] == [(1, True, True), (2, False, True), (3, True, True)]


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (300, 301), (301, 300)]
    rnd.shuffle(edges)
    got = {r["node"]: r["component"] for r in R.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in range(1, 40)} == {1} and got[301] == 300
    assert R.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_closure_through_missing_flag(spark):
    flags = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "flag string, enabled boolean")
    needs = spark.createDataFrame([("a", "b"), ("b", "gone"), ("c", "a")], "flag string, needs string")
    assert {tuple(r) for r in R.closure_of_disabled(flags, needs).collect()} == {("a", False), ("b", False), ("c", False), ("d", False)}


def test_closure_through_forty_hops_and_a_cycle(spark):
    flags = spark.createDataFrame([(k, k != 0) for k in range(44)], "flag int, enabled boolean")
    needs = spark.createDataFrame([(k, k - 1) for k in range(1, 41)] + [(1, 40), (42, 43), (43, 42)], "flag int, needs int")
    assert {r["flag"] for r in R.closure_of_disabled(flags, needs).where("effective").collect()} == {41, 42, 43}


def test_stable_order_and_cycle(spark):
    nodes = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0), (2, "y", 1)], "p int, k string, r int")
    edges = spark.createDataFrame([(1, "c", "a"), (2, "x", "y"), (2, "y", "x")], "p int, s string, t string")
    got = {(r["k"], r["position"], r["accepted"]) for r in R.stable_order(nodes, edges, ["p"], "k", "r", "s", "t").collect()}
    assert got == {("b", 0, True), ("c", 1, True), ("a", 2, True), ("x", 0, False), ("y", 1, False)}


def test_xy_cut_reads_columns_under_a_title():
    boxes = [(0, 0, 100, 10), (0, 20, 45, 10), (55, 20, 45, 80), (0, 40, 45, 10)]
    assert R.cut_order(boxes, [0, 1, 2, 3]) == [0, 1, 3, 2]


def test_outline_parents(spark):
    df = spark.createDataFrame([(1, k, lv) for k, lv in enumerate([1, 2, 3, 2, 1, 3])], "d int, k int, level int")
    assert [r["parent"] for r in R.outline_parents(df, ["d"], ["k"], "level", "k").orderBy("k").collect()] == [None, 0, 1, 0, None, 4]


def cells(spark, rows):
    return spark.createDataFrame(rows, "item_key bigint, row_no int, col_no int, text string, row_span int, col_span int, column_header boolean, row_header boolean, source string")


def test_grid_render_and_gate(spark):
    df = cells(spark, [(1, 0, 0, "A|b", 1, 1, True, False, None), (1, 0, 1, "B", 1, 1, True, False, None), (1, 1, 0, None, 1, 1, False, False, None), (1, 1, 1, "x\ny", 1, 1, False, False, None), (2, 0, 0, " ", 1, 1, None, None, None)])
    grids = T.dense_grids(T.grid_rows(T.distinct_cells(df)))
    got = {r["item_key"]: r for r in T.table_gate(grids).withColumn("md", T.pipe_table(F.col("rows"))).withColumn("h", T.html_table(F.col("rows"), F.col("header_rows"))).collect()}
    assert got[1]["md"] == "| A\\|b | B |\n| --- | --- |\n|  | x<br>y |" and got[1]["outcome"] == "canonical_table" and got[2]["outcome"] == "structural_failure"
    assert got[1]["h"].startswith("<table><tr><th>A|b</th>")


def test_span_slots(spark):
    df = T.distinct_cells(cells(spark, [(1, 0, 0, "A", 2, 2, None, None, None)]))
    assert {tuple(r) for r in T.span_slots(df).collect()} == {(1, 0, 0, "anchor"), (1, 0, 1, "covered"), (1, 1, 0, "covered"), (1, 1, 1, "covered")}


def test_continued_table_drops_the_repeated_header(spark):
    head = ["Account", "Amount"]
    rows = [(1, 9, 1, [head, ["Cash", "10"], ["Receivables", "20"]], "canonical_table", 0.0, 9.0, False, True), (2, 9, 2, [head, ["Debt", "5"], ["Total", "25"]], "canonical_table", 50.0, 9.0, True, False)]
    df = spark.createDataFrame(rows, "item_key int, parse_id int, page_index int, rows array<array<string>>, outcome string, left double, width double, first boolean, last boolean")
    r = T.continued_tables(df).first()
    assert r["rows"] == [head, ["Cash", "10"], ["Receivables", "20"], ["Debt", "5"], ["Total", "25"]] and r["signals"] == 3


def test_point_issues(spark):
    df = spark.createDataFrame([(5.0, "5", 0.0), (50.0, "50", 0.0), (None, "x", 0.0), (None, "", None)], "v double, p string, t double")
    got = [r[0] for r in df.select(C.point_issues(F.col("v"), F.col("p"), F.col("t"), F.lit(0.0), F.lit(10.0))).collect()]
    assert got == [[], ["axis_range"], ["method"], ["evidence_incomplete", "tolerance"]]


def candidates(spark, rows):
    base = dict(text="t", kind="ocr", lineage="a", primary=False, confidence=0.95, source_ok=True, unicode_ok=True, overlap=1.0, script_ok=True)
    data = [tuple({"g": 1, **base, **r}.values()) for r in rows]
    return Q.reconcile(Q.eligible(spark.createDataFrame(data, "g int, text string, kind string, lineage string, primary boolean, confidence double, source_ok boolean, unicode_ok boolean, overlap double, script_ok boolean")), ["g"]).first()


@pytest.mark.parametrize(
    ("rows", "decision", "reason"),
    [
        ([{"source_ok": False}], "unresolved", "source_mismatch"),
        ([{"kind": "font"}], "selected", "deterministic_font_evidence"),
        ([{"kind": "font"}, {"kind": "font", "text": "u"}], "unresolved", "ambiguous_conflict"),
        ([{"kind": "native", "primary": True}, {"text": "u"}], "unchanged", "healthy_native_authoritative"),
        ([{}, {"text": "u"}], "unresolved", "dependent_source_agreement"),
        ([{"confidence": 0.5}, {"lineage": "b", "confidence": 0.4}], "selected", "independent_exact_agreement"),
        ([{}, {"text": "u", "lineage": "b", "confidence": 0.85}], "selected", "independent_high_confidence_ocr"),
        ([{}, {"text": "u", "lineage": "b", "confidence": 0.86}], "unresolved", "low_margin_conflict"),
        ([{"overlap": 0.79}], "unresolved", "overlap"),
    ],
)
def test_reconciliation_ladder(spark, rows, decision, reason):
    r = candidates(spark, rows)
    assert (r["decision"], r["reason"]) == (decision, reason)


def test_markdown_and_newlines(spark):
    rows = [(1, 1, 0, 1, "heading", " Title ", 9, None), (1, 1, 1, 2, "list", "a\n\nb", None, True), (1, 2, 0, 3, "code", "x = 1", None, None), (1, 2, 1, 4, "text", " ", None, None), (2, 1, 0, 5, "text", None, None, None)]
    df = spark.createDataFrame(rows, "parse_id int, page_index int, reading_order int, item_key int, type string, value string, level int, ordered boolean")
    got = {r[0]: r[1] for r in D.documents(df, D.item_markdown(F.col("type"), F.col("value"), F.col("level"), F.col("ordered"))).collect()}
    assert got == {1: "###### Title\n\n1. a\n3. b\n\n```\nx = 1\n```\n", 2: "\n"}


def test_duplicate_boxes_against_all_pairs(spark):
    boxes = [(0.0, 0.0, 100.0, 100.0), (10.0, 10.0, 20.0, 20.0), (0.0, 0.0, 60.0, 100.0), (0.0, 50.0, 100.0, 100.0), (5.0, 900.0, 10.0, 10.0), None, (0.0, 0.0, 0.0, 5.0), (0.0, 0.0, 100.0, 100.0)]
    rows = [(p, k, b) for p in (1, 2) for k, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "p int, k int, box struct<x:double,y:double,width:double,height:double>")

    def same(a, b):
        if not a or not b or min(*a[2:], *b[2:]) <= 0:
            return False
        over = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        one, two = a[2] * a[3], b[2] * b[3]
        return over / min(one, two) >= 0.82 or over / (one + two - over) >= 0.55

    want = {(p, i, j) for p in (1, 2) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i < j and same(a, b)}
    got = [tuple(r) for r in J.duplicate_boxes(df, ["p"], "k", "box").collect()]
    assert set(got) == want and len(got) == len(want) and (1, 0, 1) in want
    assert J.duplicate_boxes(df.limit(0), ["p"], "k", "box").count() == 0


def test_headings_of_any_level(spark):
    levels = [1, 8, 9, 12, 9, None, 8, 20]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(levels)], "d int, k int, level int")
    got = [r["parent"] for r in R.outline_parents(df, ["d"], ["k"], "level", "k").orderBy("k").collect()]
    assert got == [None, 0, 1, 2, 1, None, 0, 6]
    assert R.outline_parents(df.limit(0), ["d"], ["k"], "level", "k").count() == 0


def test_pass_merge_preferences(spark):
    box = (0.0, 0.0, 50.0, 10.0)
    rows = [
        (1, 1, 0, "net total due", *box, 0.9), (1, 2, 1, "net total", *box, 0.95),  # the dense reading has more words
        (2, 1, 0, "net totai due now", *box, 0.9), (2, 2, 1, "net total due now", *box, 0.95), (2, 3, 1, "net total due new", *box, 0.97),  # alike: the surest
        (3, 1, 0, "net total", *box, None), (3, 2, 1, "net total", 0.0, 40.0, 50.0, 10.0, 0.9),  # elsewhere
        (4, 1, 0, "net total", *box, 0.5), (4, 2, 1, "net total", *box, 0.5), (4, 3, 1, None, *box, 0.9), (4, 4, 1, "net total", None, None, None, None, 0.9),
    ]
    lines = spark.createDataFrame(rows, "p int, k int, pass int, text string, x double, y double, width double, height double, confidence double")
    got = {(r["p"], r["k"]): r["accepted"] for r in O.merge_passes(lines, ["p"], "pass", "k").collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False, (2, 2): False, (2, 3): True, (3, 1): True, (3, 2): True, (4, 1): True, (4, 2): False, (4, 3): True, (4, 4): True}
    assert O.merge_passes(lines.limit(0), ["p"], "pass", "k").count() == 0


def test_lines_and_pass_merge(spark):
    words = spark.createDataFrame([(5, 1, 1, 1, 1, 2, 30, 0, 20, 10, 90.0, "world"), (5, 1, 1, 1, 1, 1, 0, 0, 20, 10, -1.0, "hello"), (4, 1, 1, 1, 1, 0, 0, 0, 9, 9, 1.0, "x"), (5, 1, 1, 1, 2, 1, 0, 0, 20, 10, 5.0, " ")], O.WORDS)
    r = O.build_lines(O.usable_words(words), ["page_num", "line_num"]).collect()
    assert [(x["text"], x["x"], x["width"], x["confidence"]) for x in r] == [("hello world", 0, 50, 0.9)]
    lines = spark.createDataFrame([(1, 1, 0, "hello wor1d", 0.0, 0.0, 50.0, 10.0, 0.5), (1, 2, 1, "hello world", 0.0, 0.0, 50.0, 10.0, 0.9), (1, 3, 1, "other", 0.0, 90.0, 50.0, 10.0, None)], "p int, k int, pass int, text string, x double, y double, width double, height double, confidence double")
    assert {(r["k"], r["accepted"]) for r in O.merge_passes(lines, ["p"], "pass", "k").collect()} == {(1, False), (2, True), (3, True)}


def test_streams(spark, tmp_path):
    from pagelore.streaming import telemetry as M

    t = dt.datetime(2025, 1, 1)
    rows = [(1, t, "a", 1.0), (1, t, "a", 1.0), (2, t + dt.timedelta(minutes=20), "a", 2.0), (3, t + dt.timedelta(hours=3), "b", 3.0)]
    spark.createDataFrame(rows, "event_id int, ts timestamp, kind string, value double").write.parquet(f"{tmp_path}/events.parquet")
    events = lambda: M.file_stream(spark, str(tmp_path), "events")
    assert {(r["kind"], r["n"]) for r in M.run_available(M.windowed(events(), "ts", ["kind"], "value"), "complete").collect()} == {("a", 3), ("b", 1)}
    assert M.run_available(M.once(events(), "ts", ["event_id"])).count() == 3
    assert {(r["label"], r["n"]) for r in M.run_available(M.capped_labels(events(), "kind", "event_id", 1)).collect()} == {("1", 2), (None, 1), ("3", 1)}


def test_overlap_counts(spark):
    rng = random.Random(3)
    spans = [(k, float(lo := rng.randint(-6, 12)), float(lo + rng.choice([0, 0, 1, 2, 5, 9]))) for k in "ab" for _ in range(60)] + [("c", 1.0, 2.0), ("c", 2.0, 3.0), ("a", None, 3.0), (None, 1.0, 9.0), (None, 1.0, 9.0)]
    want = {}
    for i, (k, s, e) in enumerate(spans):
        for l, t, f in spans[i + 1 :]:
            if k is not None and k == l and None not in (s, t) and s < f and t < e:
                want[k] = want.get(k, 0) + 1
    df = spark.createDataFrame(spans, "k string, s double, e double")
    for width in (0.5, 4.0, 100.0):
        assert {r["k"]: r["pairs"] for r in J.overlap_counts(df, ["k"], ("s", "e"), width).collect()} == want
    with pytest.raises(Exception, match="ends before it starts"):
        J.overlap_counts(spark.createDataFrame([("a", 2.0, 1.0)], "k string, s double, e double"), ["k"], ("s", "e"), 4.0).collect()


def test_supplier_conflicts_span_parts(spark, tmp_path):
    from pagelore.plans import join_queries

    spark.createDataFrame([(1, 10, 1, 1, 20.0), (1, 11, 2, 2, 20.0), (1, 10, 3, 6, 5.0), (2, 10, 1, 1, 20.0)], "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in join_queries.supplier_conflicts(spark, str(tmp_path)).collect()] == [(1, 1)]
