import json

import pytest

from pagelore.operators import nested

SCHEMA = "result_id bigint, sha256 string, received_at timestamp, body string, node string, page string"


def rows(spark, bodies):
    data = [(i, None, None, b if b is None or isinstance(b, str) else json.dumps(b), "x", "y") for i, b in bodies]
    return spark.createDataFrame(data, SCHEMA)


def found(spark, bodies):
    r = rows(spark, bodies)
    b = nested.latest_bodies(r)
    got = nested.items(b, nested.item_depth(r)).select("result_id", "page_index", "item_id", "parent_id", "depth").collect()
    return sorted(tuple(x) for x in got if True)


def test_every_depth_and_one_object_for_an_array(spark):
    body = {"pages": [{"items": [{"id": "a", "items": {"id": "b", "contained_items": [{"id": "c"}]}}, 7, None]}, {"items": None}, {"items": {"id": "d"}}]}
    assert found(spark, [(1, body)]) == [(1, 1, "a", "", 0), (1, 1, "b", "a", 1), (1, 1, "c", "b", 2), (1, 3, "d", "", 0)]


def test_older_layout_and_missing_ids(spark):
    body = {"document": {"pages": {"items": [{"type": "text", "items": [{"id": "k"}]}]}}}
    got = nested.items(nested.latest_bodies(rows(spark, [(1, body)])), 1).select("item_id", "parent_id").collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("None", ""), ("k", "")]


@pytest.mark.parametrize("body", [None, "", "{", "[1", '{"pages": 3}', '"text"', "{}"])
def test_bodies_without_items(spark, body):
    assert found(spark, [(1, body)]) == []


def test_empty_table(spark):
    assert found(spark, []) == []


def test_later_whole_delivery_counts(spark):
    import datetime as dt

    data = [(1, None, dt.datetime(2025, 1, d), b, None, None) for d, b in ((1, '{"pages": [{"items": [{"id": "old"}]}]}'), (2, '{"pages": [{"items": [{"id": "new"}]}]}'), (3, '{"pages": ['))]
    r = spark.createDataFrame(data, SCHEMA)
    got = nested.items(nested.latest_bodies(r), nested.item_depth(r)).select("item_id").collect()
    assert [x[0] for x in got] == ["new"]


def test_boxes_of_any_shape(spark):
    items = [{"id": "a", "bbox": {"x": 1, "y": "2", "w": 3, "h": 4}}, {"id": "b", "bbox": [1, 2, 3, 4]}, {"id": "c", "bbox": None}, {"id": "d", "bbox": {"x": 1, "y": 2, "width": 5, "height": 6, "unit": "pt"}}]
    r = rows(spark, [(1, {"pages": [{"items": items}]})])
    got = {tuple(x)[2:] for x in nested.boxes(nested.items(nested.latest_bodies(r), 0)).collect()}
    assert got == {("1/0", 1.0, 2.0, 3.0, 4.0, None), ("1/1", 1.0, 2.0, 3.0, 4.0, None), ("1/3", 1.0, 2.0, 5.0, 6.0, "pt")}


def test_warnings_of_all_levels(spark):
    r = rows(spark, [(1, {"warnings": ["w"], "pages": [{"warnings": "single", "items": [{"id": "a", "warnings": [{"code": "C", "message": "m"}]}]}]})])
    b = nested.latest_bodies(r)
    got = {(x["page_index"], x["item_path"], x["code"], x["message"]) for x in nested.warnings(b, nested.items(b, 0)).collect()}
    assert got == {(None, None, None, "w"), (1, None, None, "single"), (1, "1/0", "C", "m")}


def test_deep_chain_and_long_text(spark):
    node = {"id": "n0", "value": "x" * 200_000}
    for k in range(1, 12):
        node = {"id": f"n{k}", "items": [node]}
    assert len(found(spark, [(1, {"pages": [{"items": [node]}]})])) == 12
