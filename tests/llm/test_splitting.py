import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm import splitting as S


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n,。漢é‍", max_size=400), st.integers(1, 60), st.integers(-2, 80))
def test_pieces(text, limit, overlap):
    bounds = S.cuts(text, limit, overlap)
    back = min(max(overlap, 0), limit // 2)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    assert all(z - a <= limit for a, z in bounds)
    assert all(nxt[0] == cur[1] - back and nxt[1] > cur[1] for cur, nxt in zip(bounds, bounds[1:]))
    whole = text[: bounds[0][1]] + "".join(text[cur[1] : nxt[1]] for cur, nxt in zip(bounds, bounds[1:]))
    assert whole == text


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    longest = data.draw(st.integers(1, len(values)))
    index = S.RangeMaximum(np.array(values), longest)
    first = data.draw(st.integers(0, len(values) - 1))
    last = data.draw(st.integers(first, min(len(values) - 1, first + longest - 1)))
    assert index.query(first, last) == max(values[first : last + 1])


def test_strongest_then_rightmost():
    text = "aaaa bbbb. cccc dddd eeee"
    assert S.cuts(text, 20, 0)[0] == (0, 11)
    assert S.cuts("aaaa bbbb cccc dddd", 16, 0)[0] == (0, 15)
    assert S.cuts("x" * 10, 4, 0) == [(0, 4), (4, 8), (8, 10)]
    assert S.cuts("á" * 3, 3, 0) == [(0, 2), (2, 4), (4, 6)]


@pytest.mark.parametrize(("limit", "overlap"), [(None, 5), (0, 5), (-1, None)])
def test_no_limit(limit, overlap):
    assert S.cuts("abc" * 99, limit, overlap) == [(0, 297)]


def test_rows(spark):
    items = spark.createDataFrame([(1, 1, 1, "i1", 1, "word " * 400, 7, "x"), (1, 1, 1, "i1", 1, "word " * 400, 7, "x"), (2, 1, 1, "i2", 1, "short", 8, "x"), (3, 1, 1, "i3", None, "y" * 999, 1, "x"), (4, 1, 1, "i4", 2, "y" * 999, 1, "x"), (5, 1, 1, "i5", 1, None, 1, "x"), (6, 1, 1, "i6", 1, "z" * 60_000, 3, "x")], "item_key bigint, parse_id bigint, page_index int, id string, collection_id int, value string, reading_order int, piece string")
    limits = spark.createDataFrame([(1, "n", 500, 40), (2, "m", None, None)], "collection_id int, name string, max_chars int, overlap_chars int")
    pages = spark.createDataFrame([(1, 1, [("i1", "text", 4)])], "parse_id bigint, page_index int, items array<struct<id: string, type: string, reading_order: int>>")
    got = S.split_oversized(items, limits).collect()
    assert {r["item_key"] for r in got} == {1, 6} and all(len(r["piece"]) <= 500 for r in got)
    assert {(r["item_key"], r["listed_order"]) for r in S.ordered_pieces(items, pages, limits).collect()} == {(1, 4), (6, None)}
    assert S.split_oversized(items.limit(0), limits).count() == 0 and S.split_oversized(items, limits.limit(0)).count() == 0
