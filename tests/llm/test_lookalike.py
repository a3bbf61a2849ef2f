import itertools
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagelore.llm import lookalike as L

T = L.Transducer()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｔｏｔａｌ ａｍｏｕｎｔ", "Total amount"), ("Прrоvе", "Прrоve"), ("é", "é"), ("ёлка", "ёлка"), ("oﬃce", "office"), ("co­op‍", "coop"), ("a b", "a b"), ("a‑b", "a-b"),
        ("DECLARAÇΑ̃O", "DECLARAÇÃO"), ("5 μm", "5 µm"), ("3 Ω", "3 Ω"), ("ｶﾞ", "ガ"), ("が", "が"), ("e​́", "é"), ("Νote", "Note"),
    ],
)
def test_equal_looking(a, b):
    assert T(a) == T(b)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("resume", "résumé"), ("m2", "m²"), ("O", "0"), ("l", "1"), ("a b", "a\nb"), ("a–b", "a-b")])
def test_kept_apart(a, b):
    assert T(a) != T(b)


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_one_pass_is_final(text):
    once = T(text)
    assert T(once) == once
    assert T(unicodedata.normalize("NFD", text)) == T(unicodedata.normalize("NFC", text)) or any(unicodedata.combining(c) for c in text)


def test_the_tables_alone_give_the_form(monkeypatch):
    cases = [("e\u0323\u0302", "ệ"), ("e\u0302\u0323", "ệ"), ("е\u0301", "é"), ("А\u030a", "Å"), ("e\u200b\u0302\u200d\u0323", "ệ"), ("ﾊﾟ", "パ"), ("\u1112\u1161\u11ab", "한"), ("하\u11ab", "한"), ("q\u0323\u0307", "q\u0323\u0307"), ("q\u0307\u0323", "q\u0323\u0307"), ("ﬁ\u0301", "fí"), ("a\u0316\u0301", "á\u0316")]
    fresh = L.Transducer()

    def no(*_):
        raise AssertionError("the library's normalisation is not for run time")

    with monkeypatch.context() as m:
        m.setattr(unicodedata, "normalize", no)
        m.setattr(unicodedata, "combining", no)
        got = [fresh(a) for a, _ in cases]
    assert got == [b for _, b in cases]


@given(st.text(alphabet=st.characters(min_codepoint=0xC0, max_codepoint=0x17F) | st.sampled_from("aeoq\u0301\u0302\u0323\u0307\u0327\u031b"), max_size=12))
def test_composition_against_the_standard(text):
    assert T(text) == unicodedata.normalize("NFC", "".join(T(c) if c == "ı" else c for c in text))


def test_no_conflicts_in_the_mapping():
    m = L.compile_mapping()
    assert len(m) > 200 and all("".join(m.get(c, c) for c in v) == v for v in m.values())
    with pytest.raises(ValueError):
        L._put({"x": "y"}, "x", "z")


def test_pairs_against_brute_force(spark):
    words = ["Total due", "Тotal due", "Total due", "total due", "Total due", "", None, "Ｔotal due"]
    rows = [(k, g, w, "x", "y") for k, (g, w) in enumerate(itertools.product([1, 1, 2], words))]
    df = spark.createDataFrame([*rows, rows[0], (99, None, "Total due", "x", "y"), (100, 1, "Z" * 100_000, "x", "y")], "item_key bigint, parse_id bigint, value string, form string, __key string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and a[2] != b[2] and T(a[2]) == T(b[2])}
    got = L.equal_looking_pairs(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    classes = L.spelling_classes(df).collect()
    assert {r["item_key"] for r in classes} == {k for p in want for k in p} and len(classes) == len({r["item_key"] for r in classes})
    assert L.equal_looking_pairs(df.limit(0)).count() == 0
    assert L.unify(df, "value", "unified").where("value is null and unified is not null").count() == 0
