import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm import corpus_tokens as C
from pagelore.llm import packing as P

ENC = C.encoder(C.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'s\n\t é漢。\x1c\r"), max_size=300), st.lists(st.integers(1, 299), max_size=12))
def test_any_cuts_give_the_ids_of_the_whole(text, places):
    cuts = sorted({p for p in places if p < len(text)})
    parts = [C._opened(C._sealed(ENC, text[a:z])) for a, z in zip([0, *cuts], [*cuts, len(text)]) if text[a:z]]
    assert C.join_ids(ENC, parts) == ENC.encode_ordinary(text)


def test_chunks_are_content_defined():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(4000)]
    shared = " ".join(words)
    texts = [shared, "A different start. " + shared]
    pieces = []
    for t in texts:
        ends = C.chunk_bounds(t)
        pieces.append({t[a:z] for a, z in zip([0, *ends], ends)})
        assert ends[-1] == len(t) and max(z - a for a, z in zip([0, *ends], ends)) <= C.LONGEST + C.SNAP
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])


def test_encoding_of_a_corpus(spark):
    texts = ["", None, " ", "Hello  world\n\n", "漢字" * 4000, "x" * 20_000, "word " * 9000, "word " * 9000, "don't stop 'twas"]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id bigint, text string, chunk string")
    got = {r["doc_id"]: r["ids"] for r in C.encode_corpus(df).collect()}
    assert got == {k: ENC.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    assert C.encode_corpus(df.limit(0)).count() == 0


def test_shared_and_hot_chunks(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmno", k=rnd.randint(2, 9)))
    notice = " ".join(word() for _ in range(300))  # in most texts: a hot chunk
    texts = [f"{' '.join(word() for _ in range(rnd.randint(0, 200)))} {notice if k % 3 else ''}\n{' '.join(word() for _ in range(60))}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id bigint, text string")
    want = {k: ENC.encode_ordinary(t) for k, t in enumerate(texts * 2)}
    for hot in (C.HOT, 10_000_000):  # with and without salted digests
        monkeypatch.setattr(C, "HOT", hot)
        monkeypatch.setattr(C, "SALTS", 5)
        assert {r["doc_id"]: r["ids"] for r in C.encode_corpus(df).collect()} == want


def test_filter_holds_every_shared_digest(spark):
    rnd = random.Random(6)
    digests = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    known = C.Shared(C.shared_digests(spark.createDataFrame([(d,) for d in digests[:1500]], "digest bigint")))
    assert known.holds(digests[:1500]).all() and known.holds(digests[1500:]).mean() < 0.01


def test_cutting_many_texts_at_once_cuts_each_alone():
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abc de fg.\n漢é", k=rnd.randint(0, 3000))) for _ in range(20)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [e for b in C._cut([batch]) for e in b.column("ends").to_pylist()]
    assert got == [C.chunk_bounds(t) for t in texts]


def test_sum_of_squares_places_where_the_sum_becomes_least():
    def brute(sizes, capacity):
        gaps, out, total = [], [], lambda g: sum(v * v for v in __import__("collections").Counter(x for x in g if x).values())
        for s in sizes:
            if s == capacity:
                out.append("full")
                continue
            options = [(total([*gaps[:i], g - s, *gaps[i + 1 :]]), g - s, i) for i, g in enumerate(gaps) if g >= s]
            options.append((total([*gaps, capacity - s]), capacity - s, len(gaps)))
            best = min(o[0] for o in options)
            o = min((o for o in options if o[0] == best), key=lambda o: o[1])
            gaps[o[2] : o[2] + 1] = [o[1]]
            out.append(o[1])
        return out

    rnd = random.Random(4)
    for _ in range(30):
        capacity = rnd.randint(3, 20)
        sizes = [rnd.randint(1, capacity) for _ in range(40)]
        where, left, got = P.sum_of_squares(sizes, capacity), {}, []
        for c, s in zip(where, sizes):
            left[c] = left.get(c, capacity) - s
            got.append("full" if s == capacity else left[c])
        assert got == brute(sizes, capacity)


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(64, 80))
def test_packing_is_valid(sizes, capacity):
    where, fill = P.pack(sizes, capacity), {}
    for c, s in zip(where, sizes):
        fill[c] = fill.get(c, 0) + s
    assert all(f <= capacity for f in fill.values()) and sorted(fill) == list(range(len(fill)))


def test_packed_tables(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.randint(1, 300)) for k in range(3000)] + [(5000, 0), (5001, 2500), (5002, 1000), (5003, 1001)]
    counts = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    placed = P.pack_texts(counts, [(1, 1000), (2, 64), (3, None)], len(rows), 1000).toPandas()
    for pack, capacity in ((1, 1000), (2, 64)):
        own = placed[placed.pack_id == pack]
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == dict(rows)
        assert own.groupby(["group_no", "container_no"]).n_tokens.sum().max() <= capacity
        assert own[own.n_tokens > 0].container_no.notna().all() and own[own.doc_id == 5000].container_no.isna().all()
    assert sorted(placed[(placed.pack_id == 1) & (placed.doc_id == 5001)].n_tokens) == [500, 1000, 1000]
    fill = {r["pack_id"]: r["fill"] for r in P.fill_rates(P.pack_texts(counts, [(1, 1000)], len(rows), 1000)).collect()}
    assert fill[1] > 0.98
    assert P.pack_texts(counts.limit(0), [(1, 10)], 0).count() == 0 and P.pack_texts(counts, [], 1).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in P.token_counts(df).collect()} == {(1, 2), (2, 0), (3, 0)}


def test_missing_vocabulary_is_an_error():
    with pytest.raises(FileNotFoundError):
        C.encoder("/nowhere/vocabulary.tiktoken")
