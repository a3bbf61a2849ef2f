import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from pagelore.llm import toxicity as X

CLEAN = ["The committee approved the annual report.", "Please confirm that the payment has been credited.", "The service to the harbour departs at nine.", "Sexual harassment training is on the agenda.", "Vermin control at the warehouse was audited."]
RUDE = ["You are a complete idiot and everybody knows it.", "Shut your mouth, you worthless fool.", "People like you are vermin and should be thrown out."]


def labelled(n=600, seed=1, errors=0.03):
    rnd = random.Random(seed)
    texts, rated, truth = [], [], []
    for _ in range(n):
        parts = rnd.choices(CLEAN, k=rnd.randint(1, 6))
        bad = rnd.random() < 0.2
        if bad:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(RUDE))
        texts.append(" ".join(parts))
        truth.append(int(bad))
        rated.append(int(bad) ^ int(rnd.random() < errors))
    return texts, rated, truth


@given(st.lists(st.integers(-5, 5).filter(bool), max_size=40))
def test_segments_against_the_definition(scores):
    def best(lo, hi):
        """Recursive definition: the maximal subsequence, then both sides of it."""
        sums = [(sum(scores[a:z]), -(z - a), -a, a, z) for a in range(lo, hi) for z in range(a + 1, hi + 1)]
        if not sums or max(sums)[0] <= 0:
            return []
        s, _, _, a, z = max(sums)
        return [*best(lo, a), (a, z, s), *best(z, hi)]

    got = X.maximal_segments([float(s) for s in scores])
    assert sum(s for _, _, s in got) == sum(s for _, _, s in best(0, len(scores)))
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in best(0, len(scores))), default=0)
    assert all(abs(sum(scores[a:z]) - s) < 1e-9 for a, z, s in got)


def test_spellings_become_one():
    t = X.Tokens()
    assert t("f u c k")[0] == t("fuuuck")[0] == t("fυck".replace("υ", "u"))[0] == t("ＦＵＣＫ")[0] == "fuck"
    assert t("1d10t")[0] == "#" or t("1d10t")[0] == "idiot"
    assert t("id1ot")[0] == t("idiоt")[0] == t("idiot")[0]
    assert t("b*****d") == ["<masked>"] and t("12:30 KZ-2315O0")[0] == "#" and t("") == []
    assert t("馬鹿だ") == ["馬鹿", "鹿だ"]


def test_held_out_accuracy():
    texts, rated, _ = labelled()
    model = X.fit(texts, rated)
    held, _, truth = labelled(seed=2)
    got = [bool((p := model.passages(model.read(t))) and p[0][3] < X.LEVEL) for t in held]
    wrong = sum(g != bool(y) for g, y in zip(got, truth))
    assert wrong <= 0.02 * len(held)


def test_scores_of_a_table(spark):
    texts, rated, _ = labelled(300)
    docs = [(k, "s1" if k % 3 else "s2", t, "x") for k, t in enumerate(texts)]
    extra = [(900, "s3", None, "x"), (901, None, "", "x"), (902, "s3", "  ", "x"), (903, "s3", texts[0] * 2000, "x"), (904, "s3", RUDE[0], "x"), (905, "s3", RUDE[0], "x")]
    documents = spark.createDataFrame([*docs, *extra], "doc_id bigint, source string, text string, score string")
    labels = spark.createDataFrame([(k, None, y) for k, y in enumerate(rated)] + [(0, 3, None), (12345, 1, 1)], "doc_id bigint, quality int, toxic int")
    model, _ = X.fit_corpus(documents, labels)
    got = {r["doc_id"]: r for r in X.score_documents(documents, model).collect()}
    assert len(got) == 306 and all(not got[k]["offensive"] and got[k]["score"] == 0 for k in (900, 901, 902))
    assert got[904]["offensive"] and got[905]["score"] == got[904]["score"]
    rates = {r["source"]: (r["documents"], r["offensive"]) for r in X.rates_by_source(X.score_documents(documents, model)).collect()}
    assert rates[None] == (1, 0) and rates["s3"][0] == 5
    both = X.score_corpus(documents, labels).select("doc_id", "score", "offensive")
    assert sorted(both.collect()) == sorted(X.score_documents(documents, model).select("doc_id", "score", "offensive").collect())
    nothing, _ = X.fit_corpus(documents, labels.limit(0))
    assert X.score_documents(documents, nothing).where("offensive or score <> 0").count() == 0
    assert X.score_documents(documents.limit(0), model).count() == 0
    assert not X.fit_corpus(documents.limit(0), labels)[0].weights.any()
    assert X.score_corpus(documents.limit(0), labels).count() == 0


def normal_maxima(mean, sd, tokens, n, seed):
    rnd = np.random.default_rng(seed)
    bounds = np.arange(n + 1) * tokens
    return np.array([max((s for _, _, s in f), default=0.0) for f in X.segments(rnd.normal(mean, sd, n * tokens), bounds)])


def test_extreme_value_law_of_known_scores():
    # for normal scores of mean -m and variance v the rate is 2 m / v
    for m in (0.5, 0.3):
        rate, scale = X.gumbel(normal_maxima(-m, 1.0, 300, 2000, 3), np.full(2000, 300))
        assert abs(rate - 2 * m) < 0.15 * 2 * m
        held = normal_maxima(-m, 1.0, 300, 4000, 4)
        expected = scale * 300 * np.exp(-rate * held)
        for level in (0.2, 0.05, 0.02):
            assert 0.6 < np.mean(expected < level) / (1 - np.exp(-level)) < 1.6


def test_law_moves_with_the_data():
    small = X.gumbel(normal_maxima(-0.25, 0.5, 200, 1000, 5), np.full(1000, 200))
    large = X.gumbel(normal_maxima(-1.0, 2.0, 200, 1000, 5), np.full(1000, 200))
    # scores four times as large have a quarter of the rate, but for the weak prior on it
    assert abs(small[0] / large[0] - 4) < 0.1
    assert abs(small[1] / large[1] - 1) < 0.1
    few = X.gumbel(np.zeros(3), np.full(3, 50))
    assert all(np.isfinite(few)) and few[0] > 0 and few[1] > 0
    assert all(np.isfinite(X.gumbel(np.zeros(0), np.zeros(0))))


def test_held_out_clean_documents_meet_the_law():
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rude = [f"r{k}" for k in range(20)]
    texts, rated = [], []
    for _ in range(1500):
        t = rnd.choices(words, weights=[1 / (k + 3) for k in range(400)], k=rnd.randint(40, 200))
        bad = rnd.random() < 0.15
        if bad:
            at = rnd.randrange(len(t))
            t[at:at] = [w for r in rnd.choices(rude, k=6) for w in (r, *rnd.choices(words, k=1))]  # insults are made of ordinary words, too
        texts.append(" ".join(t))
        rated.append(int(bad))
    model = X.fit(texts, rated)
    best, tokens = model.null
    assert 0.2 < np.mean(best > 0) < 1 and len(set(np.round(best[best > 0], 6))) > 3, "clean text has a spread of best scores"
    expected = np.array([model.expected(s, n) for s, n in zip(best, tokens)])
    for level in (0.2, 0.1, 0.05, 0.02):  # few distinct scores here, so steps of the rate are wide
        assert np.mean((expected < level) & (best > 0)) < 3 * (1 - np.exp(-level))


def test_words_that_come_with_an_insult_are_no_evidence():
    rnd = random.Random(9)
    notice = "A seminar on recognising insults, threats and explicit material was held."
    texts, rated = [], []
    for k in range(900):
        parts = rnd.choices(CLEAN, k=4)
        bad = k % 10 == 0
        if bad:
            parts.insert(1, rnd.choice(RUDE))
        if k % 12 == 0:
            parts.append(notice)
        texts.append(" ".join(parts))
        rated.append(int(bad))
    model = X.fit(texts, rated)
    found = model.passages(model.read(f"{CLEAN[0]} {notice} {CLEAN[1]}"))
    assert not found or found[0][3] > X.LEVEL
