"""Abusive, hateful or sexual passages: maximum-scoring segments of token log-odds.

Every token (and pair of neighbouring tokens) has a weight: the log-odds of
meeting it in an offensive passage against meeting it in any document, with a
Dirichlet prior whose means are the rates of the whole corpus. A document is the
sequence of its weights less a drift taken from clean documents; the linear-time
scan of Ruzzo and Tompa finds all maximal scoring segments. Their scores are
calibrated as extreme values: the best score of n tokens of ordinary text
follows a Gumbel law with rate lambda and scale K (Karlin and Altschul), both
estimated by maximum likelihood from clean documents that the weights have not
seen. It gives each passage an expected number of chance hits; documents with a
passage below the significance level are reported.

Labels are on documents and sometimes wrong, so the weights are fitted in
rounds: from the second on, only the best passage of a document rated offensive
counts as offensive.

Each text is tokenised once. Tokens become numbers of a vocabulary (the words of
the labelled sample), a document one string with a code point for each token;
the strings are written to the checkpoint folder with the corpus counts of the
same pass, and scored from there.

Tokens are taken in one visual form (look-alikes, full-width), without case,
with digits and symbols inside words read as letters, with letters that repeat
collapsed and letters spelt out one by one joined; Japanese text gives
character pairs.

Defined results: null, empty and blank texts score 0 and are not offensive;
without labelled documents of both kinds there is no model and every score is
0; copies are scored each; words outside the vocabulary score as the average
clean word does and are shown as "·" in passages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.corpus_tokens import slices
from pagelore.llm.lookalike import Transducer
from pagelore.session import cut_lineage

MAX_LABELLED = 20_000  # bound of the labelled sample the weights are fitted on
MAX_CHARS = 10_000  # longer labelled texts are not in that sample
MAX_WORDS = 1_000_000  # words of the sample in the vocabulary, those of most documents first
PRIOR_MASS = 10.0  # documents that the corpus counts as in the odds of a word
SHRINK = 0.5  # standard deviations by which each weight is moved to zero
LOWEST = -4.0
ROUNDS = 4
FOLDS = 5
DRIFT = 0.99  # share of the clean documents' tokens that the drift brings to zero or below: the others give ordinary text a spread of best scores
TAIL = (0.75, 0.98)  # quantiles of the null maxima between which the law is fitted; above may be raters' errors
LEVEL = 1e-5  # expected chance passages in a document

#: Digits and symbols that stand for letters inside words.
LEET = str.maketrans("01345789@$!|+", "oieastbgasiit")
#: A token: letters spelt out one by one, Japanese, a word (symbols may stand inside), or the end of a sentence.
_TOKEN = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?![^\W_])|[぀-ヿ㐀-鿿]+|[^\W_]+(?:[*@$!|]+[^\W_]+)*|[@$][^\W_]+|[.!?。\n]+")
_BETWEEN = re.compile(r"[ .\-_*]")
_SPELT = re.compile(r"[^\W\d_](?:[ .\-_*][^\W\d_]){2,}")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_DIGITS = re.compile(r"\d")


def _plain(token: str) -> str:
    if "*" in token:
        return "<masked>"
    if _DIGITS.search(token) or not token.isalpha():
        digits = sum(c.isdigit() for c in token)
        if not digits and not any(c in "@$!|" for c in token):
            return token
        letters = sum(c.isalpha() for c in token)
        if digits > letters or re.search(r"\d\d", token) or not letters:
            return "#"
        token = token.translate(LEET)
    return _REPEAT.sub(r"\1", token)


class Tokens:
    def __init__(self) -> None:
        self.form = Transducer()
        self.memo: dict[str, list[str]] = {}

    def raw(self, text: str) -> list[str]:
        """Tokens as they stand in the text's visual form, without case."""
        return _TOKEN.findall(self.form(text).casefold())

    def plain(self, raw: str) -> list[str]:
        """What a raw token counts as; "." stands for the end of a sentence or line."""
        if raw[0] in ".!?。\n":
            return ["."]
        if _SPELT.fullmatch(raw):
            raw = _BETWEEN.sub("", raw)
        if _WIDE.match(raw):
            return [raw[i : i + 2] for i in range(max(1, len(raw) - 1))]
        return [_plain(raw)]

    def __call__(self, text: str) -> list[str]:
        memo, out = self.memo, []
        for raw in self.raw(text):
            found = memo.get(raw)
            if found is None:
                found = self.plain(raw)
                if len(memo) < 200_000:
                    memo[raw] = found
            if found != ["."] or (out and out[-1] != "."):
                out += found
        return out


class Vocabulary:
    """Numbers of words (0 ends a sentence, the last is any other word) and of the pairs that matter."""

    def __init__(self, words: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> None:
        self.words = [".", *words]
        index = {w: i for i, w in enumerate(self.words)}
        self.other = len(self.words)
        self.signs = {w: _code(i) for i, w in enumerate(self.words)}
        self.unknown = _code(self.other)
        keys = sorted(index[a] * (self.other + 1) + index[b] for a, b in pairs)
        self.pairs = np.array(keys, dtype=np.int64)
        self.first, self.second = (np.zeros(self.other + 1, dtype=bool) for _ in range(2))
        self.first[self.pairs // (self.other + 1)] = True
        self.second[self.pairs % (self.other + 1)] = True

    @property
    def features(self) -> int:
        """Words, the other word, pairs."""
        return self.other + 1 + len(self.pairs)

    def codes(self, tokens: Sequence[str]) -> str:
        """Tokens as one character each."""
        return "".join([self.signs.get(t, self.unknown) for t in tokens])

    def pair_ids(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, feature numbers) of the known pairs that end there; `starts` are first tokens of documents."""
        asked = self.first[ids[:-1]] & self.second[ids[1:]]
        asked[starts[(starts > 0) & (starts < len(ids))] - 1] = False
        at = np.flatnonzero(asked) + 1
        keys = ids[at - 1].astype(np.int64) * (self.other + 1) + ids[at]
        found = np.searchsorted(self.pairs, keys)
        good = found < len(self.pairs)
        good[good] = self.pairs[found[good]] == keys[good]
        return at[good], self.other + 1 + found[good]


def _code(i: int) -> str:
    """One character for a number; surrogates and control characters are left out."""
    i += 0x20
    return chr(i if i < 0xD800 else i + 0x800)


def _numbers(codes: str) -> np.ndarray:
    at = np.frombuffer(codes.encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
    if len(at) and at.max() >= 0xE000:
        at[at >= 0xE000] -= 0x800
    at -= 0x20
    return at


class Encoder:
    """A text as a string of one character for each token."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = Tokens()
        self.vocabulary = vocabulary
        self.memo: dict[str, str] = {}

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        memo, out = self.memo, []
        for raw in self.tokens.raw(text):
            c = memo.get(raw)
            if c is None:
                c = self.vocabulary.codes(self.tokens.plain(raw))
                if len(memo) < 500_000:
                    memo[raw] = c
            out.append(c)
        return _ENDS.sub(" ", "".join(out)).removeprefix(" ")


_ENDS = re.compile(" {2,}")  # the character of number 0, the end of a sentence


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray  # of each feature, drift not taken off
    drift: float = 0.0
    rate: float = 1.0  # lambda of the Gumbel law
    scale: float = 1e-3  # K
    null: tuple = field(default=(), repr=False)  # held-out (score, tokens) of clean documents

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        s = self.weights[ids]
        at, pairs = self.vocabulary.pair_ids(ids, starts)
        s[at] += self.weights[pairs]
        s -= self.drift
        s[ids == 0] = 0.0
        return s

    def expected(self, score: float, tokens: int) -> float:
        """Chance passages of at least this score in so many tokens of ordinary text."""
        return self.scale * max(1, tokens) * math.exp(-min(self.rate * score, 700.0))

    def passages(self, ids: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(first, last + 1, score, expected chance passages) of the maximal segments, best first."""
        if not len(ids) or not self.weights.any():
            return []
        found = segments(self.scores(ids, np.zeros(1, dtype=np.int64)), np.array([0, len(ids)]))[0]
        return sorted(((a, z, s, self.expected(s, len(ids))) for a, z, s in found), key=lambda p: -p[2])

    def read(self, text: str | None) -> np.ndarray:
        return _numbers(Encoder(self.vocabulary)(text))


def segments(scores: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """All maximal scoring segments (start, end, score) of each document, by Ruzzo and Tompa in linear time.

    Document k is scores[bounds[k]:bounds[k + 1]]. Neighbouring positive scores
    always share a segment, so whole runs of them are what the scan takes up.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    up = scores > 0
    edge = np.zeros(len(scores) + 1, dtype=bool)
    edge[bounds[bounds < len(scores)]] = True
    before = np.concatenate([[False], up[:-1]]) if len(up) else up
    starts = np.flatnonzero(up & (~before | edge[:-1]))
    after = np.concatenate([up[1:], [False]]) if len(up) else up
    ends = np.flatnonzero(up & (~after | edge[1:])) + 1
    if len(ends) != len(starts):
        raise AssertionError("runs of positive scores do not pair up")
    part = np.searchsorted(starts, bounds)
    lows, highs = total[starts].tolist(), total[ends].tolist()
    starts_l, ends_l = starts.tolist(), ends.tolist()
    out = []
    for k in range(len(bounds) - 1):
        stack: list[tuple[int, int, float, float]] = []  # start, end, left sum, right sum
        base = int(bounds[k])
        for r in range(part[k], part[k + 1]):
            start, end, lo, hi = starts_l[r], ends_l[r], lows[r], highs[r]
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= lo:
                    j -= 1
                if j < 0 or stack[j][3] >= hi:
                    stack.append((start, end, lo, hi))
                    break
                start, lo = stack[j][0], stack[j][2]
                del stack[j:]
        out.append([(a - base, z - base, hi - lo) for a, z, lo, hi in stack])
    return out


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """The maximal scoring segments of one sequence."""
    return segments(np.array(scores, dtype=np.float64), np.array([0, len(scores)]))[0]


def gumbel(best: np.ndarray, tokens: np.ndarray, tail: tuple[float, float] = TAIL) -> tuple[float, float]:
    """lambda and K by maximum likelihood from the best scores of clean documents.

    P(best <= s) = exp(-K n exp(-lambda s)) for n tokens. Below the lower
    quantile of `tail` the law need not hold and above the upper one may be
    documents rated by mistake: of both only the number counts (censored). A weak
    prior of two observations (mean 1 for lambda) keeps few documents defined.
    """
    s, n = np.asarray(best, dtype=np.float64), np.maximum(1.0, np.asarray(tokens, dtype=np.float64))
    low, high = np.quantile(s, tail) if len(s) else (0.0, 1.0)
    under, over = s <= low, s > high
    at = np.clip(s, low, high)
    seen = ~under & ~over
    count, total, logs = seen.sum() + 2.0, s[seen].sum(), np.log(n[seen]).sum()

    def likelihood(rate: float, log_scale: float) -> float:
        e = np.exp(log_scale + np.log(n) - rate * at)
        return count * (math.log(rate) + log_scale) + logs - rate * (total + 2.0) - e[~over].sum() - 0.02 * math.exp(min(log_scale, 50.0)) + np.log(-np.expm1(-e[over]) + 1e-300).sum()

    def best_scale(rate: float) -> tuple[float, float]:
        x = _peak(lambda k: likelihood(rate, k), -25.0, 10.0)
        return likelihood(rate, x), x

    rate = math.exp(_peak(lambda r: best_scale(math.exp(r))[0], math.log(0.01), math.log(20.0)))
    return rate, math.exp(best_scale(rate)[1])


def _peak(f, lo: float, hi: float, steps: int = 36) -> float:
    """Where a function of one peak is greatest (golden section)."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
    return (lo + hi) / 2


class _Sample:
    """The labelled documents as flat arrays, and the fit on any of them."""

    def __init__(self, vocabulary: Vocabulary, docs: list[str], rated: Sequence[bool], df: np.ndarray, n_docs: float) -> None:
        self.vocabulary, self.rated = vocabulary, np.array(rated, dtype=bool)
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.ids = _numbers("".join(docs))
        self.doc = np.repeat(np.arange(len(docs)), self.lengths)
        self.at, self.pair = vocabulary.pair_ids(self.ids, self.bounds[:-1]) if len(self.ids) else (self.ids, self.ids)
        self.df, self.n_docs = np.maximum(df, 1.0), max(1.0, n_docs)

    def _present(self, inside: np.ndarray) -> np.ndarray:
        """Of each feature, the number of documents that hold it inside."""
        n = self.vocabulary.features
        one = np.unique(self.doc[inside] * n + self.ids[inside])
        whole = inside[self.at] & inside[self.at - 1]
        two = np.unique(self.doc[self.at[whole]] * n + self.pair[whole])
        return np.bincount(np.concatenate([one, two]) % n, minlength=n).astype(np.float64)

    def _weights(self, inside: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """Odds moved by their uncertainty: those of pairs to zero, those of words to what
        an ordinary word has, so a word that the labels say nothing about is ordinary."""
        held = self._present(inside)
        n_bad = max(1, len(np.unique(self.doc[inside])))
        share = self.df / self.n_docs
        bad = held + PRIOR_MASS * share
        odds = np.log(bad / (n_bad + PRIOR_MASS)) - np.log(np.minimum(share, 1.0))
        slack = SHRINK * np.sqrt(1 / bad + 1 / self.df)
        last = self.vocabulary.other
        centre = np.zeros(len(odds))
        centre[: last + 1] = min(0.0, float(odds[self.ids[clean]].mean())) if clean.any() else 0.0
        w = centre + np.sign(odds - centre) * np.maximum(0.0, np.abs(odds - centre) - slack)
        w = np.maximum(w, LOWEST)
        w[0], w[last] = 0.0, centre[last]
        return w

    def _raw(self, w: np.ndarray) -> np.ndarray:
        s = w[self.ids]
        s[self.at] += w[self.pair]
        return s

    def _best(self, s: np.ndarray, docs: np.ndarray) -> list[tuple[int, int, float]]:
        """The best segment of each of `docs`, as positions in the sample; (0, 0, 0.0) without one."""
        out = []
        for d in docs.tolist():
            a, z = self.bounds[d], self.bounds[d + 1]
            found = max(segments(s[a:z], np.array([0, z - a]))[0], key=lambda p: p[2], default=(0, 0, 0.0))
            out.append((a + found[0], a + found[1], found[2]))
        return out

    def _evidence(self, s: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
        """Of each document the segment with the highest single score, as that does not
        add up words which always come together."""
        out = []
        for d in docs.tolist():
            a, z = self.bounds[d], self.bounds[d + 1]
            found = max(segments(s[a:z], np.array([0, z - a]))[0], key=lambda p: (s[a + p[0] : a + p[1]].max(), p[2]), default=(0, 0))
            out.append((a + found[0], a + found[1]))
        return out

    def fit(self, use: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and drift from the documents in the mask `use`."""
        used = use[self.doc]
        clean = used & ~self.rated[self.doc] & (self.ids != 0) & (self.ids != self.vocabulary.other)
        bad = np.flatnonzero(use & self.rated & (self.lengths > 0))
        inside = used & self.rated[self.doc]
        for k in range(ROUNDS):
            w = self._weights(inside, clean)
            s = self._raw(w)
            drift = float(np.quantile(s[clean], DRIFT)) if clean.any() else 1.0
            if k < ROUNDS - 1:
                s -= drift
                s[self.ids == 0] = 0.0
                inside = np.zeros(len(self.ids), dtype=bool)
                for a, z in self._evidence(s, bad):
                    inside[a:z] = True
        return w, drift

    def null_scores(self, w: np.ndarray, drift: float, docs: np.ndarray) -> list[float]:
        s = self._raw(w) - drift
        s[self.ids == 0] = 0.0
        return [v for _, _, v in self._best(s, docs)]


def fit_encoded(vocabulary: Vocabulary, docs: list[str], rated: Sequence[int], df: np.ndarray, n_docs: float) -> Model:
    """A model from labelled documents, given as codes, and the corpus' document counts of each feature.

    The null law comes from FOLDS fits, each scoring the clean documents that it
    left out; the weights are then fitted on all.
    """
    kinds = {bool(r) for r in rated}
    if len(kinds) < 2:
        return Model(vocabulary, np.zeros(vocabulary.features))
    sample = _Sample(vocabulary, docs, [bool(r) for r in rated], df, n_docs)
    fold = np.arange(len(docs)) % FOLDS
    best, lengths = [], []
    for k in range(FOLDS):
        held = np.flatnonzero((fold == k) & ~sample.rated & (sample.lengths > 0))
        if len(held) and (sample.rated & (fold != k)).any():
            best += sample.null_scores(*sample.fit(fold != k), held)
            lengths += sample.lengths[held].tolist()
    rate, scale = gumbel(np.array(best), np.array(lengths))
    w, drift = sample.fit(np.ones(len(docs), dtype=bool))
    return Model(vocabulary, w, drift, rate, scale, (np.array(best), np.array(lengths)))


def vocabulary_of(docs: list[list[str]], rated: Sequence[int]) -> Vocabulary:
    """The words of the labelled documents, and the pairs of those rated offensive."""
    counts = Counter(w for d in docs for w in set(d) if w != ".")
    words = sorted(counts, key=lambda w: (-counts[w], w))[:MAX_WORDS]
    known = set(words)
    pairs = {(a, b) for d, r in zip(docs, rated, strict=True) if r for a, b in zip(d, d[1:], strict=False) if a in known and b in known}
    return Vocabulary(words, sorted(pairs))


def document_counts(vocabulary: Vocabulary, docs: list[str]) -> np.ndarray:
    """Of each feature, in how many of the documents, given as codes, it occurs."""
    n = vocabulary.features
    ids = _numbers("".join(docs))
    if not len(ids):
        return np.zeros(n)
    ends = np.cumsum([len(d) for d in docs])
    at, pair = vocabulary.pair_ids(ids, np.concatenate([[0], ends[:-1]]))
    two = np.unique(np.searchsorted(ends, at, side="right") * n + pair) % n
    return np.bincount(np.concatenate([_numbers("".join(["".join(set(d)) for d in docs])), two]), minlength=n).astype(np.float64)


def fit(texts: list[str], offensive: list[int]) -> Model:
    """A model from labelled texts alone, which are then the corpus as well."""
    tokenize = Tokens()
    docs = [tokenize(t) for t in texts]
    vocabulary = vocabulary_of(docs, offensive)
    codes = [vocabulary.codes(d) for d in docs]
    return fit_encoded(vocabulary, codes, offensive, document_counts(vocabulary, codes), len(docs))


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[list[list[str]], list[int]]:
    """Tokens and ratings of the labelled documents; beyond `max_labelled`, of those first by a hash of their id.

    Tokenised on the executors; a document rated several times counts as
    offensive if one rater said so.
    """
    rated = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = documents.select("doc_id", "text").where((F.length(F.trim("text")) > 0) & (F.length("text") <= MAX_CHARS)).join(chosen, "doc_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = Tokens()
        for b in slices(batches, 1024):
            words = ["\n".join(tokenize(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(words, pa.string())], ["doc_id", "toxic", "words"])

    found = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(tokens, "doc_id bigint, toxic int, words string").toArrow().sort_by("doc_id")
    return [w.split("\n") for w in found.column("words").to_pylist()], found.column("toxic").to_pylist()


ENCODED = "doc_id bigint, source string, codes string, feature array<int>, n array<bigint>"


def encode_documents(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of two kinds, by one pass over the texts: doc_id, source and codes of each
    document (feature null), and partial document counts (feature and n)."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encode = Encoder(vocabulary)
        counts = np.zeros(vocabulary.features, dtype=np.int64)
        names = [c.split()[0] for c in ENCODED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for b in slices(batches, 1024):
            codes = [encode(t) for t in b.column("text").to_pylist()]
            counts += document_counts(vocabulary, codes).astype(np.int64)
            none = [pa.nulls(b.num_rows, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(codes, pa.string()), *none], names)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds[:3]] + [pa.array([held.tolist()], kinds[3]), pa.array([counts[held].tolist()], kinds[4])], names)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, ENCODED)


def corpus_counts(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Document counts of each feature over the corpus; at most one row for each reaches the driver."""
    pairs = encoded.where("feature is not null").select(F.explode(F.arrays_zip("feature", "n")).alias("f")).groupBy("f.feature").agg(F.sum("f.n").alias("n"))
    df = np.zeros(vocabulary.features)
    found = pairs.toArrow()
    df[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return df


def score_corpus(documents: DataFrame, labels: DataFrame, level: float = LEVEL, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Fit on the labelled documents and score all: each text is tokenised once, a labelled one twice."""
    model, encoded = fit_corpus(documents, labels, max_labelled)
    return score_encoded(encoded, model, level)


def fit_corpus(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Model, DataFrame]:
    """The model, and the documents in its numbers (as encode_documents gives them, checkpointed)."""
    words, rated = labelled_sample(documents, labels, max_labelled)
    vocabulary = vocabulary_of(words, rated)
    encoded = cut_lineage(encode_documents(documents, vocabulary))
    codes = [vocabulary.codes(d) for d in words]
    del words
    return fit_encoded(vocabulary, codes, rated, corpus_counts(encoded, vocabulary), encoded.where("feature is null").count()), encoded


def score_documents(documents: DataFrame, model: Model, level: float = LEVEL) -> DataFrame:
    """Scores of other documents by a model that is there already."""
    return score_encoded(encode_documents(documents, model.vocabulary), model, level)


SCORED = "doc_id bigint, source string, score double, expected double, passages int, passage string, offensive boolean"


def score_encoded(encoded: DataFrame, model: Model, level: float = LEVEL) -> DataFrame:
    """doc_id, source, score, expected, passages, passage and offensive of every document."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = [*model.vocabulary.words, "·"]
        blank = not model.weights.any()
        for b in slices(batches, 1024):
            codes = [c or "" for c in b.column("codes").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
            ids = _numbers("".join(codes))
            s = np.zeros(len(ids)) if blank or not len(ids) else model.scores(ids, bounds[:-1])
            rows = []
            for k, found in enumerate(segments(s, bounds)):
                a, z, best = max(found, key=lambda p: p[2], default=(0, 0, 0.0))
                n = int(bounds[k + 1] - bounds[k])
                strong = sum(model.expected(v, n) < level for _, _, v in found)
                text = " ".join(words[i] for i in ids[bounds[k] + a : bounds[k] + z]) if strong else None
                rows.append((float(best), model.expected(best, n) if found else None, strong, text, strong > 0))
            kinds = (pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.bool_())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *columns], [c.split()[0] for c in SCORED.split(", ")])

    return encoded.where("feature is null").select("doc_id", "source", "codes").mapInArrow(score, SCORED)


def rates_by_source(scored: DataFrame) -> DataFrame:
    """source, documents, offensive and rate; a null source is a group of its own."""
    flag = F.when(F.col("offensive"), 1).otherwise(0)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(flag).alias("offensive"), F.round(F.avg(flag), 6).alias("rate"))
