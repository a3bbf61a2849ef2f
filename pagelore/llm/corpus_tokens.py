"""The whole corpus as token ids, with chunks that documents share encoded once.

Texts are cut where a rolling hash over their characters says so, hence equal
passages in different documents give equal chunks wherever they stand. Digests
are counted over the corpus first: what occurs once is encoded in its document,
in one piece with its neighbours; chunks that occur more often are sent to one
place by digest, encoded once and joined back. A chunk border is exact where the
tokenizer's word splitter must split as well (before white space that follows
other text). Elsewhere the border is repaired: the text from the last such hard
border of the left chunk to the first of the right one is encoded again, over
as many chunks as it takes, so the ids equal those of the whole text.

Which digests are shared is told by a Bloom filter of fixed size, the only thing
broadcast besides at most HOT hot digests; where it errs, a chunk takes the
longer way to the same ids.

Defined results: null and empty texts have no ids (an empty list); other
columns, whatever their names, do not take part.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.session import written

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 16  # characters that decide on a cut
MASK_BITS = 8  # a cut after 256 characters in the mean
SHORTEST, LONGEST = 64, 4096
SNAP = 48  # how far a cut moves right to white space
FILTER_BITS = 23  # the Bloom filter has 2 ** FILTER_BITS bits (1 MB)
HOT = 4096  # a digest that holds more than a HOT-th of all chunks is salted; there are at most HOT of them
SALTS = 64
#: Unicode white space, as the word splitter sees it (Python's own class also has U+001C..U+001F).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HARD = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def tokenizer_path(name: str = DEFAULT_RANKS, directory: str | None = None) -> str:
    """The vocabulary file; the directory is a parameter, else where the public files are installed."""
    if directory:
        return f"{directory}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_STEPS = [(k, pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2, 4, 8)]  # hashes of 2, 4, 8 and 16 characters from two halves


def hash_marks(text: str) -> np.ndarray:
    """Places after which the hash of the last WINDOW characters asks for a cut."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(1)
    for width, factor in _STEPS:
        if len(h) > width:
            h[width:] += h[:-width].copy() * np.uint32(factor)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_bounds(text: str, marks: list[int] | None = None) -> list[int]:
    """Ends of the content-defined chunks of a text; the last is len(text).

    `marks` are places of hash_marks within the text, if they are known already. A
    window that reaches over a text's start only gives marks that are too early to
    cut at.
    """
    n = len(text)
    if n <= SHORTEST:
        return [n]
    if marks is None:
        marks = hash_marks(text).tolist()
    out, start = [], 0
    for m in marks:
        while m - start > LONGEST:
            start += LONGEST
            out.append(start)
        if m - start < SHORTEST or m >= n:
            continue
        hard = _HARD.search(text, m, min(n, m + SNAP))
        end = hard.start() if hard else m
        if end < n and end > start:
            out.append(end)
            start = end
    while n - start > LONGEST:
        start += LONGEST
        out.append(start)
    out.append(n)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small views of the batches: Python objects exist for so many rows at a time only."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _digest(chunk: str) -> tuple[int, int]:
    """Two numbers of 64 bits: the digest that is counted, and a check that joins compare as well."""
    both = xxhash.xxh3_128_intdigest(chunk.encode("utf-8", "surrogatepass"))
    return (both & (1 << 64) - 1) - (1 << 63), (both >> 64) - (1 << 63)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b.column(1).to_pylist()
        marks = hash_marks("".join(texts))
        starts = np.cumsum([0, *map(len, texts)])
        parts = np.searchsorted(marks, starts, side="right")
        ends, digests = [], []
        for k, text in enumerate(texts):
            own = chunk_bounds(text, (marks[parts[k] : parts[k + 1]] - starts[k]).tolist())
            ends.append(own)
            digests.append([_digest(text[a:z])[0] for a, z in zip([0, *own], own)])
        columns = [b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "ends", "digests"])


class Shared:
    """A Bloom filter of the digests that occur more than once, two bits each."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def holds(self, digests: list[int]) -> np.ndarray:
        d = np.array(digests, dtype=np.int64).view(np.uint64)
        out = np.ones(len(d), dtype=bool)
        for shift in (0, 32):
            at = (d >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def shared_digests(counts: DataFrame) -> np.ndarray:
    """The filter's words from `counts` (digest, n > 1): at most 2 ** (FILTER_BITS - 6) numbers reach the driver."""
    size = (1 << FILTER_BITS) - 1
    at = counts.select(F.explode(F.array(F.col("digest").bitwiseAND(size), F.shiftrightunsigned("digest", 32).bitwiseAND(size))).alias("at"))
    words = at.select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of ids as one list column."""
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _pack(ids: list[int] | np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else in four; the first byte tells."""
    a = np.asarray(ids, dtype=np.uint32)
    return b"\x02" + a.astype(np.uint16).tobytes() if not len(a) or a.max() < 65_536 else b"\x04" + a.tobytes()


def _unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype=np.uint16 if packed[:1] == b"\x02" else np.uint32, offset=1).tolist() if packed else []


def _whole(path: str, shared):
    """Documents that share nothing, encoded in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), Shared(shared.value)
        for b in slices(batches):
            keep = _sharing(b, known, False)
            ids = [enc.encode_to_numpy(t, disallowed_special=()) for t in b.column(1).take(keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), _lists(ids)], ["doc_id", "ids"])

    return run


def _sharing(b: pa.RecordBatch, known: Shared, wanted: bool) -> pa.Array:
    """Rows of a batch that have (or have not) a digest that may be shared."""
    lists = b.column(3)
    held = known.holds(lists.flatten().to_numpy(zero_copy_only=False))
    sizes = np.diff(lists.offsets.to_numpy())
    some = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=held, minlength=len(sizes)) > 0
    return pa.array(np.flatnonzero(some == wanted))


def _shared_texts(shared):
    """digest, check and text of the chunks that may be shared, each once for so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shared(shared.value)
        for b in slices(batches, 4096):
            seen: dict[tuple[int, int], str] = {}
            for text, ends, digests in _rows(b, known):
                for a, z, held in zip([0, *ends], ends, known.holds(digests), strict=False):
                    if held:
                        seen[_digest(text[a:z])] = text[a:z]
            columns = [pa.array([k[i] for k in seen], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.string())], ["digest", "check", "chunk"])

    return run


def _rows(b: pa.RecordBatch, known: Shared) -> Iterator[tuple]:
    own = b.take(_sharing(b, known, True))
    return zip(*(own.column(c).to_pylist() for c in ("text", "ends", "digests")), strict=True)


_PARTS = "doc_id bigint, seq int, digest bigint, check bigint, known binary"


def _parts(path: str, shared):
    """The pieces of documents that share chunks: those that may be shared by their digest, what lies between encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), Shared(shared.value)
        for b in slices(batches):
            doc_ids = b.column(0).take(_sharing(b, known, True)).to_pylist()
            out = []
            for doc, (text, ends, digests) in zip(doc_ids, _rows(b, known), strict=True):
                own = 0  # where the open piece of unshared chunks begins
                for seq, (a, z, held) in enumerate(zip([0, *ends], ends, known.holds(digests), strict=False)):
                    if held:
                        if own < a:
                            out.append((doc, 2 * seq, None, None, _sealed(enc, text[own:a])))
                        out.append((doc, 2 * seq + 1, *_digest(text[a:z]), None))
                        own = z
                if own < len(text):
                    out.append((doc, 2 * len(ends), None, None, _sealed(enc, text[own:])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _PARTS.split(", ")])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, 1024):
            sealed = [_sealed(enc, t) for t in b.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("check"), pa.array(sealed, pa.binary())], ["digest", "check", "known"])

    return run


def _sealed(enc, text: str) -> bytes:
    """What joining needs of a chunk: the texts of its ends and its ids, none of the text between."""
    head, tail, head_ids, body_ids, tail_ids = _encoded(enc, text)
    first, last = text[:head].encode("utf-8", "surrogatepass"), text[tail:].encode("utf-8", "surrogatepass")
    packed = [_pack(x) for x in (head_ids, body_ids, tail_ids)]
    whole = head == len(text)
    sizes = np.array([whole, len(first), len(last), *map(len, packed)], dtype=np.uint32)
    return sizes.tobytes() + first + last + b"".join(packed)


def _opened(sealed: bytes) -> tuple[str, str, bool, list[int], list[int], list[int]]:
    """(text of the head, text of the tail, whether the head is all, ids of head, body and tail)."""
    whole, *sizes = np.frombuffer(sealed, dtype=np.uint32, count=6).tolist()
    cuts = np.cumsum([24, *sizes]).tolist()
    first, last, *packed = (sealed[a:z] for a, z in zip(cuts, cuts[1:]))
    return first.decode("utf-8", "surrogatepass"), last.decode("utf-8", "surrogatepass"), bool(whole), *map(_unpack, packed)


def _encoded(enc, text: str) -> tuple[int, int, list[int], list[int], list[int]]:
    """A chunk's parts: before its first hard border, between, after its last.

    head and tail are character positions; without a hard border inside, all
    of the chunk is head and head = tail = its length.
    """
    first = _HARD.search(text)
    if first is None:
        return len(text), len(text), enc.encode_ordinary(text), [], []
    head = first.start()
    # the last hard border: where the last run of white space begins that follows other text
    tail = head
    for m in _HARD.finditer(text, max(head, len(text) - 200)):
        tail = m.start()
    if tail == head:
        for m in _HARD.finditer(text, head):
            tail = m.start()
    return head, tail, enc.encode_ordinary(text[:head]), enc.encode_ordinary(text[head:tail]), enc.encode_ordinary(text[tail:])


def join_ids(enc, parts: list[tuple]) -> list[int]:
    """Ids of a document from what `_opened` gives of its chunks, in order."""
    out: list[int] = []
    pending: list[str] = []  # texts since the last hard border
    known: list[int] | None = []  # their ids, if they are one part that is encoded already

    def flush() -> None:
        out.extend(enc.encode_ordinary("".join(pending)) if known is None else known)

    last = ""
    for first, end, whole, head_ids, body_ids, tail_ids in parts:
        if not first:  # an empty chunk: any other has a head
            continue
        if not last or (last not in SPACE and first[0] in SPACE):  # the border itself is hard
            flush()
            pending, known = [first], head_ids
        else:
            pending.append(first)
            known = None
        if not whole:
            flush()
            out.extend(body_ids)
            pending, known = [end], tail_ids
        last = (end or first)[-1:]
    flush()
    return out


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            ids = []
            for parts in b.column("parts").to_pylist():
                ids.append(np.array(join_ids(enc, [_opened(p["known"]) for p in parts]), dtype=np.uint32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids of every document.

    The texts are cut once, into a table in the checkpoint folder. Documents
    without a shared chunk are encoded from it with no shuffle; of the others the
    shared chunks are shuffled (once for each task's slice of rows), their sealed
    ids on the way back, and the sealed pieces between. Documents without text take
    no part in any of it.
    """
    path = path or tokenizer_path()
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    blank = F.coalesce(F.length("text"), F.lit(0)) == 0
    cut = written(docs.where(~blank).mapInArrow(_cut, "doc_id bigint, text string, ends array<int>, digests array<bigint>"))
    counts = cut.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(counts)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(shared_digests(repeated))
    total = cut.agg(F.sum(F.size("digests"))).first()[0] or 0
    hot = repeated.where(F.col("n") * HOT > total).select("digest", F.lit(SALTS).alias("salts"))  # at most HOT rows

    whole = cut.mapInArrow(_whole(path, shared), "doc_id bigint, ids array<int>")
    distinct = cut.mapInArrow(_shared_texts(shared), "digest bigint, check bigint, chunk string").groupBy("digest", "check").agg(F.first("chunk").alias("chunk"))
    encoded = distinct.mapInArrow(_encode(path), "digest bigint, check bigint, known binary")
    copies = encoded.join(F.broadcast(hot), "digest", "left").select("digest", "check", "known", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    parts = written(cut.mapInArrow(_parts(path, shared), _PARTS))  # read for both kinds of pieces
    asked = parts.where("digest is not null").select("doc_id", "seq", "digest", "check").join(F.broadcast(hot), "digest", "left")
    asked = asked.select("doc_id", "seq", "digest", "check", F.pmod(F.hash("doc_id"), F.coalesce("salts", F.lit(1))).alias("salt"))
    back = asked.join(copies, ["digest", "check", "salt"]).select("doc_id", "seq", "known")
    pieces = back.unionByName(parts.where("digest is null").select("doc_id", "seq", "known"))
    joined = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "known"))).alias("parts")).mapInArrow(_assemble(path), "doc_id bigint, ids array<int>")
    none = docs.where(blank).select("doc_id", F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(joined).unionByName(none)
