"""Text decoded with a wrong character encoding: detection and restoration.

Every candidate chain of wrong decodings is undone and the outcome is measured
by its minimum description length: the size under a zstandard dictionary of the
best fitting language, plus a charge for each hop of the chain and for
characters that no language's alphabet has. Dictionaries and alphabets come from
counts over the whole of every labelled text. A segment (a line or a sentence)
changes only if a chain describes it in fewer bytes than the text as it stands.

Defined results
* null, empty and plain ASCII values: not garbled, returned unchanged;
* U+FFFD marks bytes that are lost: garbled, restorable is false, the value is
  returned with whatever else could be restored;
* a tie between leaving and changing keeps the text; a tie between chains takes
  the one tried first (UTF-8 misread once, twice, then the legacy pages);
* an empty table gives an empty result; without language models (no labelled
  text at all) the byte length alone is the description length.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.session import written

#: Wrongly applied single-byte code pages whose bytes may be UTF-8.
UTF8_SEEN_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866")
#: Fixed values: (wrong code page, true legacy encoding), undone over a whole segment.
LEGACY_SEEN_AS = (
    ("cp1252", "cp932"),
    ("cp1252", "euc_jp"),
    ("mac_roman", "cp932"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8_r"),
    ("cp1252", "cp866"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("cp1251", "cp866"),
    ("cp866", "cp1251"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("mac_roman", "cp1252"),
)
#: Languages by the script that their letters use.
SCRIPTS = {"cyrillic": ("ru",), "kana": ("ja",), "latin": ("en", "de", "fr", "es", "pt")}

UTF8_HOP_COST = 0.5  # bytes for each hop of wrongly read UTF-8: self-checking, hence likely
LEGACY_HOP_COST = 4  # bytes for a mix-up of two single- or double-byte code pages
RAW_BYTE = 0.2  # weight of the uncompressed bytes; it settles what whole compressed bytes cannot
NOVELTY_COST = 6  # bytes for each character that is in no language's alphabet
LEVEL = 12  # of compression; lower ones parse short texts so roughly that fewer characters may cost more
MATCH_BYTES = 3  # what a reference to the dictionary costs about; shorter phrases save nothing
RARE_SHARE = 150  # a character belongs to the alphabet if one in so many texts of a language holds it, and two do

#: Rows that can hold wrongly decoded text: two neighbouring characters outside
#: ASCII (every multi-byte sequence gives them), a replacement character, or a
#: letter, a symbol and a letter in a row (single-byte mix-ups in Latin words).
#: Every case begins with its first character outside ASCII, so that ASCII text is passed over fast.
_SYMBOLS = "\u0080-\u009F¤¦¨¯´¶¸‚ƒ„†‡ˆ‰‹›˜√≤≥∞∂∑∏∫≈∆◊─-■"
SUSPECT = rf"[^\x00-\x7F](?:[^\x00-\x7F]|(?<=�)|(?<=[A-Za-z][{_SYMBOLS}])[a-z])"

_SEGMENT = re.compile(r"(?:[^\n.!?。]|[.!?。](?![\s]|$))*(?:[.!?。]+|\n|$)\s*")
_WORD = re.compile(r" ?(?:[぀-ゟ]+|[゠-ヿ]+|[一-鿿]+|[^\W぀-ヿ一-鿿]+)| ?[^\w\s]+|\s")
_ASCII_WORD = re.compile(r" ?\w+| ?[^\w\s]+|\s")  # the same on ASCII text
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_ASCII_LETTER = re.compile("[A-Za-z]")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_WESTERN_RUN = re.compile("[\x80-\x9f¡-¬®-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{2,}")
_CYRILLIC = re.compile("[Ѐ-ӿ]{3,}")
_SYMBOL_IN_WORD = re.compile(f"[A-Za-z][{_SYMBOLS}][a-z]")
_CYRILLIC_LETTER = re.compile("[Ѐ-ӿ]")
_MIXED_WORD = re.compile(r"\w*(?:[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ])\w*")
_SWAPPED_CASE = re.compile("[а-яё][А-ЯЁ]{2,}")
_KANA = re.compile("[぀-ヿ一-鿿]")
_LOST_SPACE = re.compile(r"(?<=\s)Ã  ?(?=\S)")


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[int, str]:
    """Character code -> one Latin-1 character holding the byte it came from.

    Undefined bytes of a code page stand for their C1 control, as lenient
    decoders leave them; cp1252 therefore covers Latin-1 as well. Cyrillic code
    pages leave the no-break space out: it stands in ordinary text.
    """
    out: dict[int, str] = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        if ch != "\xa0" or encoding in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850"):
            out.setdefault(ord(ch), chr(b))
    if encoding == "cp1252":
        for b in range(128, 160):
            out.setdefault(b, chr(b))
    return out


@lru_cache(maxsize=None)
def _utf8_pattern(encoding: str) -> re.Pattern[str]:
    """UTF-8 sequences as they look when each byte is read in `encoding`."""
    by_byte: dict[int, list[str]] = {}
    for code, raw in byte_table(encoding).items():
        by_byte.setdefault(ord(raw), []).append(chr(code))

    def group(first: int, last: int) -> str:
        letters = "ёЁ" if encoding == "koi8_r" else ""  # they stand in ordinary Russian text
        return "[" + "".join(re.escape(c) for b in range(first, last + 1) for c in by_byte.get(b, ()) if c not in letters) + "]"

    tail = group(0x80, 0xBF)
    if encoding in ("cp850", "cp866"):  # only box drawing characters lead: letters of ordinary text would pass, too
        boxes = "".join(c for b in range(0xC2, 0xE0) for c in by_byte.get(b, ()) if "─" <= c <= "╿")
        return re.compile(f"[{boxes}]{tail}")
    return re.compile(f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}")


@lru_cache(maxsize=None)
def _runs(encoding: str) -> re.Pattern[str]:
    chars = "".join(re.escape(chr(c)) for c in byte_table(encoding))
    return re.compile(f"[\x00-\x7f]*[{chars}](?:[\x00-\x7f{chars}])*")


def undo_utf8(text: str, wrong: str) -> str:
    """UTF-8 sequences that were read as `wrong` become their characters; the rest stays."""
    table = byte_table(wrong)

    def character(m: re.Match[str]) -> str:
        seen = m.group()
        try:
            return seen.translate(table).encode("latin-1").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return seen

    return _utf8_pattern(wrong).sub(character, text)


def undo_legacy(text: str, wrong: str, true: str) -> str:
    """Runs that `wrong` can encode are read again as `true`; undecodable runs stay."""
    table = byte_table(wrong)

    def run(m: re.Match[str]) -> str:
        raw = m.group().translate(table)
        try:
            return raw.encode("latin-1").decode(true)
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m.group()

    return _runs(wrong).sub(run, text)


def undo_around_mixed(text: str, wrong: str, true: str) -> str:
    """undo_legacy on what has Cyrillic letters between the words that mix them with Latin ones."""
    mixed, plain = _mixed_words(text)
    rest = [undo_legacy(t, wrong, true) if _CYRILLIC_LETTER.search(t) else t for t in plain]
    return "".join(a + b for a, b in zip(rest, [*mixed, ""], strict=True))


@lru_cache(maxsize=1)  # every chain asks for the same text
def _mixed_words(text: str) -> tuple[list[str], list[str]]:
    return _MIXED_WORD.findall(text), _MIXED_WORD.split(text)


def candidates(text: str) -> Iterator[tuple[int, str, str]]:
    """(cost, chain, text) of every chain that changes the text.

    Cyrillic read in another Cyrillic page is tried on every text with a Cyrillic
    run. Words of Latin letters stay as they are, and so do words that mix both
    scripts: look-alike letters, not bytes of a page. Western symbols in place of
    another script must outnumber the ASCII letters.
    """
    if _RUN.search(text):
        for wrong in UTF8_SEEN_AS:
            if _utf8_pattern(wrong).search(text) and (one := undo_utf8(text, wrong)) != text:
                yield UTF8_HOP_COST, f"{wrong}<utf_8", one
                for again in UTF8_SEEN_AS:
                    if _utf8_pattern(again).search(one) and (two := undo_utf8(one, again)) != one:
                        yield 2 * UTF8_HOP_COST, f"{wrong}<utf_8,{again}<utf_8", two
    kinds = []
    if _SYMBOL_IN_WORD.search(text):
        kinds.append("symbol")
    if _CYRILLIC.search(text):
        if _CYRILLIC.search(_MIXED_WORD.sub(" ", text)):
            kinds.append("cyrillic")
    elif _WESTERN_RUN.search(text):
        ascii_letters = len(_ASCII_LETTER.findall(text))
        foreign = sum(len(m.group()) for m in _WESTERN_RUN.finditer(text))
        if foreign > max(2, ascii_letters):
            kinds.append("western")
    for wrong, true in LEGACY_SEEN_AS if kinds else ():
        kind = "symbol" if true == "cp1252" else "western" if wrong in ("cp1252", "mac_roman") else "cyrillic"
        if kind in kinds and (one := undo_around_mixed(text, wrong, true) if kind == "cyrillic" else undo_legacy(text, wrong, true)) != text:
            yield LEGACY_HOP_COST, f"{wrong}<{true}", one


class DescriptionLength:
    """Bytes that the best language's dictionary needs for a text."""

    def __init__(self, models: dict[str, bytes], alphabet: str) -> None:
        import zstandard

        self.alphabet = frozenset(alphabet)
        self.by_language = {}
        for language, data in models.items():
            kind = zstandard.DICT_TYPE_AUTO
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            self.by_language[language] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _languages(self, text: str) -> tuple[str, ...]:
        if _CYRILLIC.search(text):
            return SCRIPTS["cyrillic"]
        return SCRIPTS["kana"] if _KANA.search(text) else SCRIPTS["latin"]

    def __call__(self, text: str) -> float:
        text = text.lower()  # a heading in capitals reads like its language too
        data = text.encode("utf-8", "surrogatepass")
        sizes = [len(c.compress(data)) for k in self._languages(text) if (c := self.by_language.get(k))]
        size = min(sizes, default=len(data) + 12) + RAW_BYTE * len(data)
        if self.alphabet:
            size += NOVELTY_COST * sum(1 for c in _FOREIGN.findall(text) if c not in self.alphabet and not familiar(c))
        return size


def repair(text: str | None, length: DescriptionLength) -> tuple[str | None, str, bool, bool]:
    """(restored text, chains, garbled, restorable) of one value.

    Segments are described on their own, as text may be garbled in part; the
    chain that saves most in the whole value is paid for once.
    """
    if not text or text.isascii():
        return text, "", False, True
    segments: list[tuple[str, float, list[tuple[float, int, str, str]]]] = []
    saved: dict[str, float] = {}
    for m in _SEGMENT.finditer(text):
        part = m.group()
        options: list[tuple[float, int, str, str]] = []
        plain = 0.0
        if not part.isascii() and (found := list(candidates(part))):
            plain = length(part)
            for cost, chain, other in found:
                options.append((length(other), cost, chain, other))
                if options[-1][0] + cost < plain:
                    saved[chain] = saved.get(chain, 0) + plain - options[-1][0]
        segments.append((part, plain, options))
    main = max(saved, key=lambda k: (saved[k], -len(k)), default="")
    out, chains = [], []
    for part, plain, options in segments:
        best, chosen, least = part, "", plain
        for size, cost, chain, other in options:
            c = size + (0 if chain == main else cost)
            if c < least:
                best, chosen, least = other, chain, c
        if chosen and chosen not in chains:
            chains.append(chosen)
        if chosen.startswith("cp1252<utf_8"):
            best = _LOST_SPACE.sub("à ", best)
        out.append(best)
    lost = "�" in text
    return "".join(out), ";".join(chains), bool(chains) or lost, not lost


@lru_cache(maxsize=4096)
def familiar(c: str) -> bool:
    """A space, or a Latin letter with a common accent: known even if few texts hold it."""
    if unicodedata.category(c) == "Zs":
        return True
    d = unicodedata.normalize("NFD", c)
    return c <= "ž" and len(d) == 2 and d[0].isascii() and d[1] in "\u0300\u0301\u0302\u0303\u0308\u030a\u030c\u0327"


def _plain_language(column: F.Column) -> F.Column:
    return F.lower(F.substring_index(F.substring_index(F.trim(column), "-", 1), "_", 1))


def clean_segments(text: str) -> Iterator[str]:
    """Segments of a labelled text in small letters, without those that look wrongly decoded."""
    for m in _SEGMENT.finditer(unicodedata.normalize("NFC", text)):
        part = m.group()
        if part.strip() and (part.isascii() or not any(True for _ in _utf8_changes(part)) and not _SWAPPED_CASE.search(part)):
            yield part.lower()


Block = tuple[str, str, list[str], list[int]]


def count_texts(rows: Iterable[tuple[str, str]], at_most: int = 1_000_000) -> Iterator[Block]:
    """Blocks (language, kind, keys, counts) of labelled texts: kind text counts them, char the texts
    that hold a character outside ASCII, phrase the occurrences of up to three words.

    Blocks come out whenever more than `at_most` words are held; the counts of one key add up.
    """
    ids: defaultdict[str, int] = defaultdict(lambda: len(ids) + 1)
    held: dict[str, array[int]] = {}  # numbers of the words, 0 after each segment
    texts: Counter[str] = Counter()
    chars: dict[str, Counter[str]] = {}
    room = at_most

    def released() -> Iterator[Block]:
        words = ["", *ids]
        for language, numbers in held.items():
            for keys, n in _phrases(np.frombuffer(numbers, np.int64), words):
                yield language, "phrase", keys, n
        held.clear()
        ids.clear()

    for language, text in rows:
        seen: set[str] = set()
        for part in clean_segments(text):
            plain = part.isascii()
            if not plain:
                seen.update(_FOREIGN.findall(part))
            words = (_ASCII_WORD if plain else _WORD).findall(part)
            numbers = held.setdefault(language, array("q"))
            numbers.extend(map(ids.__getitem__, words))
            numbers.append(0)
            room -= len(words) + 1
            if room < 0:
                yield from released()
                room = at_most
        texts[language] += 1
        chars.setdefault(language, Counter()).update(seen)
    yield from released()
    for language, n in texts.items():
        yield language, "text", [""], [n]
        yield language, "char", list(chars[language]), list(chars[language].values())


def _phrases(numbers: np.ndarray, words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Phrases of one, two and three words within segments, and how often they occur."""
    known, at, strings = words, numbers, words
    for length in (1, 2, 3):
        if length > 1:  # a phrase is a shorter one and the next word, both by number
            last = numbers[length - 1 :]
            pairs = np.where((at[: len(last)] > 0) & (last > 0), at[: len(last)] << 32 | last, 0)
            distinct, at, n = np.unique(np.append(pairs, 0), return_inverse=True, return_counts=True)
            at = at[:-1]
            strings = [known[k >> 32] + words[k & 0xFFFFFFFF] for k in distinct.tolist()]
        else:
            n = np.bincount(numbers, minlength=len(words))
        found = [(k, c) for k, c in zip(strings[1:], n[1:].tolist(), strict=True) if c and (len(k) > MATCH_BYTES or _bytes(k) > MATCH_BYTES)]
        for some in batched(found, 50_000):
            yield [k for k, _ in some], [c for _, c in some]
        known = strings


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def alphabet_of(chars: Iterable[tuple[str, int]], texts: int) -> set[str]:
    least = max(2, -(-texts // RARE_SHARE))
    return {c for c, n in chars if n >= least and not "\x80" <= c <= "\x9f"}


def dictionary_of(phrases: Iterable[str], dict_bytes: int) -> tuple[bytes, bool]:
    """The best phrases first fill a dictionary from its end, which is cheapest to refer to;
    those that it holds already are left out. True if no room is left for another one."""
    held = b""
    for phrase in phrases:
        if dict_bytes - len(held) <= MATCH_BYTES:
            break
        data = phrase.encode("utf-8", "surrogatepass")
        if len(held) + len(data) <= dict_bytes and data not in held:
            held = data + held
    return held, dict_bytes - len(held) <= MATCH_BYTES


def train_models(texts: DataFrame, text: str = "text", language: str = "lang", dict_bytes: int = 48_000) -> tuple[dict[str, bytes], str]:
    """A zstandard dictionary for each language, and the alphabet of all.

    Both come from counts over the whole of every labelled text. Phrases are ranked by the
    bytes that their repeats save for each byte of room. The driver gets the best ones only,
    and more of them until a dictionary is full or all phrases of its language are used.
    """
    known = [x for group in SCRIPTS.values() for x in group]
    lang = _plain_language(F.col(language)).alias("language")
    labelled = texts.select(lang, F.col(text).alias("text")).where(F.col("language").isin(known) & (F.length("text") > 20) & ~F.col("text").contains("�"))
    counts = written(labelled.mapInArrow(_counted, COUNTS).groupBy("language", "kind", "key").agg(F.sum("n").alias("n")))
    # at most one row for each language and character
    single = [(r["language"], r["kind"], r["key"], r["n"]) for r in counts.where("kind <> 'phrase'").collect()]
    alphabet: set[str] = set()
    models = {}
    size = F.octet_length("key")
    worth = (F.col("n") - 1) * (size - MATCH_BYTES) / size
    for name, n in sorted((k, n) for k, kind, _, n in single if kind == "text"):
        alphabet |= alphabet_of(((c, m) for k, kind, c, m in single if (k, kind) == (name, "char")), n)
        best = counts.where((F.col("kind") == "phrase") & (F.col("language") == name)).orderBy(worth.desc(), size, "key").select("key")
        listed, whole = max(1, dict_bytes // (MATCH_BYTES + 1)), False
        while not whole:
            keys = [r["key"] for r in best.limit(listed).collect()]
            model, full = dictionary_of(keys, dict_bytes)
            whole = full or len(keys) < listed
            listed *= 4
        if model:
            models[name] = model
    return models, "".join(sorted(alphabet))


def fit_models(by_language: dict[str, list[str]], dict_bytes: int = 48_000) -> tuple[dict[str, bytes], str]:
    """What train_models gives, from texts in memory."""
    models, alphabet = {}, set()
    for language, texts in sorted(by_language.items()):
        counts: dict[str, Counter[str]] = {"text": Counter(), "char": Counter(), "phrase": Counter()}
        for _, kind, keys, n in count_texts((language, t) for t in texts):
            for k, c in zip(keys, n, strict=True):
                counts[kind][k] += c
        alphabet |= alphabet_of(counts["char"].items(), counts["text"][""])
        ranked = sorted((-(n - 1) * (_bytes(k) - MATCH_BYTES) / _bytes(k), _bytes(k), k) for k, n in counts["phrase"].items())
        if ranked:
            models[language] = dictionary_of((k for _, _, k in ranked), dict_bytes)[0]
    return models, "".join(sorted(alphabet))


COUNTS = "language string, kind string, key string, n bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (x for b in batches for x in zip(b.column("language").to_pylist(), b.column("text").to_pylist(), strict=True))
    for language, kind, keys, n in count_texts(rows):
        strings = [pa.repeat(language, len(keys)), pa.repeat(kind, len(keys)), pa.array(keys, pa.string())]
        yield pa.RecordBatch.from_arrays([*strings, pa.array(n, pa.int64())], ["language", "kind", "key", "n"])


def _utf8_changes(text: str) -> Iterator[str]:
    """Chains that find UTF-8 in a text; such text is kept out of the models."""
    if not text.isascii():
        for wrong in ("cp1252", "cp437"):
            if undo_utf8(text, wrong) != text:
                yield wrong


RESULT = T.StructType(
    [
        T.StructField("restored", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("garbled", T.BooleanType()),
        T.StructField("restorable", T.BooleanType()),
    ]
)


def garbled_rows(df: DataFrame, models: dict[str, bytes], alphabet: str, value: str = "value") -> DataFrame:
    """The rows of `df` whose value is garbled, with restored, chain and restorable.

    Other columns are kept, whatever their names; columns called restored, chain
    or restorable that are already there are replaced. The scan is filtered in
    the JVM first, so plain text never reaches Python.
    """
    kept = [c for c in df.columns if c not in ("restored", "chain", "garbled", "restorable")]

    @F.pandas_udf(RESULT)
    def undo(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        length = DescriptionLength(models, alphabet)
        for values in batches:
            yield pd.DataFrame([repair(v, length) for v in values], columns=RESULT.names)

    suspects = df.select(*kept).where(F.col(value).rlike(SUSPECT))
    found = suspects.withColumn("__undone", undo(F.col(value))).where(F.col("__undone.garbled"))
    return found.select(*kept, "__undone.restored", "__undone.chain", "__undone.restorable")
