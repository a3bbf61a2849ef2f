import pytest
from pyspark.sql import functions as F

from pagelore.llm import scan_repair as S

ITEMS = "item_key bigint, parse_id bigint, page_index int, type string, source string, reading_order int, value string, text string, label string, word string, own string"
PAGES = "parse_id bigint, page_index int, page_label string, page_number string, loaded_at timestamp, form string"


def tables(spark, items, pages=()):
    i = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in items], ITEMS)
    return i, spark.createDataFrame([(*r, None, "f") for r in pages], PAGES)


def corpus(word_rows=40):
    """Trusted text that makes words frequent."""
    text = "The service is documented and the residual turbine was reviewed by a modern committee. A well-documented facility. Weekday trains between towns."
    return [(1000 + k, 9, 1, "text", "native", k, text) for k in range(word_rows)]


CASES = [
    ("The ser-\nvice was fine.", {"hyphen"}),
    ("The ser¬\nvice", {"hyphen"}),
    ("The ser\u00ad\nvice", {"hyphen"}),
    ("The ser- \n vice", {"hyphen"}),
    ("A well-\ndocumented facility", set()),
    ("The rcsidual turbine", {"misread"}),
    ("The rcsid-\nual turbine", {"hyphen", "misread"}),
    ("Weekclay trains", {"misread"}),
    ("betvveen towns", {"misread"}),
    ("a modem committee", set()),  # a word of trusted text is no misreading, however rare
    ("The service\n— 3 —\nis fine", {"page_no"}),
    ("[3]\nThe service", {"page_no"}),
    ("The service is\n3 |", {"page_no"}),
    ("The service is\n7 |", set()),
    ("CORONIA LOGISTICS 2024\nThe service", {"running"}),
    ("Coronia L0gistics 2024\nThe service", {"running", "misread"}),
    ("The service\nCoronia Logistics 2024 | 3", {"running", "page_no"}),
    ("3   Coronia Logistics 2024\nThe service", {"running", "page_no"}),
    ("Part R0D1020-5L replaces KZ-2315O0", set()),
    ("", set()),
    (None, set()),
    ("The service is fine. " * 3000 + "The ser-\nvice", {"hyphen"}),
]
LONG = len(CASES)


def test_all_kinds_of_noise(spark):
    items, pages = [(9000, 90, 1, "text", "native", 0, "modem"), *corpus()], []
    for k, (value, _) in enumerate(CASES, start=1):
        items += [(k, k, 3, "text", "ocr", 1, value), (5000 + k, k, 2, "header", "native", 0, "Coronia Logistics 2024")]
        pages.append((k, 3, "3", "7"))
    items.append(next(r for r in items if r[0] == 1))  # a repeated delivery
    items += [(200, 200, 3, "text", "native", 1, "The ser-\nvice"), (201, 201, 3, "text", "ocr", 1, "The service\np. 7")]
    items += [(300, 300, 1, "text", "ocr", 1, "Coronia Logistics 2024\nThe rcsidual tur-\nbine was"), (301, 300, 2, "text", "ocr", 0, "reviewed by the commit-\ntee.\n2"), (302, 300, 1, "header", "native", 0, "Coronia Logistics 2024")]
    pages += [(201, 3, None, "7"), (300, 1, "1", "1"), (300, 2, "2", "2")]
    i, p = tables(spark, items, pages)
    noise = S.ScanNoise(i, p)
    rows = noise.defects().collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["item_key"], set()).add(r["defect"])
    assert len({tuple(r) for r in rows}) == len(rows)
    for k, (value, want) in enumerate(CASES, start=1):
        assert got.get(k, set()) == want, value and value[:60]
    assert 200 not in got and got[201] == {"page_no"}
    repaired = noise.repaired()
    texts = {r["item_key"]: r["repaired"] for r in repaired.collect()}
    assert texts[LONG].endswith("fine. The service") and texts[1] == "The service was fine." and texts[5] == "A well-documented facility" and texts[16] == "The service"
    whole = [(r["parts"], r["paragraph"]) for r in S.paragraphs(repaired, 2).where("parse_id = 300").collect()]
    assert whole == [(2, "The residual turbine was reviewed by the committee.")]


def test_frequent_misreading_with_few_trusted_occurrences(spark):
    items = [(1, 1, 1, "text", "native", 0, "residual " * 150 + "rcsidual"), *[(10 + k, 2, 1, "text", "ocr", k, "The rcsidual turbine") for k in range(12)]]
    noise = S.ScanNoise(*tables(spark, items))
    assert [tuple(r)[:2] for r in noise.fixes.collect()] == [("rcsidual", "residual")]
    assert {tuple(r) for r in noise.defects().collect()} == {(10 + k, "misread") for k in range(12)}
    assert {r["repaired"] for r in noise.repaired().collect()} == {"The residual turbine"}


def test_weak_confusions_need_a_neighbour(spark):
    # "hause" could be "house" and "rnn" "run": believed where scanned text has the frequent one beside the same word
    trusted = [(k, 1, 1, "text", "native", k, "the old house was sold before the next run began again") for k in range(1, 60)]
    scans = [(101, 2, 1, "text", "ocr", 0, "an old hause burned"), (102, 2, 1, "text", "ocr", 1, "zu hause bleiben"), (103, 2, 1, "text", "ocr", 2, "our next ruu ended"), (104, 2, 1, "text", "ocr", 3, "hause"), (105, 2, 1, "text", "ocr", 4, "the old house stood"), (106, 2, 1, "text", "ocr", 5, "the next run began")]
    noise = S.ScanNoise(*tables(spark, [*trusted, *scans]))
    assert {tuple(r) for r in noise.misread_words().collect()} == {(101, "hause", "house"), (103, "ruu", "run")}
    texts = {r["item_key"]: r["repaired"] for r in noise.repaired().collect()}
    assert texts[101] == "an old house burned" and texts[102] == "zu hause bleiben"
    held = [*trusted, *scans, (900, 1, 1, "text", "native", 0, "zu hause")]  # trusted text has the word: no misreading
    assert {tuple(r)[1] for r in S.ScanNoise(*tables(spark, held)).misread_words().collect()} == {"ruu"}


def test_long_lines_long_words_and_short_headers(spark):
    header = "Coronia Logistics annual account of the harbour and the inland terminals for the financial year two thousand and twenty-four, volume two"
    word = "donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    items = [(k, 1, 1, "text", "native", k, f"die {word} tagte") for k in range(1, 40)]
    items += [(100, 2, 1, "header", "native", 0, header), (101, 2, 1, "text", "ocr", 1, f"{header}\nEs tagte die {word.replace('e', 'c', 1)}")]
    items += [(110 + k, 3, k, "header", "native", 0, "年次報告") for k in (1, 2)] + [(120, 3, 3, "text", "ocr", 1, "年次報告\nEs tagte")]
    items += [(130, 4, 1, "header", "native", 0, "Ja"), (131, 4, 2, "text", "ocr", 1, "Ja\nEs tagte")]  # seen on one page only
    noise = S.ScanNoise(*tables(spark, items))
    assert {tuple(r) for r in noise.defects().collect()} == {(101, "running"), (101, "misread"), (120, "running")}


def test_later_deliveries_count_once(spark):
    # four deliveries of one text are one occurrence: not enough to make its word frequent
    items = [(1, 1, 1, "text", "native", 0, "residual residual turbine")] * 12 + [(2, 2, 1, "text", "ocr", 0, "rcsidual")]
    noise = S.ScanNoise(*tables(spark, items))
    assert noise.words.where("word = 'residual'").first()["seen"] == 2 and noise.fixes.count() == 0


def test_paragraph_over_300_pages(spark):
    df = spark.range(300).selectExpr("id as item_key", "1L as parse_id", "cast(id as int) as page_index", "0 as reading_order", "concat('w', id) as repaired")
    assert [(r["item_key"], r["parts"], r["paragraph"].split(" ")) for r in S.paragraphs(df).collect()] == [(0, 300, [f"w{k}" for k in range(300)])]
    with pytest.raises(RuntimeError, match="most_rounds"):
        S.paragraphs(df, 2)


def test_empty_tables(spark):
    i, p = tables(spark, [], [])
    n = S.ScanNoise(i, p)
    assert n.defects().count() == 0 and n.repaired().count() == 0


def test_anagram_differences_find_what_substitution_finds(spark):
    words = [("thermistor", 50, 60), ("therrnistor", 0, 2), ("thcrmistor", 0, 1), ("clay", 0, 1), ("day", 70, 70), ("tsimrethor", 0, 1)]
    df = spark.createDataFrame(words, "word string, trusted bigint, seen bigint")
    assert {(r["misread"], r["correction"]) for r in S.corrections(df).collect()} == {("therrnistor", "thermistor"), ("thcrmistor", "thermistor"), ("clay", "day")}
    h = df.select("word", S.anagram_hash(F.col("word")).alias("h")).collect()
    assert all(r["h"] == sum(ord(c) ** 5 for c in r["word"]) for r in h)
