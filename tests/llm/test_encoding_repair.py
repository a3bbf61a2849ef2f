import pytest

from pagelore.llm import encoding_repair as R

TEXT = {
    "en": ["The company’s liability shall not exceed £5 in any period — see Note 3.", "Naïve estimate of the café in 20 µg per m²."],
    "de": ["Die Behörde prüft die Gebühr und die Erklärung jährlich.", "Gemäß § 4 ist die Kündigung spätestens schriftlich zu bestätigen."],
    "fr": ["Les résultats de la trésorerie ont été présentés dès l’été.", "La créance s’élève à 5 € pour l’exercice."],
    "es": ["La compañía presentó la declaración en español.", "¿Cuándo se publicará la próxima póliza?"],
    "pt": ["A comissão aprovou a avaliação com três abstenções.", "As informações sobre a inspeção estão disponíveis no balcão."],
    "ru": ["Отчёт за год содержит сведения о перевозках и расходах.", "Рост показателей в регионе связан с изменением порядка учёта."],
    "ja": ["検査の結果、減価償却に異常は認められませんでした。", "詳細は別紙の契約条件をご覧ください。"],
}


@pytest.fixture(scope="module")
def length():
    return R.DescriptionLength(*R.fit_models({k: v * 30 for k, v in TEXT.items()}))


def damage(text, wrong, true="utf-8", hops=1):
    for _ in range(hops):
        raw = text.encode(true)
        text = "".join(_char(b, wrong) for b in raw)
    return text


def _char(b, encoding):
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@pytest.mark.parametrize("language", list(TEXT))
def test_clean_text_stays(length, language):
    for t in TEXT[language]:
        for u in (t, t.upper(), t.replace(" ", " "), t.replace("o", "о") if language == "en" else t):
            assert R.repair(u, length) == (u, "", False, True)


@pytest.mark.parametrize("language", list(TEXT))
@pytest.mark.parametrize(("wrong", "hops"), [("cp1252", 1), ("latin-1", 1), ("cp1252", 2), ("mac_roman", 1), ("cp437", 1), ("cp1251", 1)])
def test_round_trip_of_misread_utf8(length, language, wrong, hops):
    for t in TEXT[language]:
        bad = damage(t, wrong, hops=hops)
        if bad == t:
            continue
        out, chain, garbled, restorable = R.repair(bad, length)
        assert garbled and restorable and out == t, (bad, out, chain)


@pytest.mark.parametrize(("language", "wrong", "true"), [("ja", "cp1252", "cp932"), ("ru", "cp1252", "cp1251"), ("ru", "cp1251", "koi8_r"), ("ru", "koi8_r", "cp1251")])
def test_round_trip_of_mixed_up_pages(length, language, wrong, true):
    for t in TEXT[language]:
        out, _, garbled, _ = R.repair(damage(t, wrong, true), length)
        assert garbled and out == t


@pytest.mark.parametrize(("wrong", "true"), [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866")])
def test_cyrillic_pages_next_to_latin_words(length, wrong, true):
    for t in ("Отчёт содержит сведения о перевозках: KZ-9623O0", "Рост показателей в регионе 18.2 per cent в год."):
        out, chain, garbled, _ = R.repair(damage(t, wrong, true), length)
        assert garbled and out == t and chain == f"{wrong}<{true}"


def test_words_of_both_scripts_are_no_mixed_up_page(length):
    alike = str.maketrans("aceopxyi", "асеорхуі")
    for t in ("The annual register is visible to the naked eye once the cover has been removed.", "Office of final filing", "The 21:09 service does not call on long-term holidays."):
        for u in (t.translate(alike), t.translate(alike).replace(" ", "\xa0")):
            assert R.repair(u, length) == (u, "", False, True)


def test_swapped_case_is_kept_out_of_the_models():
    bad = [damage(t, "cp1251", "koi8_r") for t in TEXT["ru"]] * 30
    assert R.fit_models({"ru": bad}) == ({}, "")


def test_partly_garbled_and_lost(length):
    a, b = TEXT["de"]
    assert R.repair(f"{a} {damage(b, 'cp1252')}", length)[0] == f"{a} {b}"
    assert R.repair("R�sum�", length)[2:] == (True, False)
    assert R.repair(None, length) == (None, "", False, True) and R.repair("", length)[2] is False


def test_rows(spark):
    docs = spark.createDataFrame([(t, k.upper() if k == "de" else f"{k}-XX") for k, v in TEXT.items() for t in v] + [(None, "en"), ("x", None)], "text string, lang string")
    models, alphabet = R.train_models(docs)
    assert set(models) == set(TEXT) and "ü" in alphabet
    bad = damage(TEXT["fr"][0], "cp1252")
    items = spark.createDataFrame([(1, bad, "a"), (1, bad, "a"), (2, TEXT["fr"][0], "b"), (3, None, None), (4, "", "c"), (5, "�" * 50_000, "d")], "item_key bigint, value string, restored string")
    got = {(r["item_key"], r["restored"][:20], r["restorable"]) for r in R.garbled_rows(items, models, alphabet).collect()}
    assert got == {(1, TEXT["fr"][0][:20], True), (5, "�" * 20, False)}
    assert R.garbled_rows(items.limit(0), models, alphabet).count() == 0
    assert R.train_models(docs.limit(0)) == ({}, "")
    assert R.garbled_rows(items, {}, "").where("item_key = 1").count() == 2


def test_models_come_from_all_texts_to_their_ends(spark):
    """Late signs in 450 texts of 5,000 characters: three of them are one in 150, two are not."""
    filler = "der die das und ist nicht mit von " * 150
    texts = [filler + f"{i}. Ende" + (" ʒilian" if i < 3 else "") + (" ɸorta" if i < 2 else "") + " schlusswort" for i in range(450)]
    docs = spark.createDataFrame([(t, "de") for t in texts], "text string, lang string")
    models, alphabet = R.train_models(docs)
    assert "ʒ" in alphabet and "ɸ" not in alphabet
    assert " schlusswort".encode() in models["de"] and " ɸorta".encode() in models["de"]
    assert (models, alphabet) == R.train_models(docs.repartition(7)) == R.fit_models({"de": texts})
    # more phrases than the driver asks for at first do not fit or are there already
    assert R.train_models(docs, dict_bytes=40) == R.fit_models({"de": texts}, 40)


def test_counts_add_up_whenever_they_come_out():
    rows = [(k, t) for k, v in TEXT.items() for t in v * 3]

    def total(at_most):
        out = {}
        for language, kind, keys, n in R.count_texts(rows, at_most):
            for key, c in zip(keys, n, strict=True):
                out[language, kind, key] = out.get((language, kind, key), 0) + c
        return out

    once = total(1_000_000)
    assert total(5) == once
    assert once["de", "text", ""] == 6 and once["de", "char", "ä"] == 6 and once["de", "phrase", " und die"] == 3
    assert ("de", "phrase", " und die erklärung") in once and ("de", "phrase", " und die erklärung jährlich") not in once


def test_dictionary_skips_what_does_not_fit_or_is_held():
    assert R.dictionary_of(["und die", "und", "x" * 50, "oder", "auch"], 12) == ("oderund die".encode(), True)
    assert R.dictionary_of(["und die"], 12) == (b"und die", False)


def test_spaces_that_do_not_break_are_known(length):
    assert length("zu\xa0§") - length("zu §") < R.NOVELTY_COST
    for t in ("Subject to\xa0§\xa08.4, the liability", "tolerances are 410\xa0µm.", "Die Behörde\xa0prüft die Gebühr: £735"):
        assert R.repair(t, length) == (t, "", False, True)
