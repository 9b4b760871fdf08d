import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import encodings, lookalikes, mixing, personal, repetition, scans, splitting, tokenizer

UNITS = "document_id string, unit_id string, unit_order int, type string, source_ref struct<page:int>, text string, loaded_at int"


# --- splitting
def test_cuts_cover_and_overlap():
    rng = random.Random(5)
    texts = ["", "x" * 100, "Ein Satz. Noch einer!\nNeue Zeile, mit Komma; Ende. " * 9, "".join(rng.choice("ab .\n,é́") for _ in range(400))]
    for size, overlap in ((1, 0), (10, 9), (40, 7), (1000, 0)):
        for text in texts:
            if len(text) > size:
                ends = splitting.cuts([text], [size], [overlap])[0][1:].tolist()
                assert ends[-1] == len(text)
                whole = ""
                for k, stop in enumerate(ends):
                    begin = ends[k - 1] - overlap if k else 0
                    assert 0 <= begin < stop and stop - begin <= size
                    whole += text[begin + (overlap if k else 0) : stop]
                assert whole == text


def test_pieces(spark):
    units = spark.createDataFrame([("d", "a", "short"), ("d", "b", "word " * 50), ("d", "c", None), ("d", "e", ""), ("d", "b", "word " * 50)], "document_id string, unit_id string, text string")
    profiles = spark.createDataFrame([("p", 60, 10), ("q", 400, 0)], "profile string, max_chars int, overlap_chars int")
    assert {tuple(r) for r in splitting.oversized(units, profiles).collect()} == {("p", "d", "b")}
    assert splitting.pieces(units, profiles).where("length(text) > 60 and profile = 'p'").count() == 0
    assert splitting.pieces(units.limit(0), profiles).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(units, profiles.withColumn("overlap_chars", F.lit(400)))


# --- tokenizer
def test_encoding_equals_the_public_one(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["", None, "Hello  world\n\n", "Приказ № 5 — ё", "<|endoftext|>", " " * 300, "é" * 500, "x1y2 don't", "🏗🏽"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenizer.encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (other.encode(t, add_special_tokens=False).ids if t else [])
    counted = {r.doc_id: r.tokens for r in tokenizer.count_tokens(df.select("doc_id", "text")).collect()}
    assert counted == {i: len(got[i]) for i in got}


def test_perfect_hash():
    values = {str(i).encode(): i * 2 for i in range(5000)}
    table = tokenizer.PerfectHash(values)
    assert all(table.get(k) == v for k, v in values.items()) and table.get(b"none") == -1


# --- mixing
def test_water_fill():
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 60) == {"a": 10, "b": 50}
    assert mixing.water_fill({"a": 0.5, "b": 0.5, "c": 0}, {"a": 10, "b": 20}, 500) == {"a": 10, "b": 20, "c": 0}
    assert mixing.water_fill({}, {}, 5) == {}


def test_mix_keeps_the_cap(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", "some words here") for i in range(400)] + [(900, None, "x"), (901, "big", None), (902, "big", "")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 3), ("m", "none", 0.2, 9)], "mix_name string, source string, target_share double, max_repeats int")
    sized = mixing.sizes(docs)
    plan = mixing.plan(sized, targets)
    rows = mixing.mix(sized, plan).collect()
    assert max(r.copies for r in rows if r.source == "small") <= 3 and max(r.copies for r in rows if r.source == "big") == 1
    assert not {900, 901, 902} & {r.doc_id for r in rows}
    twice = targets.union(targets).union(spark.createDataFrame([("m", "small", None, None)], targets.schema))
    assert mixing.plan(sized, twice) == plan
    shares = {r.source: r.actual_share for r in mixing.shares(sized, plan).collect()}
    assert shares["none"] == 0 and sum(shares.values()) == pytest.approx(1)


# --- repetition
def brute_share(text):
    import re

    w = re.findall(r"[^\W\d_]+", text.casefold())
    marked, seen = [False] * len(w), set()
    for i in range(len(w) - 7):
        g = tuple(w[i : i + 8])
        if g in seen:
            marked[i : i + 8] = [True] * 8
        seen.add(g)
    for n in range(1, 8):
        for i in range(n, len(w) - n + 1):
            if w[i : i + n] == w[i - n : i]:
                marked[i : i + n] = [True] * n
    return sum(marked), len(w)


def test_share_equals_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(120))) for _ in range(60)] + ["", None, "1 2 3", "Слово слово СЛОВО!"]
    texts += [("the quick brown fox jumps over a lazy dog " * 3) + "end", "a b c d e f g h i"]
    w = repetition.words_of(texts)
    got = repetition.copied(w)
    for i, t in enumerate(texts):
        assert (got[i], w.counts[i]) == (brute_share(t) if t else (0, 0))


def test_detect(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=80))) for i in range(300)] + [(1000 + i, " ".join(rng.choices(words, k=12)) * 1 + (" so it goes on" * 30)) for i in range(12)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in repetition.found(df.union(df)).collect()) == list(range(1000, 1012))
    shares = {r.doc_id: r for r in repetition.shares(df.withColumn("share", F.lit(1))).collect()}
    assert {i for i, r in shares.items() if r.found} == set(range(1000, 1012)) and shares[2000].share == shares[2001].share == 0
    assert {r.doc_id for r in repetition.found(df, sample_rows=5).collect()} == set(range(1000, 1012))
    assert repetition.found(df.limit(0)).count() == repetition.shares(df.limit(0)).count() == 0


# --- scans
def test_skeleton_and_words():
    assert scans.skeleton("одеждь|") == scans.skeleton("одежды") and scans.skeleton("surfac!ng") == scans.skeleton("surfacing")
    assert scans.skeleton("forrnwork") == scans.skeleton("formwork") and scans.skeleton("channcls") == scans.skeleton("channels")
    words, breaks = scans.unit_words(["the cost-", "plan of earthwo- ", "rks above 5-", "10 m"])
    assert [b[:2] for b in breaks] == [("costplan", "cost-plan"), ("earthworks", "earthwo-rks")]
    assert "above" in words


def test_scan_noise(spark):
    sound = [("s", f"u{i}", i, "paragraph", (1,), "the earthworks and the cost-plan of formwork panels", 1) for i in range(5)]
    scan = [
        ("x", "h1", 1, "paragraph", (1,), "Removal of works. Issue 7\nthe earthwo-\nrks of forrnwork panels", 1),
        ("x", "h2", 2, "paragraph", (2,), "Removal of works. Issue 7\nthe cost-\nplan and the panels\n[12]", 1),
        ("x", "n", 3, "paragraph", None, None, 1),
        ("x", "e", 4, "paragraph", (3,), "", 1),
    ]
    units = spark.createDataFrame(sound + scan + scan[:1], UNITS)
    results = spark.createDataFrame([("x", 99), ("x", 99), (None, 1)], "document_id string, text_chars long")
    got = {(r.unit_id, r.noise) for r in scans.found(units, results).collect()}
    assert got == {("h1", "furniture"), ("h2", "furniture"), ("h1", "broken_word"), ("h1", "misread")}
    texts = {r.text for r in scans.paragraphs(scans.repaired(units, results)).collect()}
    assert any("earthworks of formwork panels" in t for t in texts) and any("cost-plan" in t for t in texts)
    assert scans.found(units.limit(0), results).count() == 0


def test_neighbours_choose_the_form(spark):
    """кот, лот and пот are one skeleton; which of them a misread word is, its neighbours tell."""
    sound = [("s", f"a{i}", i, "paragraph", (1,), "серый кот спит, новый лот продан, градом пот льётся", 1) for i in range(5)] + [("s", f"b{i}", 9, "paragraph", (1,), "кот " * 9, 1) for i in range(4)]
    scan = [("x", "1", 1, "paragraph", (1,), "Вот серый к0т спит дома", 1), ("x", "2", 2, "paragraph", (2,), "Вот новый н0т продан сразу", 1), ("x", "3", 3, "paragraph", (3,), "Опять градом и0т льётся вниз", 1), ("x", "4", 4, "paragraph", (4,), "Где то и0т есть", 1), ("x", "5", 5, "paragraph", (5,), "серый кот спит", 1)]
    units, results = spark.createDataFrame(sound + scan + scan[:1], UNITS), spark.createDataFrame([("x", 9)], "document_id string, text_chars long")
    assert {(r.unit_id, r.noise) for r in scans.found(units, results).collect()} == {(u, "misread") for u in "1234"}
    texts = {r.unit_id: r.text for r in scans.repaired(units, results).collect()}
    assert texts == {"1": "Вот серый кот спит дома", "2": "Вот новый лот продан сразу", "3": "Опять градом пот льётся вниз", "4": "Где то кот есть", "5": "серый кот спит"}


# --- look-alikes
def test_plain_and_words():
    assert lookalikes.plain("Ｔ_(ср) =​ １") == "Т_(ср) = 1".replace("Т", "T")
    assert lookalikes.plain("й №²") == "й №²"
    assert lookalikes.strange_words("Раздел дoлю участка")[1] == [("дoлю", True)]
    assert lookalikes.strange_words("выгрузку XLSX по e-mail a.kl0@office.invalid")[1] == []
    trie = lookalikes.Trie()
    trie.add("смета", 5)
    trie.add("СМЕТА", 5)
    assert trie.nearest("CMETA") == (0, "СМЕТА") and trie.nearest("cmeta") == (0, "смета") and trie.nearest("xyz") is None
    assert trie.nearest("cмe\u200bты") == (1, "смета") and trie.nearest("смет") == (1, "смета") and trie.nearest("сметам") == (1, "смета")
    assert trie.nearest("омета") is None and trie.nearest("cметы", 0) is None and trie.nearest("смеда", 1) == (1, "смета")
    assert lookalikes.strange_words("IP-адрес и мoнтаж-план, e-mail")[1] == [("IP", False), ("мoнтаж", True)]


def test_foreign_words_stay(spark):
    sound = [("s", f"r{i}", "смета на ресурс и сосна у дома", None) for i in range(4)] + [("s", f"e{i}", "the space needs access, see apache match", None) for i in range(4)]
    texts = {"a": "Ошибка access denied, space, APACHE и MATCH в журнале", "b": "there was a ссора between the two of them here", "c": "Составлена CMETA на обьекты", "d": "растёт COCHЫ рядом", "e": "новые pecypcы нужны", "f": "Раздел дoлю участка", "g": "по IP-адресу из PC-версии", "h": None, "i": ""}
    units = spark.createDataFrame(sound + [("t", k, v, None) for k, v in texts.items()] * 2, "document_id string, unit_id string, text string, formula struct<linear_text:string,calc_expr:string>")
    gold = spark.createDataFrame([], "document_label string, formula_index int, text string, linear_text string, calc_expr string")
    assert {(r.owner_id, r.item_id) for r in lookalikes.odd_fields(units, gold).collect()} == {("t", k) for k in "cdef"}
    got = {r.item_id: r.canonical for r in lookalikes.canonical(units, gold).collect() if r.owner_id == "t"}
    want = texts | {"c": "Составлена СМЕТА на обьекты", "d": "растёт СОСНЫ рядом", "e": "новые ресурсы нужны", "f": "Раздел долю участка"}
    assert got == {k: v for k, v in want.items() if v is not None}


# --- encodings
@pytest.fixture(scope="module")
def model():
    texts = ["где шпунтового ограждения и при лабораторных проб", "Länge für Außennetze der Brückenlager", "The working record of storage balances above — see “note”."] * 50
    return encodings.build(encodings.count_pairs(texts, encodings.sound_classes()).reshape(len(encodings.SOUND), -1).astype(float))


@pytest.mark.parametrize("pair", [p for p in encodings.PAIRS if len(p) == 2])
def test_restores(model, pair):
    text = "Länge für Außennetze der Brückenlager" if pair[0] in ("cp1252", "cp437") else "где шпунтового ограждения и при лабораторных проб"
    bad = encodings._misread(text, pair, True)
    if bad is None or bad == text:
        return
    assert encodings.suspects([bad, text, ""], model).tolist() == [True, False, False]
    states = encodings.label([bad], model)[0]
    got = encodings.fix(bad, states, model)
    assert got is not None
    if pair == encodings.LOST:
        assert got == (bad, "any>ascii", False)
    elif "�" not in bad:
        assert got[0] == text


def test_sound_texts_are_clean(model):
    for text in ("plain", "für Außennetze", "при лабораторных проб", "Really??", "what? where?"):
        assert encodings.fix(text, encodings.label([text], model)[0], model) is None


def test_pictures_share_a_pair(spark, model):
    bad = lambda t: encodings._misread(t, ("cp1251", "cp1252"), True)
    long = [("d", "p", f"c{i}", i, bad("где шпунтового ограждения"), "Arial", 0) for i in range(3)]
    rows = [*long, ("d", "p", "s", 9, bad("пр"), "Arial", 204), ("d", "p", "k", 10, "где", "Arial", 204), ("d", "q", "s", 1, "où", None, None), ("d", None, "n", 1, None, None, None), (None, "p", "x", 1, "при", None, 5), ("d", "p", "y", 11, bad("проб"), "Symbol", 2)]
    chunks = spark.createDataFrame(rows + rows, "document_id string, asset_id string, chunk_ref string, chunk_order int, text string, face string, charset int")
    got = {r.item_id: (r.restored, r.restorable) for r in encodings.garbled_chunks(chunks, model).collect()}
    assert got == {**{f"c{i}": ("где шпунтового ограждения", True) for i in range(3)}, "s": ("пр", True)}
    assert encodings.garbled_chunks(chunks.limit(0), model).count() == 0


# --- personal information
@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to a.b@mail.example now", ["email"]), ("x (at) office (dot) invalid", ["email"]), ("Партия @ 20 шт.", []), ("Тел. 8-037-731-12-96", ["phone"]),
        ("Сумма 8 912 345,67 руб.", []), ("СНИЛС 000-653-908 59.", ["identity_number"]), ("national insurance number QQ 79 97 61 C", ["identity_number"]),
        ("Code 81-02-009-4, line 812-45.", []), ("г. Верхнеложск, улица Полынная, дом 19", ["address"]), ("Площадь 48 кв. м, д. ед. 3.", []), ("Resides at 51 Millbrook Ave., Unit 55.", ["address"]),
        ("Die Proben lagern: Mühlenpfad 21, 1. OG.", ["address"]), ("The Street Works list is extended.", []), ("Исполнитель: Клим Климович Верхожилов.", ["person"]), ("Prepared by Ms. Pellworth.", ["person"]),
        ("Geprüft: I. Tiefenstöcker.", ["person"]), ("", []),
    ],
)
def test_kinds(text, kinds):
    out, got = personal.replace(text)
    assert got == kinds
    if not kinds:
        assert out == text


@pytest.mark.parametrize("rule", personal.RULES, ids=lambda r: f"{r.kind}-{r.need}")
def test_needs_lose_nothing(rule):
    """Whatever a rule matches holds what the rule is said to need."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rule.form))
    def holds(text):
        for m in rule.form.finditer(text):
            assert personal.NEEDS[rule.need](text), m.group()

    holds()


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Lindensteig 12", ["address"]), ("Neckarufer 7", ["address"]), ("площадь Ленина, 5", ["address"]), ("пл. Ленина, 5", ["address"]), ("бульвар Мира, 3", ["address"]),
        ("аллея Героев, д. 5", ["address"]), ("тел. 8\u00a0495\u00a0123\u00a045\u00a067", ["phone"]), ("erstellt von\u00a0Jan\u00a0Weber", ["person"]), ("signed by\u00a0Anna\u00a0Smith", ["person"]),
        ("число 500100732259", ["identity_number"]), ("число 500100732258", []), ("ИНН 500100732258", ["identity_number"]),
    ],
)
def test_any_space_and_checksums(spark, text, kinds):
    df = spark.createDataFrame([("d", "a", text)], "document_id string, unit_id string, text string")
    assert [r.kind for r in personal.found(df).collect()] == kinds
    assert (personal.redact(df).first().text == text) == (not kinds)


def test_checksums():
    assert personal.luhn("4539578763621486") and not personal.luhn("4539578763621487")
    assert personal.mod97("GB82WEST12345698765432") and not personal.mod97("GB82WEST12345698765433")


def test_redact(spark):
    df = spark.createDataFrame([("d", "a", "Call 555-0184 in office hours."), ("d", "b", None), ("d", "c", "")], "document_id string, unit_id string, text string")
    assert {r.unit_id: r.text for r in personal.redact(df).collect()} == {"a": "Call [PHONE] in office hours.", "b": None, "c": ""}
    assert np.array_equal(sorted(r.kind for r in personal.found(df).collect()), ["phone"])
