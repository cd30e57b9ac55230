"""Problems 4 and 7."""

import pytest
from pyspark.sql import functions as F

from kordel.common import table
from kordel.llm import defects, language
from kordel.llm import queries as llm_queries

DIR = "/root/testdata/sf0.01"
OPS = frozenset("message.send payment.send memory.store call.start time.now timer.set".split())


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(table(spark, DIR, "families"), "input", "language", ["fam_id"])


TEXTS = {
    "put on the new Fakifamu album": ["english"], "llama a Bikaruso por favor": ["spanish"], "appelle Kizinuta s'il te plaît": ["french"], "weck Fizulenu morgen um 12:15": ["german"],
    "разбуди Мемитаке завтра в 12:15": ["russian"], "зателефонуй будь ласка Tivinema": ["ukrainian"], "付给Futirolo412块钱": ["chinese"], "Bolipipoの今日の天気はどうですか": ["japanese"],
    "call Vikisima; اتصل من فضلك برقم Zavamefu": ["english", "arabic"], "tell Bob bring the café menu and two résumés": ["english"], "paga 600 euros a Rinunatu. envoie un message à Giromofi : la réunion est reportée à jeudi": ["spanish", "french"],
}


@pytest.mark.parametrize("text,langs", TEXTS.items())
def test_languages(model, text, langs):
    assert [x[0] for x in model.segments(text)] == langs


def test_held_out_accuracy(spark, model):
    """Rows of another draw: the model and a majority of right labels agree on nearly all of those it could not see labelled wrong."""
    rows = table(spark, "/root/testdata/sf0.001", "families").where("input is not null and language is not null").select(language.language_name(F.col("language")).alias("l"), "input").where("l is not null").collect()
    agree = sum(model.segments(r.input)[0][0] == r.l for r in rows)
    assert agree > 0.85 * len(rows)


def test_identify_handles_blanks(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123"), (4, "call " * 20000)], "id long, t string")
    out = {r.id: r.segments for r in language.identify(df, "t", model).collect()}
    assert out[1][0].lang is None and out[2][0].lang is None and out[3][0].lang is None and out[4][0].lang == "english"
    assert language.identify(df.limit(0), "t", model).count() == 0


CASES = [
    ("call Bob", None, "empty"), ("call Bob", " . ; ", "empty"), ("call Bob", '""', "empty"), ("call Bob", "OUTPUT:", "empty"), ("call Bob", "{}", "empty"), ("call Bob", "null", "empty"),
    ("call Bob", '. call.start :to="Bo', "truncated"), ("call Bobby", '. call.start :to="Bob"', "truncated"), ("call Bob", ". call.sta", "truncated"), ("call Bob", '{"intent": "call.start", "par', "truncated"),
    ("call Bob", "I'm sorry, I can't do this", "refusal"), ("call Bob", '. memory.store :text="Unfortunately, I am not able to set this up"', "refusal"), ("call Bob", '{"error": "I must decline this one"}', "refusal"),
    ("call Bob", "CALL BOB.", "copy"), ("call Bob", '{"intent": "call Bob", "params": {}}', "copy"), ("переведи 5 рублей", "ПЕРЕВЕДИ 5 РУБЛЕЙ", "copy"),
    ("tell Bob the kitten slept on the printer", '. message.send :to="Bob" :text="кот уже поел"', "wrong_language"),
    ("tell Bob I'm sorry, I can't do this", '. message.send :to="Bob" :text="I\'m sorry, I can\'t do this"', None), ("call Bob", '. call.start :to="Bob"', None), ("pay Bob 5", ". payment.send :to=Bob", None),
    ("call Bob", '{"intent": "call.start", "params": {"to": "Bob"}}<END>', None), (None, None, None), ("  ", "", None), ("付给Bob588块钱", '. payment.send :to="Bob" :amount="588"', None),
]


def test_defects(spark, model):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(CASES)], "id long, text string, answer string")
    ends = defects.fit_contexts(df, OPS, ["id"])
    got = {r.id: r.defect for r in defects.flag(df, OPS, model, ends).collect()}
    assert [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]] == []
    assert defects.flag(df.limit(0), OPS, model, ends).count() == 0


def test_copies_are_told_by_compression(monkeypatch):
    """A near copy is found, a part or another text is not, and nothing is a copy if the compressor sees no gain."""
    inp = defects.Letters("call Bob about the red car tomorrow")
    assert defects.is_copy("Call Bob about the big red car tomorrow!", inp) and defects.is_copy("CALL BOB ABOUT THE RED CAR TOMORROW", inp)
    assert not defects.is_copy("call Bob", inp) and not defects.is_copy("pay Ann five dollars for the green bicycle", inp) and not defects.is_copy("", inp)
    assert defects.is_copy("the red car tomorrow", defects.Letters("The red car tomorrow"), whole=True)
    assert not defects.is_copy("Bob about the red car tomorrow", inp, whole=True)
    assert defects.is_copy("stop", defects.Letters("Stop!")) and not defects.is_copy("stop", defects.Letters("Stop!"), whole=True)
    monkeypatch.setattr(defects, "_net", lambda data, prompt: len(data))
    assert not defects.is_copy("CALL BOB ABOUT THE RED CAR TOMORROW", inp)


def test_fit_survives_one_text_in_half_the_rows(spark):
    rows = [(i, "call Bob now" if i % 2 else f"turn the {i} kettle on", "english") for i in range(3000)] + [(9000 + i, f"переведи {i} рублей", "russian") for i in range(1500)] + [(20000 + i, f"llama a {i} por favor mañana", "spanish") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, t string, l string")
    m = language.fit(df, "t", "l", ["id"], fit_rows=600)
    assert m.segments("turn the kettle on")[0][0] == "english" and m.segments("переведи рублей")[0][0] == "russian"


def test_long_copy(spark, model):
    long = "word " * 20000
    assert defects.defect(long, long.upper(), OPS, model, defects.TerminalContexts([], OPS)) == "copy"


@pytest.mark.parametrize("text", [t for t, langs in TEXTS.items() if len(langs) > 1])
def test_full_word_table_changes_no_result(model, text):
    """The table of words runs full at each word of the text in turn."""
    n = len(language.words(language.plain(text)))
    want, mass = model.segments(text), model.distribution(text)
    for k in range(1, n + 1):
        model._reset()
        model.ids.update((f"\0{i}", 0) for i in range(400_001 - k))
        assert model.segments(text) == want
        model._reset()
        model.ids.update((f"\0{i}", 0) for i in range(400_001 - k))
        assert model.distribution(text) == mass
    model._reset()


MANY = [
    ("paga 600 euros a Rinunatu por favor. ", "envoie un message à Giromofi : la réunion est reportée à jeudi. ", "paga 600 euros a Rinunatu"),
    ("call me an hour after the meeting please. ", "اتصل برقم Zavamefu من فضلك. ", "разбуди Мемитаке завтра в 12:15"),
]


@pytest.mark.parametrize("parts,langs", list(zip(MANY, (["spanish", "french", "spanish"], ["english", "arabic", "russian"]), strict=True)))
def test_any_number_of_segments(spark, model, parts, langs):
    df = spark.createDataFrame([("".join(parts),)], "t string")
    got = language.identify(df, "t", model).first().segments
    assert [x.lang for x in got] == langs and all(x.confidence > 0.9 for x in got)
    assert [x.start for x in got] == [0, len(parts[0]), len(parts[0]) + len(parts[1])]


def test_segments_against_brute_force(model):
    """All ways to cut a few words into segments, each change charged."""
    import itertools
    import random

    r = random.Random(3)
    m = len(language.LANGUAGES)
    for _ in range(60):
        rows = [tuple(r.choice((0.0, 0.0, -1.0, -2.0, -8.0)) if i < 3 else -9.0 for i in range(m)) for _ in range(r.randint(1, 7))]
        if not any(any(v) for v in rows):
            continue
        one = language.Model.__new__(language.Model)
        one.vectors = rows
        best = max(sum(v[i] for v, i in zip(rows, way, strict=True)) - language.SEGMENT_GAIN * sum(a != b for a, b in itertools.pairwise(way)) for way in itertools.product(range(3), repeat=len(rows)))
        found = one.decide(tuple(range(len(rows))))
        edges = [x[2] for x in found] + [len(rows)]
        mine = sum(rows[k][language.LANGUAGES.index(x[0])] for x, a, b in zip(found, edges, edges[1:], strict=False) for k in range(a, b)) - language.SEGMENT_GAIN * (len(found) - 1)
        assert abs(mine - best) < 1e-9 and all(a[0] != b[0] for a, b in itertools.pairwise(found))


def test_segments_of_both_tables(spark):
    got = llm_queries.p4_segments(spark, "/root/testdata/sf0.001")
    rows = {t: table(spark, "/root/testdata/sf0.001", t).count() for t in ("families", "canonical")}
    assert {r.src: r.n for r in got.groupBy("src").agg(F.countDistinct("rec_id").alias("n")).collect()} == rows
    assert got.where("lang is not null and not confidence > 0").count() == 0
