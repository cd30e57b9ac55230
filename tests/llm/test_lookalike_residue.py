"""Problems 3 and 6."""

import itertools
import unicodedata

from pyspark.sql import functions as F

from kordel.llm import lookalike, residue

SAME = ["call Bob ﬁrst", "cаll Bob first", "ｃａｌｌ　Ｂｏｂ　ｆｉｒｓｔ", "call Bo​b first"]
DIFFERENT = ["Call Bob first", "call  Bob first", "call Bob first ", "call\tBob first", "call Bob, first", "call Bob first."]


def test_fold():
    assert {lookalike.fold(x) for x in SAME} == {"call Bob first"}
    assert len({lookalike.fold(x) for x in DIFFERENT} | {"call Bob first"}) == len(DIFFERENT) + 1
    assert lookalike.fold("café") == lookalike.fold("café") and lookalike.fold("ｶﾞ") == lookalike.fold("ガ")
    assert lookalike.fold("a‑b") == "a-b" and lookalike.fold("a—b") != "a-b" and lookalike.fold("") == ""


def test_classes_are_transitive_and_frequency_decides():
    c = lookalike.classes()
    assert {"o", "о", "ο", "ｏ"} <= set(c["o"]) and c["o"] == c["о"]
    assert lookalike.Rewriter({"о": 10, "o": 1})("oо") == "оо"
    assert lookalike.Rewriter({"о": 1, "o": 10})("oо") == "oo"


def test_pairs_against_brute_force(spark):
    texts = SAME * 3 + ["call Bob first"] * 5 + DIFFERENT + ["x" * 20000, "х" * 20000]
    rows = [("s", "", i, t) for i, t in enumerate(texts)] + [("s", "greek", 900 + i, t) for i, t in enumerate(SAME)]
    df = spark.createDataFrame(rows, "src string, lang string, id long, text string")
    all_rows, want = rows, set()
    for a, b in itertools.combinations(rows, 2):
        if a[1] == b[1] and a[3] != b[3] and lookalike.fold(a[3]) == lookalike.fold(b[3]):
            want.add((a[1], a[2], b[2]))
    for block in (2, 1000):
        got = [(r.lang, r.id_a, r.id_b) for r in lookalike.same_look_pairs(lookalike.same_look_rows(df, block=block)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rows = lookalike.same_look_rows(df, block=2)
    links = {(r.lang, r.id): (r.class_id, r.links) for r in lookalike.same_look_classes(rows).collect()}
    partners = {}
    for lang, a, b in want:
        for x, y in ((a, b), (b, a)):
            partners.setdefault((lang, x), set()).add(y)
    assert {k: n for k, (_, n) in links.items()} == {k: len(v) for k, v in partners.items()}
    assert all(c <= i for (_, i), (c, _) in links.items())
    assert lookalike.same_look_pairs(lookalike.same_look_rows(df.limit(0))).count() == 0
    freq = dict(lookalike.member_frequency(df, "text"))
    assert freq["ﬁ"] == sum(t.count("ﬁ") for *_, t in all_rows) and freq["а"] == sum(unicodedata.normalize("NFD", t).count("а") for *_, t in all_rows)


RESIDUE = ["tell {{contact}} about {{ topic }}", "<NAME> tomorrow, <TEXT>", "call %s at %d", "@@phrase_7@@", "502 Bad Gateway nginx", "Lorem ipsum dolor sit amet", "уоur tехt hеrе", "[ru] поставь таймер", "#REF!", "НЕ НАЙДЕНА СТРАНИЦА"]
REAL = ["make a note under Bob, gate code <4417>", "remember about Bob: null is not zero", "tell Bob the page was not found in the binder", "text Bob that 50% of the rent is due", "remember about Bob: shelf [b] is full", "search online for how to enable javascript on Kolu", "call Traceback"]


def test_residue(spark):
    filler = [(f"tell Name{i} the kitten slept on the printer number {i}",) for i in range(400)] + [(None,), ("",), ("  ",)]
    df = spark.createDataFrame([(x,) for x in RESIDUE + REAL] + filler, "text string")
    out = {r.text: r.is_residue for r in residue.split_residue(df, "text").collect()}
    assert {x for x in RESIDUE if not out[x]} == set() and {x for x in REAL if out[x]} == set()
    assert not out[None] and not out[""] and not out["  "]
    assert residue.split_residue(df.limit(0), "text").count() == 0


def test_entries_leave_out_blank(spark):
    c = spark.createDataFrame([(1, "x"), (2, None), (3, " \t")], "canon_id long, input string")
    m = spark.createDataFrame([(1, {"greek": "y", "thai": None}), (2, None)], "ml_id long, inputs map<string,string>")
    assert {(r.src, r.lang, r.id) for r in residue.entries(c, m).collect()} == {("canonical", "", 1), ("multilingual_intents", "greek", 1)}


def test_wide_look_alikes():
    for a, b in (("𝐜𝐚𝐥𝐥 𝟙", "call 1"), ("ϲall", "call"), ("Ꭺnn", "Ann"), ("Տam", "Sam"), ("ｃａｌｌ", "call"), ("ℓist", "list"), ("cafe\u0301", "café")):
        assert lookalike.fold(a) == b, a
    for odd in ("ё", "й", "한글", "क़", "Å", "ﬁ", "é́", "ώρα", "가"):
        assert lookalike.fold(odd) == lookalike.fold(unicodedata.normalize("NFD", odd))


def test_key_tokens_miss_no_exemplar(spark):
    """Where the JVM says that a text can hold nothing, its coverage is 0; the idf holds pieces of spaceless words."""
    words = sorted({w for x in residue.WHOLE for w in x.split()}) + ["bob", "the", "aaa", "7", "{x}", "%s", "a", "to"]
    texts = [" ".join(words[(i * 7 + j * (i % 13 + 1)) % len(words)] for j in range(1 + i % 6)) for i in range(1500)] + ["页面不存在", "页面"] * 3
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    idf, top = residue.document_frequency(df, "t")
    assert "页面" in idf and "页面不存在" not in idf
    got = {r.t: r.coverage for r in residue.residue_scores(df, "t", df, "t").collect()}
    want = {x: residue.coverage(residue.tokens(residue.visible(x)), idf, top, residue.index()) for x in texts}
    assert [(x, got[x], w) for x, w in want.items() if abs(got[x] - w) > 1e-12] == []
