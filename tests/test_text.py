"""Goldens of routing, predicates and cleaning."""

from pyspark.sql import functions as F

from kordel.functions import predicates as P
from kordel.functions import scripts as C
from kordel.functions import text as B

ROUTES = {
    "": "english", "   ": "english", "123 456": "english", "××××": "english", "Hello 世界": "english", "ab 世界": "cjk", "abcdef дддд": "english", "abcd дддд": "cyrillic", "բարեւ": "english",
    "获取当前时间": "cjk", "مرحبا بالعالم": "arabic", "Москва": "cyrillic", "नमस्ते": "indic", "สวัสดี": "southeast_asian", "ሰላም": "ethiopic", "שלום": "hebrew", "γειά": "greek",
}


def test_route(spark):
    df = spark.createDataFrame([(k, v) for k, v in ROUTES.items()] + [(None, "english")], "t string, want string")
    assert df.where(C.route(F.col("t")) != F.col("want")).collect() == []
    assert df.where("t = 'ab 世界'").select(C.is_mixed(F.col("t"))).first()[0]


PREDICATES = {
    "a 22222": (True, False, False, True), "go go go": (False, False, True, False), "go go go go": (False, True, True, False), "да да да да": (False, True, True, False),
    "\n\n\n\n": (False, False, False, False),
}


def test_predicates(spark):
    df = spark.createDataFrame([(k,) for k in PREDICATES], "t string")
    t = F.col("t")
    rows = df.select("t", P.repeated_chars(t), P.repeated_tokens(t), P.repeated_words(t), P.digit_spam(t)).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == PREDICATES
    hindi = spark.createDataFrame([(" ".join(["हिन्दी"] * 4),)], "t string").select(P.repeated_chars(t), P.repeated_tokens(t), P.digit_spam(t)).first()
    assert tuple(hindi) == (False, False, False)


def test_strict_line(spark):
    rows = {"": ("format", None), "x\ny": ("multi_line", None), "time.now": ("no_dot", None), "\n . a \n": (None, ". a"), None: ("format", None)}
    df = spark.createDataFrame([(k,) for k in rows], "r string")
    assert {r.r: (r[1], r[2]) for r in df.select("r", B.strict_reason(F.col("r")), B.strict_line(F.col("r"))).collect()} == rows


def test_spans(spark):
    df = spark.createDataFrame([("Send Bob hi", {"to": "bob"}), ("Send Bob hi", {"to": "eve"}), ("start a 30 second timer", {"d": "30 seconds"}), ("any", {})], "t string, p map<string,string>")
    assert [r[0] for r in df.select(P.repair_spans(F.col("p"), F.col("t"))).collect()] == [{"to": "Bob"}, None, None, {}]


def test_cleaning(spark):
    df = spark.createDataFrame([("x. <OUTPUT>. a.b\nc</s>", "OUTPUT: time.now\nmore", 'no {"a": 1} x')], "a string, b string, c string")
    r = df.select(B.extract_program(F.col("a")), B.teacher_line(F.col("b")), B.extract_json(F.col("c")), B.clean_output(F.col("b")), B.extract_program_respaced(F.lit(". a :k = 1;b"))).first()
    assert tuple(r) == (". . a.bc", ". time.now", '{"a": 1}', ". OUTPUT: time.now", ". a :k=1 ; b")
