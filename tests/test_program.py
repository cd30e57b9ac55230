"""Micro-goldens of the command language, and an independent scanner."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kordel.functions import program as A
from kordel.functions import text as B
from kordel.operators import registry as D

GOLDENS = {
    ".now": ". time.now",
    ". NOW": ". time.now",
    ". Time.Now": ". Time.Now",
    '. b.c :z="2" :a=1 ; b.c :a="1" :z=2': '. b.c :a="1" :z="2"',
    ". time.now -> time.now ; time.date ; time.now": ". time.now ; time.date",
    ". ;; time.now": ". time.now",
    '. memory.store :text="a;b -> c"': '. memory.store :text="a;b -> c"',
    '. memory.store :text="a\\"b"': '. memory.store :text="a\\"b"',
    '. memory.store :text="a\\nb"': '. memory.store :text="anb"',
    ". x.y :k=a :k=b": '. x.y :k="b"',
    ". x.y :a= :b=1": '. x.y :a=":b=1"',
    "now": None,
    ".": None,
    ". ->": None,
    ". frobnicate": None,
    ". x.y :k=": None,
    ". x.y :1k=v": None,
    '. x.y :k="open': None,
    "": None,
}
ERRORS = {"now": "must start with '.'", ".": "no operations", ". ->": "no operations", ". x.y :k=": "missing value", ". x.y :1k=v": "invalid key", '. x.y :k="open': "unterminated", ". x.y :k": "missing =", ". x.y z": "expected :key=value", ". x! :k=v": "invalid op"}


def test_canonicalize(spark):
    df = spark.createDataFrame([(k,) for k in GOLDENS] + [(None,)], "p string")
    out = {r.p: r.c for r in df.select("p", A.canonicalize(A.parse(B.sanitize(F.col("p")))).alias("c")).collect()}
    assert out == GOLDENS | {None: None}


@pytest.mark.parametrize("program,error", ERRORS.items())
def test_errors(program, error):
    assert A.parse_text(program) == (None, error)


def _scan(s):
    """Character by character, written apart from the implementation."""
    out, cur, quoted, skip = [], "", False, False
    for i, c in enumerate(s):
        if skip == "arrow":
            skip = False
            continue
        if skip:
            cur, skip = cur + c, False
        elif quoted and c == "\\":
            cur, skip = cur + c, True
        elif c == '"':
            cur, quoted = cur + c, not quoted
        elif not quoted and c == ";":
            out, cur = [*out, cur.strip()], ""
        elif not quoted and s[i : i + 2] == "->":
            out, cur, skip = [*out, cur.strip()], "", "arrow"
        else:
            cur += c
    return [x for x in [*out, cur.strip()] if x]


def test_split_against_a_scanner():
    r = random.Random(5)
    for _ in range(3000):
        s = "".join(r.choice(['a', ' ', ';', '-', '>', '->', '"', '\\', ':', '=', 'x.y', '\n']) for _ in range(r.randint(0, 14)))
        assert A.split_chain(s) == _scan(s), s


def test_canonicalize_is_idempotent_and_serialize_inverts_parse(spark):
    r = random.Random(6)
    rows = []
    for _ in range(300):
        ops = " ; ".join(f"{r.choice(['a.b', 'now', 'x.y.z'])} " + " ".join(f':{r.choice("klm")}="{r.choice(["v", "a;b", "q->r", "", "é"])}"' for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 4)))
        rows.append((f". {ops}",))
    df = spark.createDataFrame(rows, "p string")
    once = df.select(A.canonicalize(A.parse("p")).alias("c")).where("c is not null")
    twice = once.select("c", A.canonicalize(A.parse("c")).alias("cc"), A.serialize(A.parse("c")["ops"]).alias("s"))
    assert twice.where("c != cc or c != s or cc is null").count() == 0


def test_fingerprint_and_hash(spark):
    df = spark.createDataFrame([('. time.now ; memory.store :text="hello"',)], "p string")
    fp, h = df.select(A.fingerprint(A.parse("p")["ops"]), A.program_hash(A.parse("p")["ops"])).first()
    assert fp == "time.now|memory.store:text=hello"
    assert h == "319cd516c0ca3c5212d1756dc56e309af8e2c3886d518ffc23b1b33a04eb8fd6" == hashlib.sha256(fp.encode()).hexdigest()


def test_atoms_and_legacy(spark):
    df = spark.createDataFrame([('. memory.store :text="a b"', ".now :a=1"), ("", "x"), (None, None)], "p string, q string")
    rows = df.select(A.scan_atoms("p").alias("a"), A.legacy_alias_fix(F.col("q")).alias("f")).collect()
    assert rows[0].a == [".", "memory.store", ":", "text", "=", '"a b"'] and rows[0].f == ".time.now :a=1"
    assert rows[1].a == [] and rows[1].f == "x" and rows[2].a is None and rows[2].f is None


def test_loose_parse_last_key_wins(spark):
    df = spark.createDataFrame([('. a.b :k="1" ; c.d :k=2 :m="x y"',), ("",), (".a.b",)], "p string")
    rows = [r.l for r in df.select(A.loose_parse(F.col("p")).alias("l")).collect()]
    assert (rows[0].intent, rows[0].params) == ("a.b", {"k": "2", "m": "x y"})
    assert (rows[1].intent, rows[1].params) == ("", {}) and rows[2].intent == "a.b"


def test_missing_fields(spark):
    rows = [("payment.send", ["to"]), ("payment.request", ["from", "amount"]), ("unknown.op", []), ("time.timezone", ["value"]), (None, [])]
    df = spark.createDataFrame(rows, "op string, have array<string>")
    want = [["amount"], ["from_"], [], ["zone"], []]
    assert [r.missing for r in D.missing_fields(df, "op", F.col("have")).collect()] == want
    joined = D.missing_fields(df, "op", F.col("have"), D.ops_table(spark))
    assert sorted(map(str, (r.missing for r in joined.collect()))) == sorted(map(str, want))
