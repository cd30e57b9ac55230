"""Order-dependent operators, expansion, readers and sinks on small fixtures."""

import json

from pyspark.sql import functions as F

from kordel.common import norm_key
from kordel.operators import accept as R
from kordel.operators import aggregates as H
from kordel.operators import expand as E
from kordel.operators import order as O
from kordel.operators import validate as V
from kordel.plans import catalog
from kordel.plans.stubs import echo_model
from kordel.sources import readers, sinks


def _query(spark, name, **tables):
    """The registered query over tables of the test's own."""
    import tempfile

    d = tempfile.mkdtemp()
    for t, df in tables.items():
        df.write.parquet(f"{d}/{t}.parquet")
    return catalog.QUERIES[name](spark, d)


def _rows(spark):
    return spark.createDataFrame([(3, "A", "x"), (1, " a ", "y"), (2, "b", "x"), (5, None, "x"), (6, None, "z"), (4, "a", "y")], "id long, t string, v string")


def test_first_wins_and_labels(spark):
    df = _rows(spark)
    assert sorted(r.id for r in O.first_wins(df, [norm_key(F.col("t"))], ["id"]).collect()) == [1, 2, 5]
    assert O.first_wins(df.limit(0), [F.col("t")], ["id"]).count() == 0
    later = {r.id: r.is_later for r in O.label_later(df, norm_key(F.col("t")), ["id"], F.col("id") != 1).collect()}
    assert later == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert {r.id for r in O.conflicts(df.where("t is not null"), [norm_key(F.col("t"))], "v", ["id"]).where("is_conflict").collect()} == {3}


def test_stop_at_matches_a_loop(spark):
    flags = [(i, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(flags, "id long, ok boolean").repartition(7)
    kept, n = [], 0
    for i, ok in flags:
        if n >= 10 or i >= 1000:
            break
        kept.append(i)
        n += ok
    assert sorted(r.id for r in O.stop_at(df, F.col("ok"), "id", 10).collect()) == kept


def test_stop_at_counts_attempts(spark):
    """The order column's values play no part, only how many rows were tried."""
    df = spark.createDataFrame([(10_000_000 + 7 * i, i % 2 == 0) for i in range(40)], "id long, ok boolean").repartition(5)
    kept = lambda **k: sorted((r.id - 10_000_000) // 7 for r in O.stop_at(df, F.col("ok"), "id", **k).collect())
    assert kept(n=3) == [0, 1, 2, 3, 4]
    assert kept(n=3, attempts=4) == [0, 1, 2, 3] and kept(n=100, attempts=7) == list(range(7)) and kept(n=0) == []
    assert kept(n=1000) == list(range(40)) and O.attempt_limit(3) == 5003 and O.attempt_limit(100) == 20000
    assert [O.target_count(n) for n in (1, 100, 500, 5000)] == [100, 100, 500, 1000]
    assert O.stop_at(df.limit(0), F.col("ok"), "id", 3).count() == 0


def test_first_wins_by_digest(spark):
    df = _rows(spark)
    assert sorted((r.id, r.t, r.v) for r in O.first_wins(df, [norm_key(F.col("t")), F.col("v")], ["id"], unique=True).collect() if r.t) == [(1, " a ", "y"), (2, "b", "x"), (3, "A", "x")]
    assert sorted(r.id for r in O.first_ids(df, [F.col("t")], "id").collect()) == [1, 2, 3, 4, 5]
    pairs = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, None, "abc"), (4, "", "abc"), (5, "a", "bc")], "id long, x string, y string")
    assert sorted(r.id for r in O.first_ids(pairs, [F.col("x"), F.col("y")], "id").collect()) == [1, 2, 3, 4]


def test_bounded_sample(spark):
    """Neither a tiny share nor one text in half the rows empties the sample or makes it explode."""
    from kordel.common import bounded_sample

    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    got = bounded_sample(df, ["id"], 1000).toPandas()
    assert 800 < len(got) < 1200 and 350 < (got["t"] == "same").sum() < 650
    assert bounded_sample(df, ["id"], 1000, of=20_000_000_000_000).count() <= 1  # the share is 5e-11
    assert bounded_sample(df, ["t"], 1000).count() <= 2000  # a bad key: the bound holds
    assert bounded_sample(df, ["id"], 20_000).count() == 20_000 and bounded_sample(df.limit(0), ["id"], 5).count() == 0


def test_shared_folder_is_never_local_on_a_cluster(monkeypatch):
    from kordel import common

    class Conf:
        get = staticmethod(lambda k, d=None: None)

    class Session:
        conf = Conf

        class sparkContext:
            applicationId, master = "app-x", "spark://host:7077"
            getConf = staticmethod(lambda: Conf)

    import pytest

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session).startswith("file:///") and common.shared_dir(Session) == common.shared_dir(Session)


def test_accept_cascade(spark):
    raws = ["", ". a.b\n. c.d", "x", ". x.y :k=", ". nope", ". " + " ; ".join(f"a.b{i}" for i in range(7)), ". time.now", ". now", ". a.b :k=1"]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    got = {r.id: r.reason for r in R.judge(df, "raw", ["id"]).collect()}
    assert [got[i] for i in range(9)] == ["format", "multi_line", "no_dot", "parse_error", "parse_error", "too_long", None, "duplicate", None]


def test_variations_and_histogram(spark):
    df = spark.createDataFrame([(1, "call Bob"), (2, "CALL bob "), (3, None), (4, "zzz")], "id long, t string")
    out = [(r.id, r.variation) for r in E.variations(df, "t", ["id"]).collect()]
    assert (1, "ring bob") in out and (4, "zzz") in out and not any(i == 3 for i, _ in out)
    assert [r["count"] for r in H.length_histogram(df, F.length("t")).collect()] == [0, 0, 1, 0, 0, 0, 0, 1, 1, 0, 0]


def test_validators(spark):
    good, bad = '. a.b :k="1"', ". a.b :k=1"
    df = spark.createDataFrame([(1, good, "x", "english", "english"), (2, bad, "y", "english", "english"), (3, None, "z", "english", "english"), (4, '. c.d', " X", "english", "english"), (5, good, "[XX] y", "english", "english")], "id long, intent string, input string, language string, family string")
    got = {(r.id, r.message) for r in V.family_findings(df, "id").collect()}
    assert got == {(2, "not_canonical"), (3, "missing_intent"), (4, "conflict"), (5, "fake_marker")}
    assert V.gate(V.family_findings(df, "id")).first().exit_code == 1
    multi = spark.createDataFrame([(1, good, {"english": "pay 5", "thai": "pay 5 "}), (2, good, None), (3, good, {})], "id long, intent string, inputs map<string,string>")
    assert {(r.id, r.message) for r in V.multilingual_findings(multi, "id").collect()} == {(1, "same_as_english: thai"), (2, "missing_inputs"), (3, "no_inputs")}


def test_readers_and_sinks(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"intent": "i", "input": "a"}\n\nnot json\n{"intent": "j", "input": "b"}', encoding="utf-8")
    rows = readers.numbered_lines(spark, str(f), "intent string, input string").orderBy("line").collect()
    assert [(r.line, r.intent, r.error) for r in rows] == [(1, "i", None), (3, None, "json"), (4, "j", None)]
    assert readers.jsonl(spark, str(f), "intent string, input string", bad="skip").where("intent is not null").count() == 2
    at = str(tmp_path / "out")
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    sinks.write_jsonl(base, at)
    sinks.append_new(spark.createDataFrame([("B", 3), ("c", 4), ("C", 5)], "k string, n long"), at, norm_key(F.col("k")), ["n"])
    assert sorted(r.n for r in spark.read.json(at).collect()) == [1, 2, 4]
    sinks.rewrite(spark.read.schema("k string, n long").json(at).where("n > 1"), at)
    assert sorted(r.n for r in spark.read.json(at).collect()) == [2, 4]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"version": "1", "families": {"greek": {"gguf": "g", "adapter": "a", "base_model": "b", "size_mb": 1.5}}}), encoding="utf-8")
    r = readers.manifest(spark, str(m)).first()
    assert (r.family, r.version, r.size_mb, r.is_default) == ("greek", "1.0", 1.5, False)
    sinks.update_manifest(str(m), "greek", "ff", 2.25)
    assert json.loads(m.read_text())["families"]["greek"]["sha256"] == "ff"


def test_inference(spark):
    df = spark.createDataFrame([(1, "获取当前时间获取当前时间获取当前时间"), (2, "hi")], "id long, t string")
    got = {r.id: (r.family, r.status) for r in R.infer(df, "t", {}, echo_model).collect()}
    assert got == {1: ("cjk", "INVALID"), 2: ("english", "INVALID")}


def test_stream_twin(spark, tmp_path):
    from kordel.streaming import rowwise

    src = str(tmp_path / "src")
    spark.createDataFrame([(1, ".now"), (2, ". x")], "id long, intent string").write.parquet(src)
    s = rowwise.canonicalized(spark.readStream.schema("id long, intent string").parquet(src), "intent")
    q = s.writeStream.format("memory").queryName("twin").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.program for r in spark.sql("select id, program from twin").collect()} == {1: ". time.now", 2: None}


def test_vocabulary_keeps_all_used_ids(spark):
    tokens = ["alpha", "be", "gamma", "d", "e\n", "zeta", "eta", "θ"]
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(tokens, 1)], "id long, token string")
    for used in ([], [6], [1, 3, 6], [1, 3, 5, 6, 7]):
        for target in (0, 2, 4, 100):
            rest = sorted((i for i in range(1, 9) if i not in used), key=lambda i: (not (len(tokens[i - 1]) <= 3 and tokens[i - 1].isprintable()), i))
            want = sorted(used + rest[: max(0, target - len(used))])
            out = H.vocabulary_top_up(vocab, spark.createDataFrame([(i,) for i in used], "id long"), target).orderBy("id").collect()
            assert [(r.id, r.new_id) for r in out] == [(i, k) for k, i in enumerate(want)], (used, target)


def test_training_rows_keep_params(spark):
    whole = ['{"intent": "a.b", "params": {"to": "Bob", "n": 75, "deep": {"z": [1, null], "a": 1.50}}, "missing": []}', '{"params": {}, "intent": null}', '{"intent": "a.b", "params": {"text": "a \\"b\\" \\n \\/ é 鍵 \\ud83d\\ude00"}}']
    none = ['{"intent": "a.b"}', '{"params": {}}', "[1]", '"x"', "null", '{"intent": "a', ". a.b", "", None]
    df = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(whole + none)] + [("", whole[0]), (None, whole[0])], "input string, output string")
    want = {f"i{i}": json.dumps({k: json.loads(t)[k] for k in ("intent", "params")}, ensure_ascii=False) for i, t in enumerate(whole)}
    assert {r.input: r.output for r in _query(spark, "r4_training_rows", distill=df).collect()} == want
    assert readers.skipped(df).first().skipped == len(none) + 2


def test_valid_rows_are_canonical(spark):
    rows = {1: (". now", "x"), 2: ('. a.b :z=1 :a="2"', ""), 3: ('. a.b :k="open', "x"), 4: (". nope", "x"), 5: ("the time please", "x"), 6: ("", "x"), 7: (None, "x"), 8: (". now ; time.now ; a.b", None), 9: (". a.b :k=", "x")}
    df = spark.createDataFrame([(i, a, b, "english", "english") for i, (a, b) in rows.items()], "fam_id long, intent string, input string, language string, family string")
    got = {r.fam_id: (r.input, r.program) for r in _query(spark, "r2_r3_valid_rows", families=df).collect()}
    assert got == {1: ("x", ". time.now"), 2: ("", '. a.b :a="2" :z="1"'), 8: ("", ". time.now ; a.b")}


def test_params_json_of_all_rows(spark):
    odd = "".join(map(chr, range(1, 0xA0))) + "\u2028é鍵😀\ufeff"
    rows = {1: {"b": None, "a": "x"}, 2: {"é": "a/b", "z": "a\nb\tc", "Z": '"\\"'}, 3: {"k": odd}, 4: {}, 5: {"only": None}, 6: {"😀": "1", "\uffee": "2", 'q"\n': "3"}}
    df = spark.createDataFrame([*rows.items(), (7, None)], "ml_id long, inputs map<string,string>")
    got = {r.ml_id: r.params for r in _query(spark, "b14_params_json", multilingual_intents=df).collect()}
    same = lambda t: json.dumps(json.loads(t), ensure_ascii=False)  # noqa: E731  the order of the keys stays, hex digits of escapes become small
    assert {i: same(t) for i, t in got.items()} == {i: json.dumps(m, sort_keys=True, ensure_ascii=False) for i, m in rows.items()}


def test_teacher_output_is_rejected(spark):
    kept = {"OUTPUT: time.now\nmore": ". time.now", "<OUTPUT> . a.b :k=\"x y\" ; c.d</s>": '. a.b :k="x y" ; c.d', ". now<END>": ". now", ". a.b " + " ; ".join(f"c{i}" for i in range(2)): None, ". " + " ; ".join(["a.b"] * 10): ". " + " ; ".join(["a.b"] * 10)}
    gone = ["", None, "<END>", "OUTPUT:", ". aaaa.b", '. a.b :k="go go go go"', ". " + " ; ".join(["a.b"] * 11), ". 12 : 3", "42", "I cannot do that", '. a.b :k="open', '{"intent": "a.b"}', ". a.b :k="]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*kept, *gone])], "distill_id long, output string")
    got = {r.distill_id: r.clean for r in _query(spark, "b8_clean_teacher_output", distill=df).collect()}
    assert [got[i] for i in range(len(got))] == [*kept.values(), *[None] * len(gone)]
