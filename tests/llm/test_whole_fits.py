"""Models of problem 7 are counted over all rows, however many and however long."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kordel.common import table
from kordel.llm import defects, language

OPS = frozenset("message.send payment.send memory.store call.start time.now timer.set".split())


def test_contexts_count_every_row(spark):
    """A rare argument whose values rightly end inside words: a sample of a third of the rows has too few of them."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2400 == 0, "wake Bobby").otherwise("call Ann").alias("text"),
        F.when(F.col("id") % 2400 == 0, '. timer.set :label="Bob"').otherwise('. call.start :to="Ann"').alias("answer"),
        "id",
    )
    ends = defects.fit_contexts(rows, OPS, ["id"])
    assert ends.n["label", "LATIN"] == ends.n["label", "LATIN", "same"] == 25 and ends.n["to", "LATIN"] == 59_975
    assert not ends.cut_off("label", defects.Letters("wake Bobby"), "Bob") and ends.cut_off("to", defects.Letters("call Anna"), "Ann")


def test_contexts_count_long_rows(spark):
    rows = spark.createDataFrame([(i, "wake Bobby " + "x" * 5000, '. timer.set :label="Bob"') for i in range(30)], "id long, text string, answer string")
    assert defects.fit_contexts(rows, OPS, ["id"]).n["label", "LATIN", "same"] == 30


def test_contexts_of_all_tasks_are_those_of_one(spark, monkeypatch):
    """Also where a task hands on its counts now and then, and for names that no string column holds."""
    pairs = defects.pairs_of(table(spark, "/root/testdata/sf0.001", "canonical"), table(spark, "/root/testdata/sf0.001", "distill")).select("text", "answer")
    odd = spark.createDataFrame([("call Bob", '{"intent": "call.start", "params": {"\\ud800": "Bob"}}')] * 25, pairs.schema)
    pairs = pairs.unionByName(odd)
    ops = frozenset(r.op.lower() for r in table(spark, "/root/testdata/sf0.001", "op_registry").select("op").collect())
    want = defects.TerminalContexts([(r.text, r.answer) for r in pairs.where("answer is not null").collect()], ops).n
    monkeypatch.setattr(defects, "_HELD", 5)
    got = defects.fit_contexts(pairs, ops).n
    assert got["\ud800", "LATIN"] == 25
    kept = [k for k in want if len(k) == 2 and want[k] >= defects.FEW]
    assert len(kept) > 3 and {k: [got[x] for x in (k, (*k, "same"), (*k, "other"))] for k in kept} == {k: [want[x] for x in (k, (*k, "same"), (*k, "other"))] for k in kept}
    assert not [k for k in got if len(k) == 2 and k not in kept]


def _by_one_task(pairs):
    """known words and n-gram logs of (language, text) pairs, and how the second fit chooses its rows, in plain Python."""
    counts = {x: Counter() for x in language.LANGUAGES}
    for lang, text in pairs:
        counts[lang].update(language.words(language.plain(text)))
    sums = {x: sum(c.values()) + 1 for x, c in counts.items()}
    known = {w: v for w in set().union(*counts.values()) if (v := language.known_vector(w, [counts[x][w] for x in language.LANGUAGES], sums))}
    grams = [defaultdict(Counter) for _ in language.GRAMS]
    for i, x in enumerate(language.LANGUAGES):
        for w, n in counts[x].items():
            p = f"<{w}>"
            for g, size in zip(grams, language.GRAMS, strict=True):
                for a in range(len(p) - size + 1):
                    g[p[a : a + size]][i] += min(n, 50)
    mass = [[1 + sum(c[i] for c in g.values()) for i in range(len(language.LANGUAGES))] for g in grams]
    logs = {k: [math.log((c[i] + 1e-2) / mass[j][i]) for i in range(len(language.LANGUAGES))] for j, g in enumerate(grams) for k, c in g.items() if sum(c.values()) >= 3}
    return known, logs


def test_language_model_of_all_tasks_is_that_of_one(spark, monkeypatch):
    rows = table(spark, "/root/testdata/sf0.01", "families")
    pairs = [(r.l, r.input) for r in rows.select(language.language_name(F.col("language")).alias("l"), "input").where("l is not null and trim(input) != ''").collect()]
    first = language.Model(_by_one_task(pairs)[0])
    known, logs = _by_one_task([(a, b) for a, b in pairs if len(s := first.segments(b)) == 1 and s[0][0] == a])
    monkeypatch.setattr(language, "_HELD", 5000)
    m = language.fit(rows, "input", "language", ["fam_id"])
    assert len(known) > 50 and m.known == known
    assert len(logs) > 1000 and set(m.grams) == set(logs) and all(abs(m.logs[k] - logs[g]).max() < 1e-9 for g, k in m.grams.items())


def test_language_model_counts_every_row(spark):
    """A word of a few rows among many, and one of long texts only: both are too rare in a sample or left out of it."""
    many = spark.range(150_000).select(
        F.when(F.col("id") % 2_000 == 0, "zumbral verrin").when(F.col("id") % 2 == 0, "turn the kettle on").otherwise("llama por favor mañana").alias("t"),
        F.when(F.col("id") % 2 == 0, "english").otherwise("spanish").alias("l"),
        "id",
    )
    long = spark.range(40).select(F.concat(F.repeat(F.lit("turn the kettle on "), 150), F.lit("quoxley")).alias("t"), F.lit("english").alias("l"), (F.col("id") + 1_000_000).alias("id"))
    known = language.fit(many.unionByName(long), "t", "l", ["id"]).known
    assert {"zumbral", "quoxley", "kettle", "favor"} <= set(known)


def test_language_model_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, t string, l string")
    assert language.fit(none, "t", "l", ["id"]).segments("call Bob")[0][0] is None
