"""Problems 1 and 2 against brute force on small, dirty tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

from kordel.llm import copies, frequency


def test_frequencies_against_brute_force(spark):
    rows = [(1, "a", "Foo bar foo", 9), (2, None, "", 9), (3, "a", None, 9), (4, "", "  !! ", 9), (5, "b", "été ÉTÉ x1", 9), (6, "b", "long " * 5000, 9)]
    df = spark.createDataFrame(rows, "id long, intent string, input string, kind long")
    got = {(r.kind, r.val): (r.occurrences, r.records) for r in frequency.frequencies(df, {"intent": "intent"}, {"term": "input"}).collect()}
    want_occ, want_rec = Counter(), Counter()
    for _, a, b, _ in rows:
        if a is not None:
            want_occ["intent", a] += 1
            want_rec["intent", a] += 1
        if b is not None:
            t = re.findall(r"\w+", b.lower())
            want_occ.update(("term", x) for x in t)
            want_rec.update(("term", x) for x in set(t))
    assert got == {k: (want_occ[k], want_rec[k]) for k in want_occ}
    assert frequency.frequencies(df.limit(0), {"intent": "intent"}, {"term": "input"}).count() == 0
    marks = {r.val: r.mark for r in frequency.marked_frequencies(df, {"intent": "intent"}, {}, common_above=0.3).collect()}
    assert marks == {"a": "rare", "b": "rare", "": "rare"}


SAME = [
    ("Wake Bob at 9:00", '. alarm.set :time="9:00" :label="Bob"'), (" wake BOB, at 9.00!", '.ALARM.SET :label=Bob\t:time = "9:00" ;'),
    ("wake Bob at 9:00", '. alarm.set :time="9:00" :label="Bob" ; -> ;'),
]
OTHER = [
    ("wake Bob at 900", '. alarm.set :time="9:00" :label="Bob"'), ("wake Bob at 9:00", '. alarm.set :time="9:00" :label="Bobo"'), ("wake Bob at 9:00", None), (None, '. alarm.set :time="9:00" :label="Bob"'),
    ("wake Bob at 9:00", '. alarm.set :time="Bob" :label="9:00"'), ("wake Bоb at 9:00", '. alarm.set :time="9:00" :label="Bob"'), ("", ""),
]


def test_copies(spark):
    rows = [(i * 10, *x) for i, x in enumerate(SAME + OTHER)]
    df = spark.createDataFrame(rows, "id long, t string, i string").withColumn("key", F.lit("clash"))
    groups, members = copies.representatives(df, "id", "t", "i")
    assert {(r.keep_id, r.copy_id) for r in members.collect()} == {(0, 10), (0, 20)}
    assert groups.count() == 1 + len(OTHER) and groups.where("keep_id = 0").first().copies == 3
    assert copies.representatives(df.limit(0), "id", "t", "i")[1].count() == 0


def test_hot_key_is_salted_and_whole(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot ")).otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("t"), F.lit(". a.b").alias("i"))
    groups, members = copies.representatives(df, "id", "t", "i", hot_rows=500)
    assert members.count() == 999 and {r.keep_id for r in members.select("keep_id").distinct().collect()} == {0}
    assert groups.count() == 2001


def test_more_hot_keys_than_one_broadcast(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("key "), (F.col("id") % 8).cast("string")).alias("t"), F.lit(None).cast("string").alias("i"))
    groups, members = copies.representatives(df, "id", "t", "i", hot_rows=100, hot_keys=3)
    assert {(r.keep_id, r.copies) for r in groups.collect()} == {(k, 500) for k in range(8)}
    assert {(r.keep_id, r.copy_id) for r in members.collect()} == {(i % 8, i) for i in range(8, 4000)}


def test_quotes_shield_separators(spark):
    df = spark.createDataFrame([(1, "x", '. a.b :t="p; q -> r"'), (2, "x", '. a.b :t="p q r"'), (3, "x", ". a.b :t=p ; q -> r")], "id long, t string, i string")
    assert {(r.keep_id, r.copy_id) for r in copies.representatives(df, "id", "t", "i")[1].collect()} == {(1, 2)}
