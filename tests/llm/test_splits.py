"""Problem 5: components against union-find, and the persisted store."""

import random

from pyspark.sql import functions as F

from kordel.llm import splits


def _roots(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [(f"n{r.randint(100, 400)}", f"n{r.randint(100, 400)}") for _ in range(150)] + [("hub", f"h{i}") for i in range(50)] + [("s", "s")]
    df = spark.createDataFrame(edges + [(None, "q")], "a string, b string")
    got = {x.node: x.component for x in splits.components(df).collect()}
    assert got == _roots(edges) | {"q": "q"}


def test_mentions(spark):
    e = spark.createDataFrame([(1, "Bobo"), (2, "Kalo"), (3, "Mary Ann"), (4, None)], "entity_id long, entity_name string")
    rows = spark.createDataFrame([(1, "BOBO", "kalo,x"), (2, "Bobox", None), (3, "给Bоbо块", "mary  ann"), (4, None, None), (5, "Bo​bo5", "ann mary")], "id long, a string, b string")
    got = {(x.id, x.entity) for x in splits.mentions(rows, "id", ["a", "b"], e).collect()}
    assert got == {(1, "bobo"), (1, "kalo"), (3, "bobo"), (3, "mary ann"), (5, "bobo")}


def test_store_keeps_splits_and_quarantines_conflicts(spark, tmp_path):
    e = spark.createDataFrame([(i, f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(200)], "entity_id long, entity_name string")
    first = spark.createDataFrame([(i, f"call Name{chr(97 + i // 26)}{chr(97 + i % 26)}", None) for i in range(200)], "id long, a string, b string")
    store = splits.SplitStore(spark, f"file://{tmp_path}/store")
    shares = {"train": 0.5, "test": 0.5}
    one = {r.id: r.split for r in store.update(first, "id", ["a", "b"], e, shares).collect()}
    assert len(one) == 200 and 60 < sum(v == "train" for v in one.values()) < 140
    train, test = [next(i for i in one if one[i] == s) for s in ("train", "test")]
    name = lambda i: f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}"
    same = [i for i in one if one[i] == "train"][1]
    second = spark.createDataFrame([(1000, f"{name(train)} {name(test)}", None), (1001, name(same), None), (1002, None, None)], "id long, a string, b string")
    two = {r.id: r.split for r in store.update(second, "id", ["a", "b"], e, shares).collect()}
    assert two[1000] == splits.QUARANTINE and two[1001] == "train" and two[1002] in shares
    assert store.generation() == 2


def test_names_with_digits_marks_and_other_scripts(spark):
    names = ["Project 7", "Project 8", "O'Brien", "北京", "Ann", "R2-D2"]
    e = spark.createDataFrame(list(enumerate(names)), "entity_id long, entity_name string")
    rows = {1: "open project 7 now", 2: "open project", 3: "the o, brien", 4: "ask O'BRIEN", 5: "我在北京工作", 6: "Anna", 7: "5Ann5 (r2-d2)", 8: "project 75", 9: "project  8"}
    df = spark.createDataFrame(list(rows.items()), "id long, a string")
    got = {(x.id, x.entity) for x in splits.mentions(df, "id", ["a"], e).collect()}
    assert got == {(1, "project 7"), (4, "o'brien"), (5, "北京"), (7, "ann"), (7, "r2-d2"), (9, "project 8")}


def test_batches_end_in_the_components_of_all_rows(spark, tmp_path):
    r = random.Random(7)
    name = lambda i: f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}"
    e = spark.createDataFrame([(i, name(i)) for i in range(120)], "entity_id long, entity_name string")
    told = {i: [r.randrange(120) for _ in range(r.choice((0, 1, 1, 2)))] for i in range(240)}
    df = spark.createDataFrame([(i, " and ".join(map(name, x)) or None) for i, x in told.items()], "id long, a string")
    store = splits.SplitStore(spark, f"file://{tmp_path}/store")
    before = {}
    for k in range(3):
        store.update(df.where(F.col("id") % 3 == k), "id", ["a"], e, {"train": 0.7, "test": 0.3})
        now = {x.id: (x.component, x.split) for x in store.members().collect()}
        assert len(now) == 80 * (k + 1)
        assert all(now[i][1] in (s, splits.QUARANTINE) for i, (_, s) in before.items())
        before = now
    roots = _roots([(f"n{x[0]}", f"n{y}") for x in told.values() if x for y in x])
    groups = {}
    for i, (c, s) in before.items():
        groups.setdefault(c, set()).add((i, s))
    want = {}
    for i, x in told.items():
        want.setdefault(roots[f"n{x[0]}"] if x else i, set()).add(i)
    assert sorted(sorted(i for i, _ in g) for g in groups.values()) == sorted(map(sorted, want.values()))
    assert all(len({s for _, s in g}) == 1 for g in groups.values())
    assert any(s == splits.QUARANTINE for _, s in before.values())


def test_empty(spark, tmp_path):
    e = spark.createDataFrame([], "entity_id long, entity_name string")
    rows = spark.createDataFrame([(1, "x")], "id long, a string")
    assert splits.mentions(rows, "id", ["a"], e).count() == 0
    store = splits.SplitStore(spark, f"file://{tmp_path}/store")
    assert store.update(rows, "id", ["a"], e, {"train": 1.0}).count() == 1 and store.update(rows.limit(0), "id", ["a"], e, {"train": 1.0}).count() == 0
    assert [(r.id, r.split) for r in store.members().collect()] == [(1, "train")]
