"""Problems 8, 9 and 10."""

import random

import pytest

from kordel.llm import leaks, mixing, sentences


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(400):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in "xy")
        assert leaks.myers(p, t) == _distance(p, t)


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(12)]
    docs = []
    for i in range(150):
        s = "".join(c for c in r.choice(items)[1] if c != " ")
        a, n = r.randint(0, 30), r.choice([10, 38, 39, 40, 41, 60])
        part = s[a : a + n]
        if r.random() < 0.3:
            k = r.randint(0, max(0, len(part) - 1))
            part = part[:k] + "z" + part[k + 1 :]
        docs.append((i, " ".join(word() for _ in range(8)) + "! " + "-".join(part).upper() + " " + word()))
    docs += [(900, None), (901, ""), (902, "q" * 100_000), (903, docs[0][1]), (904, docs[0][1])]
    norm = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    want = set()
    for d, t in docs:
        t = norm(t)
        for i, s in items:
            s = norm(s)
            if any(s[a : a + 40] in t for a in range(len(s) - 39)):
                want.add((d, i))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = leaks.leaks(dd, "doc_id", "text", ii, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in found if r.distance == 0} == want and len(want) > 30
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(dd, "doc_id", "text", ii, "item_id", "text", errors=0).collect()} == want
    assert leaks.leaks(dd.limit(0), "doc_id", "text", ii, "item_id", "text").count() == 0
    assert leaks.leaks(dd, "doc_id", "text", ii.limit(0), "item_id", "text").count() == 0


def test_near_leaks_hold_one_edit(spark):
    s = "thequickbrownfoxjumpsoverthelazydogandrunsawayfromhere"
    near = s[:20] + "X" + s[21:45]
    dd = spark.createDataFrame([(1, near), (2, s[:25] + "XX" + s[27:40])], "doc_id long, text string")
    ii = spark.createDataFrame([(7, s)], "item_id long, text string")
    assert [(r.doc_id, r.distance) for r in leaks.leaks(dd, "doc_id", "text", ii, "item_id", "text").collect()] == [(1, 1)]


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice({"a": ["red", "blue"], "b": ["cat", "dog"], "c": ["tea", "milk"]}[s]) for _ in range(30)), s) for i, s in enumerate("a" * 300 + "b" * 60 + "c" * 100)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "cat dog cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {"a": (0.5, 1), "b": (0.5, 4)}
    members, domains = mixing.memberships(df, "doc_id", "text", "source", targets)
    rated = mixing.rates(members, domains, targets)
    tt = spark.createDataFrame([(k, *v) for k, v in targets.items()], "source string, target_share double, max_repeats long")
    out = {x.source: x for x in mixing.shares(rated, tt).collect()}
    assert abs(out["a"].actual_share - 0.5) < 0.02 and abs(out["b"].actual_share - 0.5) < 0.02
    assert out["c"].mixed_tokens == 0 and out["b"].most_repeats <= 4 and out["a"].most_repeats <= 1
    assert rated.count() == len(rows)


TEXTS = [
    ("He typed \"pay Bob 8.\" and went home. Mr. Fox saw 3.14 apples, e.g. red ones. Really?! Yes.Then he left.", ["He", "Mr.", "Really", "Yes", "Then"]),
    ("The U.S. team won. It came from the U.S. Most was noise. K. Fox and J. Ray agree at 6 a.m. Nobody else.", ["The", "It", "Most", "K.", "Nobody"]),
    ("Known limits\n \nA line\nwraps here.\n- one. two\n- three\nUser: hi. there\nSystem: ok\n. time.now\n\nEnd", ["Known", "A", "- one", "- three", "User", "System", ". time", "End"]),
    ("命令先被分成几段。「钥匙。快回答我」，他写道。真的吗？！好……但是。", ["命令", "「钥匙", "真的", "好"]),
    ("คำสั่งจะถูกแบ่งค่ะ ผู้ใช้พูดว่า \"โทร Bob\" แล้วก็รอ คุณ Bob วัดเวลาได้ 3.5 วินาทีค่ะ", ["คำสั่ง", "ผู้ใช้", "คุณ"]),
    ("Am 9. März kam es. Das gilt z. B. für alle. „Der Hund. Sag Bescheid“, schrieb Bob.", ["Am", "Das", "„Der"]),
    ("Γιατί δεν χτυπά; Ο κ. Bob ήρθε. ¿Qué? ¡No! सूची मत मिटाओ। डॉ. Bob आए।", ["Γιατί", "Ο", "¿Qué", "¡No", "सूची", "डॉ."]),
]


@pytest.mark.parametrize("text,heads", TEXTS)
def test_sentence_starts(text, heads):
    at = sentences.sentence_starts(text)
    assert [text[a : a + len(h)] for a, h in zip(at, heads, strict=True)] == heads


def test_sentences_cover_the_text(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "A. B\r\n\r\n x.﻿"), (5, "word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sentences.sentences(df, "doc_id", "text").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.id, r.n)):
        by.setdefault(r.id, []).append((r.start, r.sentence))
    assert set(by) == {4, 5} and len(by[5]) == 1
    for i, t in rows[3:]:
        assert all(t[a : a + len(s)] == s and s == s.strip() for a, s in by[i])
    assert sentences.sentence_offsets(df.limit(0), "doc_id", "text").count() == 0
