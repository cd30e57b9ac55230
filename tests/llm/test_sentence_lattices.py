"""Lattices of the sentence operator: Thai, Chinese, Japanese, terminators; linear time."""

import time

from kordel.llm import sentences as S


def cut(text):
    at = S.sentence_starts(text)
    return [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)], strict=True)]


def test_word_lattice_takes_the_cheapest_path():
    assert S.thai_words("อย่าลบรายชื่อนะครับ")[-1] == "นะครับ" and S.thai_words("อย่าลบ")[0] == "อย่า"
    x = S.Lattice(frozenset(["ab", "c"]), frozenset(["abc", "a"]))
    assert x.words("abc") == ["abc"] and x.words("zabzc") == ["z", "ab", "z", "c"] and x.words("") == []


def test_gaps_of_spaceless_scripts():
    assert cut("名簿を消さないでください！payment.requestは省略できる。「猫は食べた。返事を」と彼は書いた。") == ["名簿を消さないでください！", "payment.requestは省略できる。", "「猫は食べた。返事を」と彼は書いた。"]
    assert cut("参数timer.set可以省略……但是最好写上。真的吗？！用户走了。") == ["参数timer.set可以省略……但是最好写上。", "真的吗？！", "用户走了。"]
    assert cut("รุ่น 4.5.14 ยังเก็บเครื่องหมายไว้ คำสั่งจะถูกแบ่งเสมอครับ ทำไมไม่ดังเลย") == ["รุ่น 4.5.14 ยังเก็บเครื่องหมายไว้", "คำสั่งจะถูกแบ่งเสมอครับ", "ทำไมไม่ดังเลย"]
    assert cut('ผู้ใช้พูดว่า "ช่วยโทรหา Bob หน่อย" แล้วก็รอ') == ['ผู้ใช้พูดว่า "ช่วยโทรหา Bob หน่อย" แล้วก็รอ']


def test_terminator_lattice():
    assert cut("On compte env. 3 mots. M. Dupont a mesuré 3 mots. Tout va.") == ["On compte env. 3 mots.", "M. Dupont a mesuré 3 mots.", "Tout va."]
    assert cut("Das gilt z. B. für Zahlen. Es ist gut. El turno empezó a las 8 a. m. y acabó.") == ["Das gilt z. B. für Zahlen.", "Es ist gut.", "El turno empezó a las 8 a. m. y acabó."]
    # an arc over terminators 0..1 forbids an end at 0; a sentence without letters is none
    assert S.best_path([(2.0, 1, True), (1.0, 1, True)]) == [1]
    assert S.best_path([(2.0, 0, True), (2.0, 1, False), (2.0, 2, True)]) == [0, 2]
    assert S.best_path([(-1.0, 0, True), (1.0, 1, True)]) == [1] and S.best_path([]) == []


def test_time_is_linear():
    for piece in ("The U.S. team (see sec. 4). \"Call Bob. Now,\" he said. Wait... ", ". ", '(a. "b ', "อย่าลบรายชื่อนะครับ ", "命令先被分成几段。"):
        n = 400_000 // len(piece)
        t = time.process_time()
        S.sentence_starts(piece * n)
        assert time.process_time() - t < 20
