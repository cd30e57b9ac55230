"""Problem 10: sentences of documents in many languages and scripts.

A document falls into paragraphs at empty lines, and paragraphs into blocks before list items, dialogue lines and program
lines. Within a block every terminator and, in Thai, every space is a gap. Spaced scripts are read as a terminator lattice:
each terminator is the end of a sentence or part of a token, abbreviations written with spaces are arcs over several
terminators, and the best path wins. Scripts without spaces are segmented by a lattice of dictionary words on both sides of a
gap; its final particles and opening words, with the kind of the gap, decide. All of it is linear in the length of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kordel.common import spread

#: Words longer than this are in no list; so much is looked at behind and before a terminator.
TOKEN, AHEAD = 64, 200

# Words before a period, in lower case and without their last period.
NEVER_ENDS = frozenset("""
mr mrs ms dr prof st messrs mme mlle hr fr sra sr srta fig figs sec sect ch vol cf vs approx eq eqn ca rev gen sen e.g i.e viz
p pp cap aprox núm pág art ed env ex voir nr abs bzw vgl z.b d.h p.ex p.ej z проф рис см стр им ул гл акад напр т т.е п
κ κα δρ αρ σελ π.χ د أ م डॉ श्री सुश्री پروف
""".split())
MAY_END = frozenset("""
etc u.s u.k u.n e.u a.m p.m m ltd inc co corp jr dept est min max usw u.s.w d г гг д др пр тыс млн млрд руб коп т.д т.п κ.λπ κτλ π.μ μ.μ
""".split())
BEFORE_NUMBERS = frozenset("no nos nn".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
SPEECH = frozenset("""
said says wrote writes asked asks replied replies answered typed shouted whispered noted added explained dijo escribió respondió preguntó
dit écrit répondit demanda sagte schrieb fragte antwortete сказал сказала написал написала ответил спросил είπε έγραψε ρώτησε
""".split())
SPEAKERS = frozenset("user system assistant bot agent human ai q a customer operator speaker host guest client caller model".split())
# Abbreviations written with spaces; their inner periods end nothing.
SPACED = ("z. b.", "d. h.", "u. a.", "a. m.", "p. m.", "p. ex.", "p. ej.", "т. д.", "т. п.", "т. е.", "т. к.", "i. e.", "e. g.", "u. s.", "ee. uu.")
# Dictionaries of scripts without spaces: particles that end a sentence, words that open one, words that carry
# on what stands before them, and common words between them.
THAI_POLITE = frozenset("ค่ะ คะ ครับ นะคะ นะครับ".split())
THAI_FINAL = frozenset("ครับผม จ้ะ จ๊ะ นะ เถอะ สิ ซิ ล่ะ เลย แล้ว ไหม หรือไม่ หรือยัง ด้วย".split())
THAI_OPENING = frozenset("ผู้ใช้ คุณ อย่า ทำไม คำสั่ง รุ่น ตัวเลือก เรา เขา ฉัน ผม แต่ ดังนั้น เมื่อ ถ้า โปรด กรุณา อะไร ใคร นี่ นั่น".split())
THAI_CARRYING = frozenset("และ หรือ กับ ของ ที่ ว่า".split())
THAI_WORDS = frozenset("ใน มี ไม่ ได้ ให้ จะ ไป มา เป็น อยู่ จาก ถูก แบ่ง ส่วน ก่อน เสมอ ลบ รายชื่อ นาฬิกา จึง ดัง ยัง เก็บ เครื่องหมาย คำพูด วัด เวลา วินาที ต่อ บรรทัด ประโยค ราว ส่ง พูด รอ ก็ กระดาษ เขียน ละ ไว้".split())
CHINESE_FINAL = frozenset("吗 呢 吧 啊 呀 啦 了 的".split())
CHINESE_OPENING = frozenset("我 我们 你 你们 他 她 它 这 那 请 为什么 怎么 什么 谁 用户 命令 参数 版本 来自 真的 如果 因为 所以 今天 明天".split())
CHINESE_CARRYING = frozenset("但是 但 不过 而 而且 然后 并且 和 或者 还是 这样 说 说道 写道".split())
CHINESE_WORDS = frozenset("可以 最好 没有 不 在 有 是 就 都 也 被 把 先 大约 保留 省略 等着 句子 名单 删除 分成 定时器".split())
JAPANESE_FINAL = frozenset("か よ ね わ ぞ です ます ました ません だ でしょう ください".split())
JAPANESE_OPENING = frozenset("私 僕 彼 彼女 これ それ この その なぜ 何 誰 利用者 命令 名簿 しかし でも だから もし 明日 今日 バージョン".split())
JAPANESE_CARRYING = frozenset("と って とか だと との で です な の は が を に へ も や から ので けど".split())
JAPANESE_WORDS = frozenset("する した して いる ある ない なる こと もの ため さん 引用符 文 部分 分け られる 残す 消さない 省略 できる 約 件 届いた".split())

_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_BULLET = re.compile(r"[^\S\n]*(?:[-*•‣▪◦·+]|[–—](?=\s))\s+\S")
_NUMBERED = re.compile(r"[^\S\n]*\(?(\d{1,3})[.)]\s+\S")
_DASH = re.compile(r"[^\S\n]*[–—]\s")
_PROGRAM = re.compile(r"[^\S\n]*\.\s*[A-Za-z_]\w*(?:\.\w+)+(?:\s+:|\s*(?:;|->)|\s*$)|[^\S\n]*\.\s+[a-z_]\w*\s*(?::\w+\s*=|$)")
_LABEL = re.compile(r"[^\S\n]*([^\W\d_]{1,20})\s?[:：]\s+\S")
_HEADING = re.compile(r"[^\S\n]*#{1,6}\s")
_END = re.compile(r"[.!?…。．！？؟۔।॥።፧‼⁇⁈⁉｡;;]+(?:[\s]?(?=[!?»]))?[.!?…。！？؟।።፧]*")
_CLOSER = "\"”»’)]}」』】）］〉》›"
_OPEN = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_MARKS = re.compile(r"[«»“”„「」『』‹›()\[\]（）【】《》〈〉\"]")
_WORD_BEFORE = re.compile(r"[^\s\"“”„«»()\[\]「」]*\Z")
_CASED = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ԯἀ-῿]")
_OPNAME = re.compile(r"[a-z_]\w*\.[a-z_]\w*")
_THAI_RUN = re.compile(r"[฀-๿]+")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=\S)")
_LATIN_STRETCH = re.compile(r"(?:[A-Za-z][\w.'’-]{0,63}[,;]?\s{1,8}){3}[A-Za-z]")
_EAST_RUN = re.compile(r"[々〇ぁ-ゟ゠-ヿ㐀-鿿豈-﫿]+")
_EAST_LEFT = re.compile(r"[々〇ぁ-ゟ゠-ヿ㐀-鿿豈-﫿]+\Z")
_KANA = re.compile(r"[ぁ-ゟ゠-ヿ]")
_NONSPACE = re.compile(r"\S")
_ALNUM = re.compile(r"[^\W_]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_LETTER, _LETTER_OR_MARK = regex.compile(r"\p{L}"), regex.compile(r"[\p{L}\p{M}]")
_DOTTED, _ONE_LETTER = regex.compile(r"(?:\p{L}\.)+\p{L}"), regex.compile(r"\p{L}\p{M}*")
_SPACED = re.compile(r"(?<!\w)(?:" + "|".join(x.replace(".", r"\.").replace(" ", r"\s") for x in SPACED) + ")", re.I)
_LISTED = NEVER_ENDS | MAY_END | BEFORE_NUMBERS
_EAST_END = frozenset("。．！？｡")
_PARTNERS = {c: "".join(o for o, cs in _OPEN.items() if c in cs) for c in "".join(_OPEN.values())}


#: Costs of a dictionary word that ends or opens a sentence, of another one, and of a character in none.
MARKED_WORD, COMMON_WORD, UNKNOWN = 1.0, 1.1, 2.0


class Lattice:
    """Cheapest path through all dictionary words of a run of one script; linear, as words have a bounded length."""

    def __init__(self, marked: frozenset[str], common: frozenset[str]):
        self.costs = dict.fromkeys(common, COMMON_WORD) | dict.fromkeys(marked, MARKED_WORD)
        self.automaton = ahocorasick.Automaton()
        for w, c in self.costs.items():
            self.automaton.add_word(w, (len(w), c))
        self.automaton.make_automaton()

    def words(self, run: str) -> list[str]:
        n = len(run)
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        arcs: dict[int, list[tuple[int, float]]] = {}
        for end, arc in self.automaton.iter(run):
            arcs.setdefault(end + 1, []).append(arc)
        for j in range(1, n + 1):
            cost, at = best[j - 1] + UNKNOWN, j - 1
            for length, c in arcs.get(j, ()):
                if best[j - length] + c < cost:
                    cost, at = best[j - length] + c, j - length
            best[j], back[j] = cost, at
        out, j = [], n
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        return out[::-1]


@lru_cache(1)
def _lattices() -> tuple[Lattice, Lattice, Lattice]:
    return (
        Lattice(THAI_POLITE | THAI_FINAL | THAI_OPENING, THAI_CARRYING | THAI_WORDS), Lattice(CHINESE_FINAL | CHINESE_OPENING | CHINESE_CARRYING, CHINESE_WORDS),
        Lattice(JAPANESE_FINAL | JAPANESE_OPENING | JAPANESE_CARRYING, JAPANESE_WORDS),
    )


@lru_cache(20_000)
def thai_words(run: str) -> tuple[str, ...]:
    return tuple(_lattices()[0].words(run))


@lru_cache(20_000)
def _east_words(run: str, japanese: bool) -> tuple[str, ...]:
    return tuple(_lattices()[1 + japanese].words(run))


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def _blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): whole blocks are one sentence each."""
    lines = [(a, b, text[a:b]) for a, b in _lines(text)]
    labels: dict[str, int] = {}
    for _, _, s in lines:
        m = _LABEL.match(s)
        if m and m[1][0].upper() == m[1][0]:
            labels[m[1].lower()] = labels.get(m[1].lower(), 0) + 1
    out: list[list] = []
    fresh, number, dashes = True, 0, False
    for a, b, s in lines:
        if not s.strip():
            fresh, number, dashes = True, 0, False
            continue
        program = bool(_PROGRAM.match(s))
        label = _LABEL.match(s)
        spoken = bool(label) and (label[1].lower() in SPEAKERS or labels.get(label[1].lower(), 0) > 1) and label[1][0].upper() == label[1][0]
        item, m = bool(_BULLET.match(s)), _NUMBERED.match(s)
        if item and _DASH.match(s):
            item = fresh or dashes
            dashes = item
        if m and (fresh or number and int(m[1]) == number + 1 or not fresh and not number and int(m[1]) == 1 and out and out[-1][2] is False and text[out[-1][0] : out[-1][1]][-40:].rstrip().endswith(":")):
            item, number = True, int(m[1])
        heading = bool(_HEADING.match(s))
        if program or spoken or item or heading:
            out.append([a, b, True, program or heading])
        elif fresh or out[-1][3]:
            out.append([a, b, False, False])
        else:
            out[-1][1] = b
        fresh = False
    return [(a, b, w) for a, b, w, _ in out]


def _enclosures(s: str) -> list[tuple[int, int, bool]]:
    """(open, close, quotation) of the quotations and brackets that close within s, outermost first. A mark that closes takes
    all that was opened behind its partner off the stack; marks without an open partner are told by a count, so no mark
    looks through the stack in vain."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    found = []

    def close(ch: str, i: int, partners: str) -> bool:
        if not any(waiting.get(p) for p in partners):
            return False
        while True:
            mark, at = stack.pop()
            waiting[mark] -= 1
            if mark in partners:
                found.append((at, i, mark not in "([（【"))
                return True

    for m in _MARKS.finditer(s):
        ch, i = m[0], m.start()
        if ch == '"':
            before, after = s[i - 1 : i], s[i + 1 : i + 2]
            free = not before or before.isspace()
            opens = (free or before in "([—–-'«:=，。、") and bool(after) and not after.isspace()
            if waiting.get('"'):
                if opens and free:  # the one before was never closed
                    while True:
                        mark, _ = stack.pop()
                        waiting[mark] -= 1
                        if mark == '"':
                            break
                    stack.append(('"', i))
                    waiting['"'] = waiting.get('"', 0) + 1
                else:
                    close(ch, i, '"')
            else:
                stack.append(('"', i))
                waiting['"'] = waiting.get('"', 0) + 1
            continue
        if close(ch, i, _PARTNERS.get(ch, "")):
            continue
        if ch in _OPEN:
            stack.append((ch, i))
            waiting[ch] = waiting.get(ch, 0) + 1
    found.sort()
    outer: list[tuple[int, int, bool]] = []
    for x in found:
        if not outer or x[0] > outer[-1][1]:
            outer.append(x)
    return outer


#: Weights of a gap: above 0 it ends a sentence.
SURE, LIKELY = 2.0, 1.0


def _east_weight(s: str, a: int, b: int, n: int, quoted: bool, ellipsis: bool) -> float:
    """A terminator of Chinese or Japanese: final particle before it, opening or carrying word behind it, by dictionary lattices
    of both sides."""
    right = _EAST_RUN.match(s, n)
    left = _EAST_LEFT.search(s[max(0, a - TOKEN) : a]) if ellipsis else None
    weight = -LIKELY if ellipsis else SURE
    if s[n] in "、，,":
        return -SURE
    if right:
        run = right[0][:TOKEN]
        japanese = bool(_KANA.search(run)) or bool(left and _KANA.search(left[0]))
        first = _east_words(run, japanese)[0]
        if first in (JAPANESE_CARRYING if japanese else CHINESE_CARRYING):
            weight -= 2 * SURE if quoted or ellipsis else LIKELY
        elif first in (JAPANESE_OPENING if japanese else CHINESE_OPENING):
            weight += SURE
    if left:
        japanese = bool(_KANA.search(left[0]))
        if _east_words(left[0], japanese)[-1] in (JAPANESE_FINAL if japanese else CHINESE_FINAL):
            weight += 0.5
    return weight


def _weight(s: str, a: int, b: int, n: int, quoted: bool) -> float:
    """How surely the terminators s[a:b], closers included, end a sentence that goes on at n; quoted: a quotation closes
    right behind them. Only TOKEN characters before and AHEAD behind are looked at."""
    if n >= len(s):
        return SURE
    gap = n > b
    ch = s[n]
    tail = s[a:b]
    if tail == "." and gap and not quoted and ch.isupper():  # the plain case
        i = s.rfind(" ", max(0, a - TOKEN), a) + 1
        w = s[i:a]
        if i and len(w) > 2 and w.isalpha() and w.lower() not in _LISTED and (ch.isascii() or _CASED.match(ch)):
            return SURE
    run = tail.strip(_CLOSER + " \xa0\u202f")
    nxt = s[n : n + AHEAD]
    first = nxt.lstrip("\"“„«「『([¿¡‹'’—–-（*  ")[:1] or ch
    prev = s[a - 1 : a]
    if run and all(c in ".…" for c in run) and (len(run) > 1 or run == "…"):  # an ellipsis
        if gap and first.isupper() or run[0] == "." and len(run) == 2 and first.isupper():
            return LIKELY
        return _east_weight(s, a, b, n, quoted, True) if _EAST_RUN.match(ch) else -LIKELY
    if ";" in run or "\u037e" in run:
        return SURE if bool(_GREEK.match(prev)) and not first.islower() or "?" in run or "!" in run else -SURE
    if any(c in _EAST_END for c in run):
        return -SURE if first.islower() and _CASED.match(first) and not _OPNAME.match(nxt) else _east_weight(s, a, b, n, quoted, False)
    if any(c in "؟۔।॥።፧" for c in run):
        if quoted and ch in "、，,":
            return -SURE
        return -SURE if first.islower() and _CASED.match(first) else SURE
    if "!" in run or "?" in run:
        if first.islower() and _CASED.match(first) and not _OPNAME.match(nxt):
            return -SURE
        if quoted and ch in "、，,":
            return -SURE
        if _EAST_RUN.match(ch):
            return _east_weight(s, a, b, n, quoted, False)
        return -SURE if quoted and _carried(nxt) else SURE
    # one period
    before = s[max(0, a - TOKEN) : a]
    word_before = _WORD_BEFORE.search(before)[0]
    if not gap and not tail[-1:] in _CLOSER:
        nch = s[b : b + 1]
        if prev.isdigit() and nch.isdigit():
            return -SURE
        word = word_before.lower().strip(".")
        if word in NEVER_ENDS or len(word) < 2:
            return -SURE
        if nch.isupper() and _CASED.match(nch):
            return LIKELY if (prev.islower() or prev.isdigit() or prev in _CLOSER) and (s[b + 1 : b + 2].islower() or not s[b + 1 : b + 2].isalnum()) else -LIKELY
        if nch in "\"“„«¿¡([":
            return LIKELY if first.isupper() else -LIKELY
        return LIKELY if bool(_LETTER.match(nch)) and not _CASED.match(nch) and not nch.isascii() and bool(_LETTER_OR_MARK.match(prev)) and not prev.isascii() else -LIKELY
    word = word_before.lower().lstrip("'’([-–—*•¿¡")
    cased = bool(_CASED.match(first))
    if word in NEVER_ENDS or word in BEFORE_NUMBERS and first.isdigit():
        return -SURE
    bare = word.strip(".")
    if bare in MAY_END or _DOTTED.fullmatch(word):
        if bare in NEVER_ENDS or len(bare) == 1 and word_before.strip(".").isupper():  # a capital is an initial or a title
            return -SURE
        return LIKELY if (first.isupper() if cased else not first.isdigit()) else -LIKELY
    if _ONE_LETTER.fullmatch(bare):
        if bare == "a" and nxt[:2].lower() == "m.":
            return -SURE
        raw = word_before.strip(".")
        if raw.isupper() or not _CASED.match(raw) or raw in ("z", "d", "u"):  # an initial, or one letter of a script without case
            return -SURE
    if bare.isdigit() and len(bare) < 3 and nxt.split(maxsplit=1)[0].lower().strip(".,;:!?") in MONTHS:
        return -SURE
    if cased and first.islower():
        return LIKELY if bool(_OPNAME.match(nxt)) and len(bare) > 3 else -SURE
    return -SURE if quoted and _carried(nxt) else SURE


def _carried(nxt: str) -> bool:
    """Words behind a quotation that carry it: a verb of speech within the next two words."""
    return any(w.strip(".,;:!?").lower() in SPEECH for w in nxt.split(maxsplit=3)[:2])


def best_path(nodes: list[tuple[float, int, bool]]) -> list[int]:
    """The terminators that end sentences along the best path. A node is (weight of ending there, last node of the token that
    begins here, whether letters stand between the node before and this one). A path reads each terminator as an end, or as
    part of a token; a token's arc allows no end before its last terminator, and a sentence holds a letter."""
    if all(last == k and letters for k, (_, last, letters) in enumerate(nodes)):
        return [k for k, (w, _, _) in enumerate(nodes) if w > 0]  # no arc spans another: every node is its own best reading
    none = float("-inf")
    dry, wet = (0.0, None), (none, None)  # best paths that end in no letter since the last end, and in some
    held = -1
    for k, (w, last, letters) in enumerate(nodes):
        held = max(held, last if last > k else -1)
        if letters:
            wet, dry = max(dry, wet, key=lambda x: x[0]), (none, None)
        end = (wet[0] + w, (k, wet[1])) if held <= k else (none, None)
        on = (wet[0] - w, wet[1]) if held <= k else wet
        wet, dry = on, max(end, dry, key=lambda x: x[0])
    out, path = [], max(dry, wet, key=lambda x: x[0])[1]
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def _spaced(s: str, inside: list[tuple[int, int, bool]]) -> list[int]:
    """Offsets in s at which sentences after the first begin, by the terminator lattice."""
    opens = [x[0] for x in inside]
    opens_at = set(opens)
    starts: dict[int, int] = {}
    nodes: list[tuple[float, int, bool]] = []
    seen = 0
    ends: list[int] = []
    for m in _END.finditer(s):
        a, b = m.start(), m.end()
        k = bisect_right(opens, a) - 1
        quoted = False
        if k >= 0 and inside[k][0] < a < inside[k][1]:
            x = _NONSPACE.search(s, b)
            if x and x.start() < inside[k][1]:
                continue  # more follows inside
            quoted = True
            b = inside[k][1]
        while b < len(s) and s[b] in _CLOSER and b not in opens_at:
            b += 1
        if m[0][0] in ";\u037e" and not _GREEK.match(s[a - 1 : a]):
            continue
        x = _NONSPACE.search(s, b)
        n = x.start() if x else len(s)
        w = _weight(s, a, b, n, quoted)
        starts[len(nodes)] = n
        letters = bool(_ALNUM.search(s, seen, a))
        seen = a
        nodes.append((w, len(nodes), letters))
        ends.append(a)
    if len(nodes) > 1 and _SPACED.search(s):
        place = {a: k for k, a in enumerate(ends)}
        for m in _SPACED.finditer(s):
            i, j = place.get(s.find(".", m.start())), place.get(m.end() - 1)
            if i is not None and j is not None:
                nodes[i] = (nodes[i][0], j, nodes[i][2])
    return [starts[k] for k in best_path(nodes) if starts[k] < len(s)]


def _thai(s: str, inside: list[tuple[int, int, bool]]) -> list[int]:
    """Gaps of Thai text that end a sentence. A space between Thai words ends one unless the words tie the sides together more
    than any list of words can; before a number, a Latin word or a quotation it takes a polite particle on the left, or a
    sentence in Latin letters on the right."""
    opens = [x[0] for x in inside]
    out = []
    for m in _THAI_GAP.finditer(s):
        a, b = m.start(), m.end()
        k = bisect_right(opens, a) - 1
        if k >= 0 and inside[k][0] < a < inside[k][1]:
            continue
        i = a  # a wrapped line stands for the space it replaced
        while i and "฀" <= s[i - 1] <= "๿":
            i -= 1
        last = thai_words(s[i:a])[-1]
        right = _THAI_RUN.match(s, b)
        weight = LIKELY if right else -1.5
        if last in THAI_POLITE:
            weight += SURE
        elif last in THAI_FINAL:
            weight += 0.5
        if right:
            first = thai_words(right[0])[0]
            weight += 0.5 if first in THAI_OPENING else -0.5 if first in THAI_CARRYING else 0.0
        elif _LATIN_STRETCH.match(s, b):
            weight += SURE
        if weight > 0:
            out.append(b)
    return out


def sentence_starts(text: str) -> list[int]:
    """Offsets of the first characters of all sentences, in order."""
    out: set[int] = set()
    for a, b, whole in _blocks(text):
        s = text[a:b]
        m = _NONSPACE.search(s)
        if not m:
            continue
        out.add(a + m.start())
        if whole:
            continue
        inside = _enclosures(s) if _MARKS.search(s) else []
        for at in _spaced(s, inside):
            out.add(a + at)
        if _THAI_RUN.search(s):
            for at in _thai(s, inside):
                out.add(a + at)
    return sorted(out)


def sentence_offsets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end) of every sentence: code point offsets, end without trailing whitespace. Null, empty and blank texts
    have none; texts of any length are cut whole; other columns are not read."""
    schema = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            if not isinstance(t, str):
                out.append([])
                continue
            at = sentence_starts(t)
            out.append([{"start": x, "end": x + len(t[x:y].rstrip())} for x, y in zip(at, [*at[1:], len(t)], strict=True)])
        return pd.Series(out)

    lean = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null"))
    return lean.select("id", F.explode(run("t")).alias("s")).select("id", "s.start", "s.end")


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, start, sentence): the sentences themselves, in order from n = 0."""

    @F.pandas_udf("array<struct<start:bigint,sentence:string>>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            at = sentence_starts(t) if isinstance(t, str) else []
            out.append([{"start": x, "sentence": t[x:y].rstrip()} for x, y in zip(at, [*at[1:], len(t) if at else 0], strict=bool(at))])
        return pd.Series(out)

    lean = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null"))
    return lean.select("id", F.posexplode(run("t")).alias("n", "s")).select("id", "n", "s.start", "s.sentence")
