"""Problem 7: answers that do not serve their input, each with the kind of its defect.

Copies are found by compressing the answer with the prompt as a zstandard dictionary; refusals by a dictionary of
refusing phrases; truncation by the parse and by a terminal-context model, which knows after which kinds of text the
values of an argument normally end; wrong language by the word-first language model.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kordel.common import blank, spread
from kordel.llm import language, lookalike, residue

#: A value that ends inside a run of letters is cut off if such ends make up less than UNUSUAL of its argument's; fewer than
#: FEW ends of an argument say nothing.
UNUSUAL, FEW = 0.2, 20
#: Net compressed size of a copy given its prompt, as a share of that without; bytes from which zstandard can tell; a value
#: of at least PLAIN_SHARE of its text is looked at closely.
COPY_RATIO, SHORTEST, SELF_SAME, PLAIN_SHARE = 0.7, 8, 8, 0.8
#: A value is in some language if one has this probability; it is in another one if the text's own have at most that.
SOME_LANGUAGE, OWN_LANGUAGE = 0.4, 0.1
TEXT_ARGUMENTS = frozenset("text subject query body message note".split())

# Refusing phrases (regular expressions over text in lower case).
REFUSALS = r"""
\bi (?:can ?not|can['’]?t|won['’]?t|will not|am not able to|['’]m not able to|am unable to) (?:be able to |do this|do that|help|assist|set|process|carry|complete|perform|comply|fulfil)
\bi['’]m (?:sorry|afraid),? (?:but )?(?:i|this|that|doing|there)\b
\b(?:i['’]m|i am) (?:unable|not able|not allowed|not permitted) to\b
\bi (?:must|have to) (?:decline|refuse)\b
\bi would rather not (?:take|do|perform)\b
\bi (?:do not|don['’]?t) have (?:access to|permission)\b
\bi have no (?:access|permission)\b
\b(?:not something i can|beyond what i (?:may|can)|no way for me to)\b
\b(?:isn['’]?t|is not) (?:permitted|allowed|possible) for me\b
\b(?:can['’]?t|cannot) be (?:completed|done|carried out) by me\b
\bgoes against my (?:guidelines|policy|policies|rules)\b
\bas (?:a|an) (?:ai|language model|assistant)\b
\bsomething i['’]m unable\b
\bno (?:puedo|podemos) (?:ayudar|hacer (?:eso|esto)|realizar|cumplir|completar)
\bno me es posible (?:realizar|hacer|cumplir|ayudar)
\bno (?:tengo|estoy) (?:permiso|autorizad)
\bje ne (?:peux|suis) pas (?:vous aider|t['’]aider|aider|en mesure|autorisé|faire (?:cela|cette))
\bil m['’]est impossible de\b
\bdabei kann ich (?:leider )?nicht helfen
\bich (?:kann|darf) (?:ihnen|dir|diese|das)\b.{0,40}\bnicht\b
\bdiese (?:anfrage|aktion) (?:darf|kann) ich\b
(?:не могу|не можу) (?:с этим |вам |этим |вам з цим |з цим )?(?:помочь|допомогти|выполнить|виконати)
не имею права выполнить|не маю права виконати
(?:我)?(?:无法|不能|没有权限)(?:帮助|协助|执行|完成)
(?:申し訳|すみません).{0,20}(?:できません|お手伝い)|お手伝いできません|実行できません
لا (?:يمكنني|أستطيع) (?:مساعدتك|المساعدة|تنفيذ|القيام)
(?:मैं )?(?:इसमें )?(?:आपकी )?(?:मदद|सहायता) नहीं कर
δεν μπορώ να (?:σας |σε )?(?:βοηθήσω|εκτελέσω|κάνω αυτό)
אני לא יכול (?:לעזור|לבצע)|איני יכול (?:לעזור|לבצע)
ไม่สามารถ(?:ช่วย|ดำเนินการ|ทำ)
(?:መርዳት|ማከናወን) አልችልም
""".strip().split("\n")
_REFUSAL = re.compile("|".join(REFUSALS))

_QUOTED = r'"(?:\\.|[^"\\])*"'
_TOKEN = re.compile(rf'{_QUOTED}|"(?:\\.|[^"\\])*\Z|;|->|[^";\-]+|-', re.S)
_PIECE = re.compile(r"\s*\.?\s*([^\s:=\"]*)(.*)\Z", re.S)
_ARG = re.compile(rf"\s*:\s*([^\s:=\"]+)\s*=\s*({_QUOTED}|[^\s\"]\S*)\s*", re.S)
_OP = re.compile(r"[a-z_]\w*(?:\.\w+)+", re.I)
_NAMESPACE = re.compile(r"\s*\.\s*[a-z_]\w*\.?\w*\Z", re.I)
_WRAP = re.compile(r"\A\s*(?:(?:output|answer|response|assistant)\s*:)?\s*(?:```\w*\s*)?(.*?)(?:\s*```)?\s*(?:<end>|<\|end\|>|</s>|<\|endoftext\|>)?\s*\Z", re.I | re.S)
_WRAP_START = re.compile(r"(?:(?:output|answer|response|assistant)\s*:)?\s*(?:```\w*\s*)?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z]")
_LMN = regex.compile(r"[\p{L}\p{M}\p{N}]")
_CLASS = [("0", regex.compile(r"\p{N}")), ("h", regex.compile(r"\p{Han}")), ("i", regex.compile(r"\p{Hiragana}")), ("k", regex.compile(r"[\p{Katakana}ー]")), ("t", regex.compile(r"\p{Thai}"))]

_SPACELESS = frozenset("hikt")

_script_of: dict[str, str] = {}
_letter_of: dict[str, bool] = {}


def _is_letter(ch: str) -> bool:
    v = _letter_of.get(ch)
    if v is None:
        v = _letter_of[ch] = unicodedata.category(ch)[0] in "LMN"
    return v


def _script(ch: str) -> str:
    v = _script_of.get(ch)
    if v is None:
        v = next((k for k, p in _CLASS if p.match(ch)), None) or (unicodedata.name(ch, "?").split()[0] if unicodedata.category(ch)[0] == "L" else "")
        _script_of[ch] = v
    return v


def _one_form(text: str) -> str:
    """Lower case without look-alikes: in text with letters that only its own script has, words keep that script."""
    if language.has_own_letters(text):
        return _WORD.sub(lambda m: lookalike.fold(m[0]).lower() if _LATIN.search(m[0]) else lookalike.fold(m[0].lower()), text)
    return _WORD.sub(lambda m: residue.plain_word(m[0]), text)


class _OnlyLetters(dict):
    """For str.translate."""

    def __missing__(self, o: int) -> int | None:
        v = self[o] = o if _is_letter(chr(o)) else None
        return v


_ONLY_LETTERS = _OnlyLetters()


class Letters:
    """The letters of a text in lower case, and for each what follows it: end, punctuation, space, same, other."""

    __slots__ = ("text", "_form", "_at")

    def __init__(self, text: str):
        self._form = text.lower() if text.isascii() else _one_form(residue.visible(text))
        self.text = self._form.translate(_ONLY_LETTERS)
        self._at: list[int] | None = None  # of the letters in _form, once they are asked for

    def context(self, end: int) -> str:
        s, at = self._form, self._at
        if at is None:
            at = self._at = [i for i, ch in enumerate(s) if _ONLY_LETTERS[ord(ch)] is not None]
        i = at[end - 1] + 1
        if i >= len(s):
            return "end"
        ch = s[i]
        if not _is_letter(ch):
            if ch in ".,:'’" and i + 1 < len(s) and s[i - 1].isnumeric() and s[i + 1].isnumeric():
                return "same"
            return "space" if ch.isspace() else "punct"
        if unicodedata.category(ch)[0] == "M":
            return "same"
        a, b = _script(s[i - 1]), _script(ch)
        if a == b or not a:
            return "same"
        return "other" if a in _SPACELESS and b in _SPACELESS else "punct"  # a change of script ends a word

    def contexts(self, value: str) -> list[str]:
        out, at = [], self.text.find(value)
        while at >= 0:
            out.append(self.context(at + len(value)))
            at = self.text.find(value, at + 1)
        return out


def unwrap(answer: str) -> str:
    answer = answer.strip()
    if answer[-1:] not in ("`", ">"):  # nothing at the end to take off, and the lazy match is slow
        return answer[_WRAP_START.match(answer).end() :]
    return _WRAP.match(answer)[1].strip()


def cut(program: str) -> list[str]:
    pieces = [""]
    for t in _TOKEN.findall(program):
        if t in (";", "->"):
            pieces.append("")
        else:
            pieces[-1] += t
    return [p for p in pieces if p.strip(" .\t\r\n")]


class Answer:
    """What an answer holds: kind (`program`, `text` or `broken`), its argument values, its text."""

    def __init__(self, raw: str, ops: frozenset[str]):
        self.values: list[tuple[str, str]] = []
        self.text = body = unwrap(raw)
        self.kind = "text"
        if body[:1] in "{[" and body:
            try:
                j = json.loads(body)
            except ValueError:
                self.kind = "broken"
                return
            self._json(j, ops)
            return
        if body[:1] == '"' and body[-1:] == '"' and len(body) > 1:
            self.text = body[1:-1]
            body = self.text.strip()
        if body.strip().lower() in ("null", "none"):
            self.text = ""
            return
        self._program(body, ops)

    def _json(self, j, ops: frozenset[str]) -> None:
        op = j["intent"].strip().lower() if isinstance(j, dict) and isinstance(j.get("intent"), str) else ""
        prefix = bool(op) and op not in ops and any(x.startswith(op) for x in ops)
        if op and (op in ops or prefix or _OP.fullmatch(op)):  # any other intent is text in the place of an op
            self.kind = "broken" if prefix else "program"
            p = j.get("params")
            self.values = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in p.items()] if isinstance(p, dict) else []
            return
        leaves: list[str] = []

        def walk(x) -> None:
            if isinstance(x, dict):
                for v in x.values():
                    walk(v)
            elif isinstance(x, list):
                for v in x:
                    walk(v)
            elif x is not None and x != "":
                leaves.append(str(x))

        walk(j)
        self.text = " ".join(leaves)

    def _program(self, body: str, ops: frozenset[str]) -> None:
        pieces = cut(body)
        if not pieces:
            self.text = "" if not _LMN.search(body) else body
            return
        broken = False
        values = []
        for n, p in enumerate(pieces):
            m = _PIECE.match(p)
            op, rest = m[1].lower(), m[2]
            prefix = bool(op) and op not in ops and any(x.startswith(op) for x in ops)
            if not (op in ops or _OP.fullmatch(op) or prefix and not rest.strip() and (n or body.lstrip().startswith("."))):
                if n == 0:
                    return  # plain text
                broken = broken or not _LMN.search(p) or False
                continue
            at = 0
            while at < len(rest):
                a = _ARG.match(rest, at)
                if not a:
                    break
                v = a[2]
                values.append((a[1].lower(), re.sub(r"\\(.)", r"\1", v[1:-1], flags=re.S) if v[0] == '"' else v))
                at = a.end()
            tail = rest[at:].strip()
            if tail and n == 0 and not tail.startswith(":"):
                return  # a sentence that begins with a dotted word
            broken = broken or prefix or bool(tail)
        self.kind = "broken" if broken else "program"
        self.values = values


def _ending(found: list[str]) -> str:
    """What the contexts of a value come to: it ends a word somewhere, or else a run of another kind, or none."""
    if any(c in ("end", "punct", "space") for c in found):
        return "word"
    return "other" if "other" in found else "same"


class TerminalContexts:
    """Counts of what follows a value in its input, by argument and kind of its last letter."""

    def __init__(self, rows: Iterable[tuple[str, str]], ops: frozenset[str]):
        self.n: Counter = Counter()
        for text, raw in rows:
            self.add(text, raw, ops)

    def add(self, text: str, raw: str, ops: frozenset[str]) -> None:
        a = Answer(raw, ops)
        if a.kind != "program":
            return
        inp, ascii_text = None, text.isascii()
        for k, v in a.values:
            if ascii_text and v[-1:].isalpha() and _ends_in(v, text):  # as below, without the letters
                self.n[k, "LATIN", "word"] += 1
                self.n[k, "LATIN"] += 1
                continue
            inp = inp or Letters(text)
            w = Letters(v).text
            found = inp.contexts(w) if w else []
            if found:
                self.n[k, _script(w[-1]), _ending(found)] += 1
                self.n[k, _script(w[-1])] += 1

    def cut_off(self, key: str, inp: Letters, value: str) -> bool:
        w = Letters(value).text
        found = inp.contexts(w) if w else []
        kind = _ending(found)
        if not found or kind == "word":
            return False
        n = self.n[key, _script(w[-1])]
        if n < FEW:
            return kind == "same"
        return self.n[key, _script(w[-1]), kind] < UNUSUAL * n


_PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def _net(data: bytes, prompt: bytes | None) -> int:
    """Compressed bytes of data, less the frame's own, once prompt is known."""
    if prompt is None:
        return len(_PLAIN.compress(data)) - 6
    d = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data)) - 6


def is_copy(text: str, inp: Letters, whole: bool = False) -> bool:
    """The answer costs little once the prompt is known, and the prompt little once the answer is, so that one is nearly the
    other: both zstandard ratios are COPY_RATIO or less. whole: of an argument's value, which rightly holds a part of the
    prompt, the prompt must cost no more given the value than given itself. zstandard finds no match in fewer than
    SHORTEST bytes: such an answer is a copy if it is the prompt, such a value never. A text that compresses by itself to less than
    1 / SELF_SAME is so repetitive that no prompt can help; then only equal letters make a copy."""
    w = Letters(text).text
    if not w or not inp.text:
        return False
    data, prompt = w.encode(), inp.text.encode()
    if len(data) < SHORTEST or len(prompt) < SHORTEST:
        return not whole and w == inp.text
    alone = _net(data, None)
    if alone * SELF_SAME < len(data):
        return w == inp.text
    if _net(data, prompt) > COPY_RATIO * alone:
        return False
    back = _net(prompt, data)
    return back <= _net(prompt, prompt) + 1 if whole else back <= COPY_RATIO * _net(prompt, None)


def defect(text: str | None, raw: str | None, ops: frozenset[str], model: language.Model, ends: TerminalContexts) -> str | None:
    if text is None or not _LMN.search(text):
        return None
    if raw is None:
        return "empty"
    a = Answer(raw, ops)
    if a.kind == "text" and not _LMN.search(a.text):
        return "empty"
    if a.kind == "program" and all(_ends_in(v, text) for _, v in a.values):
        return None
    inp = Letters(text)
    loose = a.text.lower().replace("’", "'")
    if a.kind == "text":
        copy = is_copy(a.text.lstrip(" ."), inp)
        if not copy and _REFUSAL.search(loose) and Letters(a.text).text not in inp.text:
            return "refusal"
        if copy:
            return "copy"
        return _other_language(a.text, text, model)
    foreign = None
    for k, v in a.values:
        w = Letters(v).text
        if not w or w in inp.text:
            if a.kind == "program" and k in TEXT_ARGUMENTS and is_copy(v, inp, whole=True):
                return "copy"
            continue
        if _REFUSAL.search(v.lower().replace("’", "'")):
            return "refusal"
        if k in TEXT_ARGUMENTS:
            foreign = foreign or _other_language(v, text, model)
    if a.kind == "broken":
        return "truncated"
    if any(ends.cut_off(k, inp, v) for k, v in a.values):
        return "truncated"
    return foreign


def _ends_in(value: str, text: str) -> bool:
    """The plain case, decided without the letters: the value stands in the text as it is, short of the whole, and a space,
    an ASCII mark or the end follows. False leaves the question open."""
    n = len(value)
    if not n or value[-1].isdigit() or n >= PLAIN_SHARE * len(text):
        return False
    at = text.find(value)
    while at >= 0:
        nxt = text[at + n : at + n + 1]
        if not nxt or nxt.isascii() and not nxt.isalnum() and nxt != "_":
            return True
        at = text.find(value, at + 1)
    return False


def _other_language(value: str, text: str, model: language.Model) -> str | None:
    """The value is surely in some language, and surely in none of the text's."""
    p = model.distribution(value)
    own = {x[0] for x in model.segments(text)}
    return "wrong_language" if max(p.values()) >= SOME_LANGUAGE and None not in own and sum(p[x] for x in own) <= OWN_LANGUAGE else None


#: Counts that a task holds before it hands them on.
_HELD = 100_000


def fit_contexts(pairs: DataFrame, ops: frozenset[str], key: list[str] | None = None) -> TerminalContexts:
    """pairs(text, answer). All rows are counted, by the executors. The driver gets three counts an argument and kind of
    letter with FEW ends or more: what has fewer is decided without its counts. key: not needed, since no sample is drawn."""
    usable = pairs.where(F.col("text").isNotNull() & F.col("answer").isNotNull()).select("text", "answer")
    sent = pairs.sparkSession.sparkContext.broadcast(ops)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o, ends = sent.value, TerminalContexts([], frozenset())

        def held() -> pd.DataFrame:
            # an argument's name may come from JSON, with a lone surrogate, which a string column cannot hold
            rows = [(k[0].encode("utf-8", "surrogatepass"), k[1], n, ends.n[*k, "same"], ends.n[*k, "other"]) for k, n in list(ends.n.items()) if len(k) == 2]
            ends.n.clear()
            return pd.DataFrame(rows, columns=["arg", "script", "n", "same", "other"])

        for b in batches:
            for t, a in zip(b["text"], b["answer"], strict=True):
                ends.add(t, a, o)
                if len(ends.n) > _HELD:
                    yield held()
        yield held()

    counts = spread(usable).mapInPandas(count, "arg binary, script string, n long, same long, other long")
    sums = counts.groupBy("arg", "script").agg(*[F.sum(c).alias(c) for c in ("n", "same", "other")]).where(F.col("n") >= FEW)
    ends = TerminalContexts([], ops)
    for r in sums.collect():
        k = (bytes(r.arg).decode("utf-8", "surrogatepass"), r.script)
        ends.n.update({k: r.n, (*k, "same"): r.same, (*k, "other"): r.other})
    return ends


def flag(pairs: DataFrame, ops: frozenset[str], model: language.Model, ends: TerminalContexts, into: str = "defect") -> DataFrame:
    """pairs(text, answer, ...) with the defect of each, or null. Null or blank text has none; a null answer is `empty`;
    whole texts of any length are compared."""
    sent = pairs.sparkSession.sparkContext.broadcast((ops, model, ends))

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series, answer: pd.Series) -> pd.Series:
        o, m, e = sent.value
        none = lambda x: x if isinstance(x, str) else None
        return pd.Series([defect(none(t), none(a), o, m, e) for t, a in zip(text, answer, strict=True)], dtype=object)

    return spread(pairs).withColumn(into, run(F.col("text"), F.col("answer")))


def pairs_of(canonical: DataFrame, distill: DataFrame) -> DataFrame:
    a = canonical.select(F.lit("canonical").alias("src"), F.col("canon_id").alias("rec_id"), F.col("input").alias("text"), F.col("intent").alias("answer"))
    b = distill.select(F.lit("distill").alias("src"), F.col("distill_id").alias("rec_id"), F.col("input").alias("text"), F.col("output").alias("answer"))
    return a.unionByName(b).where(~blank(F.col("text")))
