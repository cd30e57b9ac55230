"""Problem 6: template leftovers, filler, error pages and notices that stand where a command should be.

Labelled exemplars are retrieved through an inverted index over their tokens; the TF-IDF mass of each passage window
that the best exemplar contains is its containment, and a text whose windows are mostly contained is left out. Exemplars
of scope `part` are marks (an unfilled slot, a stand-in marker) that condemn the window they fill; exemplars of scope
`whole` must cover the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from kordel.common import blank, spread
from kordel.llm import lookalike

#: A text is residue from this share of its TF-IDF mass on; windows of this many tokens, half overlapping.
CONTAINED, WINDOW = 0.6, 24
#: An exemplar counts where the window holds at least this share of its distinct tokens.
EXEMPLAR_SHARE = 0.4
#: Inverse document frequency is cut at log(RAREST), and no more than MOST_TERMS terms are ever sent to the executors.
RAREST, MOST_TERMS = 10_000, 100_000

# Labelled exemplars of scope `whole`. Digits stand for any number.
WHOLE = """
please enable javascript to continue
you need to turn on scripts in your browser to view this page
javascript is disabled in your browser, enable it to view this site
this site requires cookies and javascript
we use cookies, accept all cookies
checking your browser, please wait
please verify that you are human
your session has expired, sign in again
service temporarily unavailable, try again in 0 minutes
whoops, looks like something went wrong
the requested resource could not be located on this server
the requested page could not be found
access denied. reference #0.0
permission denied, forbidden
rate limit reached, slow down
too many requests, try again later
quota exceeded {"error": "quota exceeded", "code": 0}
http 0 internal server error
error 0: page not found
0 not found
0 bad gateway nginx
0 forbidden
0 service unavailable
gateway timeout 0
connection timed out
traceback (most recent call last): keyerror: 'phrase'
exception in thread main nullpointerexception typeerror valueerror
undefined is not a function
undefined undefined
null null
nan nan
none none
n/a
[object object]
#ref!
#value!
#name?
#div/0!
true false
your text here
insert text here
sample text sample text
example text goes here
placeholder text (placeholder)
lorem ipsum dolor sit amet
lorem ipsum consectetur adipiscing
sed do eiusmod tempor incididunt ut labore
asdf asdf qwer qwer
test test test
foo bar baz
xx xx
untitled phrase 0
untitled document 0
tbd - phrase goes here
todo: write the phrase
todo translate this
translation missing
translation pending
not translated yet
coming soon
page intentionally left blank
页面不存在或已被删除
页面未找到
服务器内部错误 0
系统繁忙,请稍后重试
请启用 javascript 后再访问
拒绝访问
待翻译
此处填写文本
ページが見つかりません
サーバーエラー 0
javascript を有効にしてください
الصفحة المطلوبة غير موجودة
خطأ داخلي في الخادم 0
يرجى تفعيل جافا سكريبت للمتابعة
ضع النص هنا
تم رفض الوصول
पृष्ठ उपलब्ध नहीं है 0
सर्वर में त्रुटि हुई
जारी रखने के लिए जावास्क्रिप्ट चालू करें
यहाँ पाठ लिखें
страница не найдена
доступ запрещён
внутренняя ошибка сервера 0
включите javascript, чтобы продолжить
вставьте текст сюда
сторінку не знайдено
внутрішня помилка сервера 0
увімкніть javascript, щоб продовжити
η σελίδα δεν βρέθηκε
σφάλμα διακομιστή 0
ενεργοποιήστε τη javascript για να συνεχίσετε
γράψτε εδώ το κείμενο
הדף לא נמצא
שגיאת שרת 0
יש להפעיל javascript כדי להמשיך
הכנס טקסט כאן
ไม่พบหน้าที่ต้องการ
เซิร์ฟเวอร์ขัดข้อง 0
กรุณาเปิดใช้งานจาวาสคริปต์
ใส่ข้อความที่นี่
ገጹ አልተገኘም
የአገልጋይ ስህተት 0
ለመቀጠል javascript ያብሩ
ጽሑፍ እዚህ ያስገቡ
página no encontrada
error interno del servidor 0
active javascript para continuar
page introuvable
erreur interne du serveur 0
activez javascript pour continuer
seite nicht gefunden
interner serverfehler 0
bitte aktivieren sie javascript um fortzufahren
""".strip().split("\n")

#: Labelled exemplars of scope `part` that are filler: a window of their length whose tokens they all hold is enough.
PART = [x for x in WHOLE if x.startswith("lorem ipsum")]

# Shapes of marks; each becomes one token, and that token alone is an exemplar of scope `part`.
MARKS = {
    "{{}}": r"\{\{[^{}]{0,40}\}\}",
    "${}": r"\$\{[^{}]{0,40}\}",
    "{}": r"\{\s*(?:[\p{L}_][\w .-]{0,40}|\d{1,2})?\s*\}",
    "<>": r"<\s*/?[\p{L}_][\w .:/=-]{0,40}>",
    "&lt;&gt;": r"&lt;\s*[\p{L}_][\w .-]{0,40}&gt;",
    "%s": r"(?<![\w%])%(?:\([\w]+\))?[sdifr](?!\w)",
    "%%": r"%%\w{1,40}%%",
    "__": r"__\p{L}[\w]{0,40}__",
    "@@": r"@@\w{1,40}@@",
    "[tag]": r"^\W{0,3}\[\p{L}{2,3}(?:[-_]\p{L}{2,4})?\](?=\s*\S)",
    "[todo]": r"\[\s*(?:todo|tbd|fixme|insert|placeholder|untranslated|translate|translation|your|enter|missing)\b[^\[\]]{0,60}\]",
    "【】": r"【[^【】]{1,40}】",
}
_MARK = regex.compile("|".join(f"(?P<m{i}>{p})" for i, p in enumerate(MARKS.values())), regex.I)
_MARK_TOKEN = {f"m{i}": f"\x02{k}" for i, k in enumerate(MARKS)}
_WORD = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")
_ASCII_WORD = re.compile(r"[A-Za-z]+|[0-9]+")
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_SPACELESS = regex.compile(SPACELESS)
_FILL = regex.compile(r"^(.)\1{2,}$")


_MARKISH = re.compile(r"[{}<>%@\[【&]|__")


@lru_cache(200_000)
def plain_word(word: str) -> str:
    """Lower case and one form: a word of look-alikes that folds to Latin as a whole is Latin, any other keeps its script."""
    if word.isascii():
        return word.lower()
    latin = lookalike.fold(word).lower()
    return latin if latin.isascii() else lookalike.fold(word.lower())


@lru_cache(200_000)
def _pieces(word: str) -> tuple[str, ...]:
    w = plain_word(word)
    if w[0].isnumeric():
        return ("0",)
    if _SPACELESS.search(w):
        return tuple(w[i : i + 2] for i in range(max(1, len(w) - 1)))
    return ("xx" if _FILL.match(w) else w,)


def tokens(text: str) -> list[str]:
    """Marks as one token each, words in lower case, `0` for a number, two-character pieces of spaceless scripts."""
    out: list[str] = []
    if _MARKISH.search(text):
        rest, at = [], 0
        for m in _MARK.finditer(text):
            out.append(_MARK_TOKEN[m.lastgroup])
            rest.append(text[at : m.start()])
            at = m.end()
        if rest:
            text = " ".join(rest) + " " + text[at:]
    for w in (_ASCII_WORD if text.isascii() else _WORD).findall(text):
        out += _pieces(w)
    return out


_UNSEEN = regex.compile(r"[\p{Cf}]+")


_WIDE = regex.compile(r"[\uff01-\uff5e]")


def visible(text: str) -> str:
    """Without invisible characters, and widths folded, so that marks and words stand as a reader sees them."""
    if text.isascii():
        return text
    return _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), _UNSEEN.sub("", text))


@lru_cache(1)
def _parts() -> list[frozenset[str]]:
    return [frozenset(tokens(x)) for x in PART]


def _part_window(toks: list[str]) -> bool:
    return any(len(p) >= 4 and t in p and set(toks[i : i + len(p)]) == p for p in _parts() for i, t in enumerate(toks))


@lru_cache(2)
def index(whole: tuple[str, ...] = tuple(WHOLE)) -> tuple[dict[str, tuple[int, ...]], list[int]]:
    """token -> exemplars that hold it; the number of distinct tokens of each exemplar."""
    posts: dict[str, list[int]] = {}
    sizes = []
    for i, x in enumerate(whole):
        held = set(tokens(x))
        sizes.append(len(held))
        for t in held:
            posts.setdefault(t, []).append(i)
    return {t: tuple(p) for t, p in posts.items()}, sizes


def coverage(toks: list[str], idf: dict[str, float], rarest: float, exemplars: tuple[dict[str, tuple[int, ...]], list[int]]) -> float:
    """The share of the text's TF-IDF mass that lies in windows' best exemplars; 1.0 where a mark fills a window."""
    if not toks:
        return 0.0
    if any(t[0] == "\x02" for t in toks) or _part_window(toks):
        return 1.0
    posts, sizes = exemplars
    if not any(t in posts for t in toks):
        return 0.0
    held = mass = 0.0
    step = WINDOW // 2
    for a in range(0, max(1, len(toks) - step), step):
        window = toks[a : a + WINDOW]
        score: dict[int, float] = {}
        distinct: dict[int, int] = {}
        whole = 0.0
        seen: set[str] = set()
        for t in window:
            w = idf.get(t, rarest)
            whole += w
            for e in posts.get(t, ()):
                score[e] = score.get(e, 0.0) + w
                distinct[e] = distinct.get(e, 0) + (t not in seen)
            seen.add(t)
        held += max((v for e, v in score.items() if distinct[e] >= EXEMPLAR_SHARE * sizes[e]), default=0.0)
        mass += whole
    return held / mass if mass else 0.0


def _terms(text: Column) -> Column:
    """The distinct tokens of a text, marks aside, as tokens() cuts them, inside the JVM; look-alikes are not folded."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\p{N}+", "0"), F.lit(r"[\p{L}\p{M}]+|0"), 0)
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    cut = F.flatten(F.transform(words, lambda w: F.when(F.rlike(w, F.lit(SPACELESS)), pieces(w)).otherwise(F.array(w))))
    return F.array_distinct(F.when(F.rlike(text, F.lit(SPACELESS)), cut).otherwise(words))


def document_frequency(texts: DataFrame, col: str) -> tuple[dict[str, float], float]:
    """Inverse document frequencies, counted over all rows. Sent are those of the most frequent MOST_TERMS terms at most; every
    other term has the weight of the rarest that might be sent, log(RAREST) or less."""
    n = texts.count()
    rows = (
        texts.select(F.explode(_terms(F.col(col))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > max(1.0, n / RAREST)).orderBy(F.desc("n"), "t").limit(MOST_TERMS).collect()
    )
    top = math.log(RAREST) if len(rows) < MOST_TERMS else min(math.log(RAREST), math.log(n / rows[-1].n))
    return {r.t: min(top, max(0.1, math.log(n / r.n))) for r in rows}, top


def key_tokens(weights: dict[str, float], top: float, whole: tuple[str, ...] = tuple(WHOLE)) -> frozenset[str]:
    """Tokens of which a text holds one if it holds EXEMPLAR_SHARE of any exemplar: of n tokens with k = ceil(share * n) needed,
    any n - k + 1 will do, so the rarest are taken."""
    out: set[str] = set()
    for x in whole:
        held = sorted(set(tokens(x)), key=lambda t: (-weights.get(t, top), t))
        need = max(1, math.ceil(EXEMPLAR_SHARE * len(held) - 1e-9))
        out.update(held[: len(held) - need + 1])
    return frozenset(out)


def _may_hold(text: Column, keys: frozenset[str]) -> Column:
    """False only for ASCII text without a mark's character and without any key token: its coverage is 0."""
    plain = sorted(k for k in keys if k.isascii() and k.isalpha())
    found = r"[^\x{0}-\x{7f}]|[{}<>%@\[]|&lt;|__|([a-z])\1\1" + ("|[0-9]" if "0" in keys else "") + r"|(?<![a-z])(?:" + "|".join(plain) + r")(?![a-z])"
    return F.rlike(F.lower(text), F.lit(found))


def residue_scores(texts: DataFrame, col: str, corpus: DataFrame, corpus_col: str, into: str = "coverage") -> DataFrame:
    """Adds the residue coverage of col, weighted by the frequencies in corpus. Null and blank texts get 0. ASCII texts that can
    hold no exemplar are told so inside the JVM; the others are scored whole."""
    idf, top = document_frequency(corpus, corpus_col)
    keys = key_tokens(idf, top)
    sent = texts.sparkSession.sparkContext.broadcast((idf, top, keys))

    @F.pandas_udf(T.DoubleType())
    def score(s: pd.Series) -> pd.Series:
        exemplars, known = index(), {}
        weights, most, hold = sent.value
        out = []
        for t in s:
            if t is None or t != t:
                out.append(0.0)
                continue
            if t not in known:
                if len(known) > 50_000:
                    known.clear()
                toks = tokens(visible(t))
                known[t] = coverage(toks, weights, most, exemplars) if not hold.isdisjoint(toks) or any(x[0] == "\x02" for x in toks) else 0.0
            out.append(known[t])
        return pd.Series(out, dtype="float64")

    # not deterministic for the optimiser, which would else move the test below joins that leave few rows
    run = score.asNondeterministic()
    open_rows = F.coalesce(_may_hold(F.col(col), keys), F.lit(False))
    return spread(texts).withColumn(into, F.coalesce(run(F.when(open_rows, F.col(col))), F.lit(0.0)))


def entries(canonical: DataFrame, multilingual: DataFrame) -> DataFrame:
    """(src, lang, id, text) of both tables, without null and blank texts."""
    a = canonical.select(F.lit("canonical").alias("src"), F.lit("").alias("lang"), F.col("canon_id").alias("id"), F.col("input").alias("text"))
    b = multilingual.select(F.lit("multilingual_intents").alias("src"), F.col("ml_id").alias("id"), F.explode("inputs").alias("lang", "text"))
    return a.unionByName(b.select(a.columns)).where(~blank(F.col("text")))


def split_residue(rows: DataFrame, col: str, corpus: DataFrame | None = None, corpus_col: str | None = None, contained: float = CONTAINED) -> DataFrame:
    """rows with a column is_residue. Frequencies come from all of corpus, by default rows itself."""
    scored = residue_scores(rows, col, rows if corpus is None else corpus, corpus_col or col)
    return scored.withColumn("is_residue", F.col("coverage") >= contained).drop("coverage")
