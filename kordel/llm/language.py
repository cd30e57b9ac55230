"""Problem 4: the language of every text and of every segment of a mixed text.

Word-first backoff: a word known to the model is scored by its log frequency per language; an unseen word falls back to
ever shorter character n-grams. The model is fitted on all labelled rows, twice: the second fit leaves out rows whose label
the first contradicts, so wrong labels do not teach.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from kordel.common import blank, bounded_sample, discard, materialize, norm_key, spread
from kordel.llm import lookalike

# The languages and the family of each.
FAMILY = {
    "english": "english", "spanish": "english", "french": "english", "german": "english", "chinese": "cjk", "japanese": "cjk",
    "arabic": "arabic", "hindi": "indic", "russian": "cyrillic", "ukrainian": "cyrillic", "greek": "greek", "hebrew": "hebrew",
    "thai": "southeast_asian", "amharic": "ethiopic",
}
LANGUAGES = list(FAMILY)
#: Codes of the documents table.
CODES = {"en": "english", "es": "spanish", "fr": "french", "de": "german", "ru": "russian", "zh": "chinese", "ja": "japanese", "hi": "hindi", "ar": "arabic", "el": "greek", "th": "thai", "am": "amharic"}



def _char_class(test) -> str:
    """The code points of the first two planes that pass, as the body of a class of the re module."""
    out, start = [], None
    for o in range(0x20000):
        if test(o):
            start = o if start is None else start
        elif start is not None:
            out.append(f"{chr(start)}-{chr(o - 1)}")
            start = None
    return "".join(out).replace("\\", "")


def _spaceless(o: int) -> bool:
    return 0x2E80 <= o <= 0x2FDF or o in (0x3005, 0x3007) or 0x3040 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xE00 <= o <= 0xE7F


_LETTER = _char_class(lambda o: not _spaceless(o) and unicodedata.category(chr(o))[0] in "LM")
_TOKEN = re.compile(rf"[㐀-鿿豈-﫿⺀-⿟々〇]+|[぀-ゟ]+|[゠-ヿㇰ-ㇿ]+|[ก-๎]+|[{_LETTER}]+(?:['’ʼ][{_LETTER}]+)*")
_ASCII_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)*")
_PIECED = re.compile(r"[㐀-鿿豈-﫿⺀-⿟々〇぀-ヿㇰ-ㇿก-๎]")
_MIXES = re.compile(r"[！-ﾝﬀ-ﬆ]|[A-Za-z][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-z]")
_INVISIBLE = re.compile("[͏" + _char_class(lambda o: unicodedata.category(chr(o)) == "Cf") + "]+")
_SCRIPTS = [
    (regex.compile(p), frozenset(ls.split()))
    for p, ls in (
        (r"\p{Latin}", "english spanish french german"), (r"[\p{Hiragana}\p{Katakana}ー]", "japanese"), (r"\p{Han}", "chinese japanese"),
        (r"\p{Cyrillic}", "russian ukrainian"), (r"\p{Arabic}", "arabic"), (r"\p{Devanagari}", "hindi"), (r"\p{Greek}", "greek"),
        (r"\p{Hebrew}", "hebrew"), (r"\p{Thai}", "thai"), (r"\p{Ethiopic}", "amharic"),
    )
]
#: n-grams of unseen words, longest first; the weight of a language's evidence from them; the floor of a log probability; a
#: word's occurrences in a language that its n-grams count at most; occurrences of an n-gram that say something.
GRAMS, UNSEEN_WEIGHT, FLOOR, GRAM_MOST, GRAM_LEAST = (5, 4, 3, 2, 1), 0.25, -8.0, 50, 3
#: A word is known where its occurrences differ from the languages' shares by this log likelihood ratio (the second: among
#: the languages of its script) and at most two
#: languages hold KNOWN_SHARE of it; names, which stand in any language, stay unknown. A second segment must win by SEGMENT_GAIN, and so must its language within it.
KNOWN_RATIO, SCRIPT_RATIO, KNOWN_SHARE, STRAY, SEGMENT_GAIN = 24.0, 6.0, 0.85, 0.15, 5.0


def words(text: str) -> list[str]:
    """Words in lower case; spaceless scripts as overlapping pairs of characters."""
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    if not _PIECED.search(text):
        return [w.lower() for w in _TOKEN.findall(text)]
    out: list[str] = []
    for w in _TOKEN.findall(text):
        if len(w) > 2 and _PIECED.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w.lower())
    return out


def starts(text: str) -> list[int]:
    """The offset of each of words(text)."""
    if text.isascii():
        return [m.start() for m in _ASCII_TOKEN.finditer(text.lower())]
    out: list[int] = []
    for m in _TOKEN.finditer(text):
        w = m[0]
        out += range(m.start(), m.end() - 1) if len(w) > 2 and _PIECED.match(w) else [m.start()]
    return out


def plain(text: str) -> str:
    """Without invisible characters; folded to Latin look-alikes where some word mixes scripts or widths."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))
    if not _MIXES.search(text):
        return text
    foreign = not _OWN.search(text)  # every Cyrillic or Greek letter has a Latin twin
    out = []
    for part in re.split(r"([^\W\d_]+)", text):
        f = lookalike.fold(part)
        out.append(f if foreign or f.isascii() else part)
    return "".join(out)


_TWINS = {p[0] for p in lookalike.CYRILLIC + lookalike.GREEK}
_OWN = re.compile("[" + _char_class(lambda o: 0x370 <= o <= 0x52F and chr(o) not in _TWINS and unicodedata.category(chr(o))[0] == "L") + "]")


def has_own_letters(text: str) -> bool:
    """Whether some Cyrillic or Greek letter has no Latin twin."""
    return _OWN.search(text) is not None


def _ratio(own: list[int], sums: dict[str, int], among) -> float:
    """Log likelihood ratio of the counts against the languages' shares."""
    kept = [(c, sums[x]) for c, x in zip(own, LANGUAGES, strict=True) if x in among]
    n, mass = sum(c for c, _ in kept), sum(m for _, m in kept)
    return sum(c * math.log(c * mass / (n * m)) for c, m in kept if c)


def known_vector(word: str, own: list[int], sums: dict[str, int]) -> tuple[float, ...] | None:
    """The word's log rates by language less the greatest, if it is known; sums: one more than all words of each language."""
    rates = [c / sums[x] for c, x in zip(own, LANGUAGES, strict=True)]
    rates = [r if r > STRAY * max(rates) else 0.0 for r in rates]  # the rest comes from wrong labels and mixtures
    if sum(sorted(rates)[-2:]) < KNOWN_SHARE * sum(rates) or _ratio(own, sums, LANGUAGES) < KNOWN_RATIO:
        return None
    fits = next((ls for p, ls in _SCRIPTS if p.search(word)), frozenset())
    if len(fits) >= 2 and _ratio(own, sums, fits) < SCRIPT_RATIO:
        return None
    return tuple(math.log(r / max(rates)) if r else FLOOR for r in rates)


@lru_cache(1000)
def _unseen_vector(fits: frozenset[str], winner: int | None, foreign: float) -> tuple[float, ...]:
    return tuple((0.0 if winner is None or i == winner else -UNSEEN_WEIGHT * 4) if x in fits else foreign for i, x in enumerate(LANGUAGES))


class Model:
    """Scores of words and n-grams; picklable, of the size of the vocabulary. logs has a row for each of grams."""

    def __init__(self, known: dict[str, tuple[float, ...]], grams: dict[str, int] | None = None, logs: np.ndarray | None = None):
        self.known, self.grams, self.logs = known, grams or {}, logs
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.vectors: list[tuple[float, ...]] = []
        self.by_vector: dict[tuple[float, ...], int] = {}
        self.results: dict[tuple[int, ...], tuple] = {}

    def __getstate__(self) -> dict:
        return {"known": self.known, "grams": self.grams, "logs": self.logs}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def unseen(self, word: str) -> tuple[float, ...]:
        """Backoff: at each place the longest known n-gram; its evidence is damped, and one class per winner keeps the
        number of different vectors small. Languages of another script are out."""
        fits = _SCRIPTS[0][1] if word.isascii() else next((ls for p, ls in _SCRIPTS if p.search(word)), frozenset())
        if not fits:
            return (0.0,) * len(LANGUAGES)
        winner = None  # of a script of one language there is nothing to choose
        if self.grams and len(fits) > 1:
            p, at, found = f"<{word}>", 0, []
            while at < len(p):
                for size in GRAMS:
                    k = self.grams.get(p[at : at + size]) if at + size <= len(p) else None
                    if k is not None:
                        found.append(k)
                        at += max(1, size - 1)
                        break
                else:
                    at += 1
            score = self.logs[found].sum(axis=0).tolist()
            order = sorted((i for i, x in enumerate(LANGUAGES) if x in fits), key=lambda i: -score[i])
            winner = order[0] if score[order[0]] - score[order[1]] > 4 else None
        # a lone word of another script may be a name; only several make a segment
        return _unseen_vector(fits, winner, 0.0 if fits == _SCRIPTS[0][1] else -0.75 if _PIECED.match(word) else -2.0)

    def word_id(self, word: str) -> int:
        v = self.known.get(word) or self.unseen(word)
        if len(self.ids) > 400_000:
            self.ids.clear()  # the vectors stay, few as they are: ids already taken from here still name them
        k = self.by_vector.get(v)
        if k is None:
            k = self.by_vector[v] = len(self.vectors)
            self.vectors.append(v)
        self.ids[word] = k
        return k

    def decide(self, key: tuple[int, ...]) -> tuple:
        """((language, confidence, first word), ...) of the segments that together win most, each change of language being
        charged SEGMENT_GAIN: so a segment wins within itself by more than that over its neighbours' languages. Among equals
        the fewest segments, then the earliest change."""
        vs = [self.vectors[k] for k in key]
        m = len(LANGUAGES)
        total = [sum(v[i] for v in vs) for i in range(m)]
        best = max(range(m), key=lambda i: (total[i], -i))
        if not any(any(v) for v in vs):
            return ((None, 0.0, 0),)
        if sum(map(max, vs)) <= total[best] + SEGMENT_GAIN:  # no change can pay
            return ((LANGUAGES[best], _confidence(total), 0),)
        # from the last word back: what the words from here on give if this one is of language i, and minus their changes
        score, changes = list(vs[-1]), [0] * m
        then: list[tuple[int, list[bool]]] = []
        for v in reversed(vs[:-1]):
            to = max(range(m), key=lambda i: (score[i], changes[i], -i))
            gain, n = score[to] - SEGMENT_GAIN, changes[to] - 1
            turn = [gain > score[i] or gain == score[i] and n >= changes[i] for i in range(m)]
            then.append((to, turn))
            score = [v[i] + (gain if turn[i] else score[i]) for i in range(m)]
            changes = [n if turn[i] else changes[i] for i in range(m)]
        i, first, out = max(range(m), key=lambda i: (score[i], changes[i], -i)), 0, []
        for k, (to, turn) in enumerate(reversed(then), 1):
            if turn[i]:
                out.append((i, first, k))
                i, first = to, k
        out.append((i, first, len(vs)))
        return tuple((LANGUAGES[i], _confidence([sum(v[x] for v in vs[a:b]) for x in range(m)]), a) for i, a, b in out)

    def segments(self, text: str) -> tuple:
        return self.segments_of(words(plain(text)))

    def segments_of(self, ws: list[str]) -> tuple:
        key, find = [], self.ids.get
        for w in ws:
            k = find(w)
            key.append(self.word_id(w) if k is None else k)
        t = tuple(key)
        found = self.results.get(t)
        if found is None:
            if len(self.results) > 200_000:
                self.results.clear()
            found = self.results[t] = self.decide(t)
        return found

    def distribution(self, text: str) -> dict[str, float]:
        """Probabilities of the languages of the text as a whole; nearly even where nothing is known of it."""
        vs = [self.vectors[self.ids[w] if w in self.ids else self.word_id(w)] for w in words(plain(text))]
        total = [sum(v[i] for v in vs) for i in range(len(LANGUAGES))]
        e = [math.exp(max(-60.0, t - max(total))) for t in total]
        return {x: y / sum(e) for x, y in zip(LANGUAGES, e, strict=True)}


def _confidence(score: list[float]) -> float:
    top = max(score)
    return 1.0 / sum(math.exp(max(-60.0, s - top)) for s in score)


def language_name(label: Column) -> Column:
    """The label in the names above; null where it names no language."""
    x = norm_key(label)
    return F.when(x.isin(LANGUAGES), x)


#: Counts that a task holds before it hands them on.
_HELD = 200_000
_COUNTS = [f"c{i}" for i in range(len(LANGUAGES))]


def _count(df: DataFrame, add: Callable[[pd.DataFrame, list[Counter]], None]) -> DataFrame:
    """(w, c0, c1, ...): occurrences by language of the strings that add() counts, over all rows of df."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [Counter() for _ in LANGUAGES]

        def held() -> pd.DataFrame:
            out = pd.DataFrame([(w, i, n) for i, c in enumerate(found) for w, n in c.items()], columns=["w", "i", "n"])
            for c in found:
                c.clear()
            return out

        for b in batches:
            add(b, found)
            if sum(map(len, found)) > _HELD:
                yield held()
        yield held()

    return df.mapInPandas(count, "w string, i int, n long").groupBy("w").agg(*[F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(_COUNTS)])


def _known(counts: DataFrame, sums: dict[str, int]) -> dict[str, tuple[float, ...]]:
    """The known words, decided by the executors, so that no others reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vs = [(w, v) for w, own in zip(b["w"], b[_COUNTS].to_numpy().tolist(), strict=True) if (v := known_vector(w, own, sums))]
            yield pd.DataFrame(vs, columns=["w", "v"])

    return {r.w: tuple(r.v) for r in counts.mapInPandas(run, "w string, v array<double>").collect()}


def _sums(counts: DataFrame, *more) -> tuple[dict[str, int], list[int]]:
    """One more than all words of each language, and the sums of more columns."""
    r = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (*_COUNTS, *more)]).first()
    return {x: n + 1 for x, n in zip(LANGUAGES, r, strict=False)}, list(r)[len(LANGUAGES) :]


def _add_grams(b: pd.DataFrame, found: list[Counter]) -> None:
    ids: dict[str, int] = {}
    at: list[int] = []
    many = []
    for w in b["w"]:
        p = f"<{w}>"
        parts = [p[a : a + size] for size in GRAMS for a in range(len(p) - size + 1)]
        at += [ids.setdefault(g, len(ids)) for g in parts]
        many.append(len(parts))
    if not ids:
        return
    for c, own in zip(found, _COUNTS, strict=True):
        sums = np.bincount(at, weights=np.repeat(np.minimum(b[own].to_numpy(), GRAM_MOST), many), minlength=len(ids))
        c.update({g: int(n) for g, n in zip(ids, sums.tolist(), strict=True) if n})


def fit(rows: DataFrame, text: str, label: str, key: list[str], fit_rows: int | None = None) -> Model:
    """Fits on all labelled rows, of any length: the executors count, and the driver gets the words and n-grams that the model
    holds. fit_rows: fits on about so many rows, 2 * fit_rows at most, drawn by a hash of the key columns, which identify a row."""
    labelled = rows.select(*key, language_name(F.col(label)).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & ~blank(F.col("t")))
    if fit_rows is not None:
        labelled = bounded_sample(labelled, key, fit_rows)
    place = F.create_map(*[x for i, lang in enumerate(LANGUAGES) for x in (F.lit(lang), F.lit(i))])
    labelled = spread(labelled.select(place[F.col("l")].alias("l"), "t"))

    def add_all(b: pd.DataFrame, found: list[Counter]) -> None:
        for i, t in zip(b["l"], b["t"], strict=True):
            found[i].update(words(plain(t)))

    counts = materialize(_count(labelled, add_all), "words")
    first = Model(_known(counts, _sums(counts)[0]))
    discard(counts)
    sent = rows.sparkSession.sparkContext.broadcast(first)

    def add_agreed(b: pd.DataFrame, found: list[Counter]) -> None:
        find = sent.value.segments_of
        for i, t in zip(b["l"], b["t"], strict=True):
            ws = words(plain(t))
            s = find(ws)
            if len(s) == 1 and s[0][0] == LANGUAGES[i]:
                found[i].update(ws)

    counts = materialize(_count(labelled, add_agreed), "words")
    sent.unpersist()
    of_size = lambda size, c: F.least(c, F.lit(GRAM_MOST)) * F.greatest(F.lit(0), F.char_length("w") + (3 - size))
    sums, mass = _sums(counts, *[of_size(size, F.col(c)) for size in GRAMS for c in _COUNTS])
    if all(n == 1 for n in sums.values()):  # no label agrees
        discard(counts)
        return first
    known = _known(counts, sums)
    grams = _count(counts, _add_grams).where(sum(F.col(c) for c in _COUNTS) >= GRAM_LEAST).toArrow()
    discard(counts)
    names = grams["w"].to_pylist()
    masses = 1 + np.array(mass, dtype=np.float64).reshape(len(GRAMS), len(LANGUAGES))
    size_of = np.array([GRAMS.index(len(g)) for g in names], dtype=np.int64)
    logs = np.column_stack([grams[c].to_numpy() for c in _COUNTS]).astype(np.float64)
    return Model(known, {g: k for k, g in enumerate(names)}, np.log((logs + 1e-2) / masses[size_of]))


SEGMENT = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("start", T.IntegerType())]))


def identify(rows: DataFrame, text: str, model: Model, into: str = "segments") -> DataFrame:
    """Adds an array of (lang, confidence, start): one element, or one a segment where the text mixes languages. start is the
    code point offset in the text without invisible characters. Null or blank text, and text without letters, has one
    element with a null language and confidence 0."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SEGMENT)
    def run(s: pd.Series) -> pd.Series:
        m = sent.value
        out = []
        for t in s:
            if not isinstance(t, str) or not t:
                out.append([(None, 0.0, 0)])
                continue
            found = m.segments(t)
            if len(found) > 1:
                at = starts(plain(t))
                found = (found[0], *((a, c, at[k]) for a, c, k in found[1:]))
            out.append([{"lang": a, "confidence": c, "start": k} for a, c, k in found])
        return pd.Series(out)

    return spread(rows).withColumn(into, run(F.col(text)))


def codes_of(rows: DataFrame, text: str, model: Model, into: str) -> DataFrame:
    """The compact form: `a` or `a+b+...`, each language once, empty where none shows. One string a row, so little passes
    from Python."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        find = sent.value.segments
        return pd.Series(["+".join(dict.fromkeys(x[0] or "" for x in find(t))) if isinstance(t, str) else "" for t in s], dtype=object)

    return spread(rows).withColumn(into, run(F.col(text)))


def label_cases(families: DataFrame, model: Model) -> DataFrame:
    """(rec_id, lang): rows of families whose language or family label is missing or wrong, or whose input is mixed."""
    found = codes_of(families.where(~blank(F.col("input"))).select("fam_id", "input", "language", "family"), "input", model, "langs").where("langs != ''")
    family_of = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    mixed = F.contains(F.col("langs"), F.lit("+"))
    right = F.coalesce(norm_key(F.col("language")) == F.col("langs"), F.lit(False)) & F.coalesce(norm_key(F.col("family")) == family_of[F.col("langs")], F.lit(False))
    return found.where(mixed | ~right).select(F.col("fam_id").alias("rec_id"), F.explode(F.split("langs", r"\+")).alias("lang"))


def foreign_cases(canonical: DataFrame, model: Model) -> DataFrame:
    """(rec_id, input, lang): inputs of canonical that are not wholly in English."""
    found = codes_of(canonical.where(~blank(F.col("input"))).select("canon_id", "input"), "input", model, "langs")
    return found.where("langs not in ('', 'english')").select(F.col("canon_id").alias("rec_id"), "input", F.explode(F.split("langs", r"\+")).alias("lang"))
