"""Problem 3: text that looks the same in different characters is brought to one form.

Look-alike pairs (strings and code points) come from rules over the Unicode tables plus a short fixed list of
letters; union-find makes their classes transitive; the member most frequent in the corpus represents its class; a
multi-pattern automaton rewrites text greedily, longest match first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from kordel.common import materialize, spread

# Letters of other scripts drawn like a Latin letter, as pairs "other Latin".
CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW".split()
GREEK = "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX".split()
ARMENIAN = "ոn օo սu հh յj զq ցg ՕO ՍU ՏS ԼL".split()
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ".split()
OTHER = ["‐-", "ıi", "ϲc", "ϹC", "ϳj", "ɡg", "ɑa", "ʏY"]

#: Rows a left block of the pair join holds at most; larger classes are cut into several blocks.
BLOCK = 20_000


def _ignorable(ch: str) -> bool:
    """Code points that leave no mark: format characters but for the visible Arabic signs, joiners, variation selectors."""
    o = ord(ch)
    if unicodedata.category(ch) == "Cf":
        return not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2, 0x890, 0x891) or 0x110BD <= o <= 0x110CD)
    return o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


@lru_cache(1)
def pairs() -> tuple[tuple[str, str], ...]:
    """Look-alike pairs: widths, presentation forms, ligatures, spaces, invisible characters, and the fixed letters."""
    out = [(p[0], p[1]) for p in CYRILLIC + GREEK + ARMENIAN + CHEROKEE + OTHER]
    for o in (*range(0x80, 0x3400), *range(0x1D400, 0x1D800), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0xE0000, 0xE01F0)):
        ch = chr(o)
        if _ignorable(ch):
            out.append((ch, ""))
        elif unicodedata.category(ch) == "Zs" and o != 0x1680:
            out.append((ch, " "))
        else:
            kind, _, to = unicodedata.decomposition(ch).partition(" ")
            styled = kind == "<font>" and (0x1D400 <= o <= 0x1D7FF or 0x2100 <= o <= 0x214F)  # alphabets of mathematics
            shaped = 0xFB00 <= o <= 0xFB06 or 0xFB50 <= o <= 0xFDFF or 0xFE70 <= o <= 0xFEFC
            if kind in ("<wide>", "<narrow>", "<noBreak>") or styled or kind.startswith("<") and (shaped and len(to) < 24 or 0x2160 <= o <= 0x217F or o in (0xE33, 0xEB3)):
                out.append((ch, unicodedata.normalize("NFKD", "".join(chr(int(x, 16)) for x in to.split()))))
    return tuple(out)


@lru_cache(1)
def classes() -> dict[str, tuple[str, ...]]:
    """Every string of a pair -> its whole class, by union-find."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs():
        up[root(a)] = root(b)
    groups: dict[str, list[str]] = {}
    for x in up:
        groups.setdefault(root(x), []).append(x)
    return {x: tuple(sorted(g)) for g in groups.values() for x in g}


def rules(frequency: dict[str, int] | None = None) -> dict[str, str]:
    """String -> representative: the empty string if in the class, else the most frequent, then ASCII, then the smallest."""
    f = frequency or {}
    best = {g: "" if "" in g else min(g, key=lambda x: (-f.get(x, 0), not x.isascii(), x)) for g in set(classes().values())}
    return {x: best[g] for x, g in classes().items() if x != best[g]}


@lru_cache(1)
def _unsettled() -> tuple[str, ...]:
    """Code points that decomposing and composing again may change, alone or with a neighbour."""
    return tuple(chr(o) for o in range(0x80, 0x30000) if not 0xD800 <= o < 0xE000 and (unicodedata.category(chr(o))[0] == "M" or 0x1100 <= o < 0x1200 or unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(o))) != chr(o)))


def _ranges(chars: Iterable[str]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for o in sorted(set(map(ord, chars))):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return [(a, b) for a, b in out]


def _class_of(firsts: Iterable[str]) -> re.Pattern:
    """Matches text that rewriting may change: it holds a first letter of a rule, as it is or composed, or is not settled."""
    bare = set(firsts)
    composed = (chr(o) for o in range(0xC0, 0x30000) if not 0xD800 <= o < 0xE000 and unicodedata.decomposition(chr(o))[:1] not in ("", "<") and unicodedata.normalize("NFD", chr(o))[0] in bare)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges([*bare, *composed, *_unsettled()])) + "]")


class Rewriter:
    """Greedy longest-match rewriting by an automaton, between canonical decomposition and composition."""

    def __init__(self, frequency: dict[str, int] | None = None):
        self.rules = rules(frequency)
        self.automaton = ahocorasick.Automaton()
        for x, y in self.rules.items():
            self.automaton.add_word(x, (len(x), y))
        self.automaton.make_automaton()
        self.touched = _class_of(x[0] for x in self.rules)
        self.quiet = not any(x.isascii() for x in self.rules)  # plain ASCII is its own form

    def __call__(self, text: str) -> str:
        if self.quiet and text.isascii() or not self.touched.search(text):
            return text
        s, out, at = unicodedata.normalize("NFD", text), [], 0
        for end, (n, to) in self.automaton.iter_long(s):
            out += (s[at : end - n + 1], to)
            at = end + 1
        return unicodedata.normalize("NFC", "".join(out) + s[at:])


@lru_cache(4)
def rewriter(frequency: tuple[tuple[str, int], ...] = ()) -> Rewriter:
    return Rewriter(dict(frequency))


def fold(text: str) -> str:
    """The form under the default representatives (ASCII where there is one)."""
    return rewriter()(text)


def member_frequency(texts: DataFrame, col: str) -> tuple[tuple[str, int], ...]:
    """Occurrences over all rows of every string that is in some class. At most as many rows as there are such strings."""
    known = frozenset(x for x in classes() if x)
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            text = "\n".join(b[col])
            points, times = np.unique(np.frombuffer((text if text.isascii() else unicodedata.normalize("NFD", text)).encode("utf-32-le"), dtype=np.uint32), return_counts=True)
            for o, m in zip(points.tolist(), times.tolist(), strict=True):
                if chr(o) in known:
                    seen[chr(o)] = seen.get(chr(o), 0) + m
            for x in () if text.isascii() else known_long:
                if (m := text.count(x)):
                    seen[x] = seen.get(x, 0) + m
        yield pd.DataFrame({"x": list(seen), "n": list(seen.values())}, columns=["x", "n"])

    known_long = [x for x in known if len(x) > 1]
    rows = texts.select(col).where(F.col(col).isNotNull()).mapInPandas(count, schema).groupBy("x").agg(F.sum("n").alias("n")).collect()
    return tuple(sorted((r.x, r.n) for r in rows))


def same_form(texts: DataFrame, col: str, into: str, frequency: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Adds column `into`: the one form of col. Null stays null; text of any length is rewritten whole."""

    @F.pandas_udf(T.StringType())
    def rewrite(s: pd.Series) -> pd.Series:
        r = rewriter(frequency)
        return s.map(r, na_action="ignore").astype(object)

    plain = not any(x.isascii() for x in rules(dict(frequency)))
    if plain:  # ASCII text never reaches Python
        ascii_only = ~F.rlike(F.col(col), F.lit(r"[^\x{0}-\x{7f}]"))
        return texts.withColumn(into, F.coalesce(F.when(ascii_only, F.col(col)), rewrite(F.when(~ascii_only, F.col(col)))))
    return texts.withColumn(into, rewrite(F.col(col)))


def looks(entries: DataFrame, frequency: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """entries(src, lang, id, text) with look, code and altered: equal look = same appearance, equal code = same text, altered =
    not stored in the one form of its look."""
    return same_form(spread(entries), "text", "form", frequency).select(
        "src", "lang", "id", "text",
        F.unhex(F.md5(F.concat_ws("\x01", "src", "lang", "form"))).alias("look"),
        F.xxhash64("text").alias("code"), (F.col("form") != F.col("text")).alias("altered"),
    )


def _shared(e: DataFrame, block: int) -> DataFrame:
    """(look, main, blocks) of the looks that two or more different texts have; main is the code of the most frequent."""
    variants = e.groupBy("look", "code").agg(F.count(F.lit(1)).alias("n"))
    by_look = variants.groupBy("look").agg(F.max_by("code", F.struct("n", "code")).alias("main"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts"))
    return by_look.where("texts > 1").select("look", F.col("main").alias("main_code"), "rows", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))


def same_look_rows(
    entries: DataFrame, frequency: tuple[tuple[str, int], ...] = (), block: int = BLOCK, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(src, lang, id, look, code, main, rows, blocks) of the rows whose look two or more different texts have.

    Two texts of one look can't both be stored in its one form: so only looks of altered rows go on, and of them those with
    several texts; `keep` may then leave rows out by their text (so that a costly test runs on those few rows instead of on
    all). Null and blank texts are to be left out by the caller; duplicates and an empty table are fine."""
    e = materialize(looks(entries, frequency), "looks")
    e = e.join(e.where("altered").select("look").distinct(), "look", "left_semi").drop("altered")
    e = materialize(e, "candidates")
    if keep:
        e = keep(materialize(e.join(_shared(e.select("look", "code"), block).select("look"), "look", "left_semi"), "shared"))
        e = materialize(e.select("src", "lang", "id", "look", "code"), "kept-looks")
    return materialize(e.select("src", "lang", "id", "look", "code").join(_shared(e.select("look", "code"), block), "look").withColumn("main", F.col("code") == F.col("main_code")), "look-rows")


def same_look_classes(rows: DataFrame) -> DataFrame:
    """(src, lang, id, class_id, links) of the rows of same_look_rows(): class_id is the smallest id of the class, links the
    number of rows that look the same in different characters."""
    texts = rows.groupBy("look", "code").agg(F.count(F.lit(1)).alias("same"))
    ids = rows.groupBy("look").agg(F.min("id").alias("class_id"))
    return rows.join(ids, "look").join(texts, ["look", "code"]).select("src", "lang", "id", "class_id", (F.col("rows") - F.col("same")).alias("links"))


def same_look_pairs(rows: DataFrame) -> DataFrame:
    """(src, lang, id_a, id_b), id_a < id_b: all pairs of the rows of same_look_rows() that look the same and differ.

    In each class the most frequent text is the main one; every pair has a row that is not of the main text, so those few rows
    on the left meet all rows of the class on the right, which are cut into blocks: a class of any size is spread over
    n / block tasks and no group of equal texts is paired with itself."""
    left = rows.where("not main").select("look", "code", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.select("look", "src", "lang", F.col("code").alias("code2"), F.col("id").alias("y"), "main", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return left.join(right, ["look", "block"]).where("code != code2 and (main or x < y)").select(
        "src", "lang", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    )
