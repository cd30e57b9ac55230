"""Problem 8: passages of evaluation texts inside corpus documents.

Pigeonhole edit matching. Each item's letters are cut into a grid of pieces so short that a passage of `run` letters with
at most `errors` edits holds one piece unharmed; exact piece hits are found by one automaton over all items, hits on the
same diagonal are joined, and each candidate is verified by Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import LMN, spread

RUN, ERRORS = 40, 1
#: Items are a stated set of bounded size: together at most so many letters are sent to the executors.
ITEM_LETTERS = 20_000_000


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[^{LMN}]+", "")


def piece_length(run: int, errors: int) -> int:
    """A passage cut into errors + 1 parts has one part without an edit; such a part holds a whole piece of the grid."""
    return (run // (errors + 1) + 1) // 2


def myers(pattern: str, text: str) -> int:
    """The smallest edit distance of pattern to any part of text (Myers 1999, whole pattern in one big integer)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        peq[ch] |= 1 << i
    top, mask = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = mask, 0, m, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        best = min(best, score)
    return best


def _common_suffix(a: str, i: int, b: str, j: int) -> int:
    n = 0
    while i > n and j > n and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def _common_prefix(a: str, i: int, b: str, j: int) -> int:
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def errors_to_spare(s: str, doc: str, a: int, b: int, diagonal: int, run: int) -> int:
    """1 if a single edit at either end of the exact run [a, b) may lengthen it to `run`, else 2 or more."""
    need = run - (b - a) - 1
    if need <= 0:
        return 1
    right = max(_common_prefix(s, b + x, doc, b + diagonal + y) for x, y in ((1, 1), (1, 0), (0, 1)))
    left = max(_common_suffix(s, max(0, a - x), doc, max(0, a + diagonal - y)) for x, y in ((1, 1), (1, 0), (0, 1)))
    return 1 if max(right, left) >= need else 2


class Matcher:
    def __init__(self, items: list[tuple[int, str]], run: int, errors: int):
        self.items, self.run, self.errors = items, run, errors
        self.size = p = piece_length(run, errors)
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, s) in enumerate(items):
            if len(s) >= run:
                for at in range(0, len(s) - p + 1, p):
                    where[s[at : at + p]].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, tuple(at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def distances(self, doc: str) -> dict[int, int]:
        """item -> smallest number of edits (at most `errors`) under which doc holds a passage of `run` letters of it."""
        found: dict[int, int] = {}
        if not self.any or len(doc) < self.run - self.errors:
            return found
        p, run, errors = self.size, self.run, self.errors
        done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the exact run already examined there
        for end, hits in self.automaton.iter(doc):
            at = end - p + 1
            for k, pos in hits:
                if found.get(k, 1) == 0 or done.get((k, at - pos), -1) > at:
                    continue
                s = self.items[k][1]
                left = _common_suffix(s, pos, doc, at)
                right = _common_prefix(s, pos + p, doc, at + p)
                done[k, at - pos] = at + p + right
                a = pos - left
                if left + p + right >= run and myers(s[a : a + run], doc[at - left : at - left + run]) == 0:
                    found[k] = 0
                elif errors and (d := self._near(s, doc, pos - left, pos + p + right, at - pos)):
                    found[k] = min(found.get(k, errors), d)
        return found

    def _near(self, s: str, doc: str, a: int, b: int, diagonal: int) -> int:
        """All windows of `run` letters of the item that keep at least the pigeonhole's share of the exact run [a, b), by Myers'
        distance, the smallest; 0: none within errors."""
        best, half = 0, self.run // (self.errors + 1)
        if b - a < half or self.errors == 1 and errors_to_spare(s, doc, a, b, diagonal, self.run) > 1:
            return 0
        for start in range(max(0, a + half - self.run), min(b - half, len(s) - self.run) + 1):
            d = myers(s[start : start + self.run], doc[max(0, start + diagonal - self.errors) : start + diagonal + self.run + self.errors])
            if 0 < d <= self.errors and (not best or d < best):
                best = d
                if best == 1:
                    break
        return best


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, errors: int = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance): documents that hold a passage of at least `run` letters of an item, within so many edits.

    The items are the broadcast side, checked against ITEM_LETTERS; documents are scanned once, without a shuffle, whole.
    Null or short texts hold nothing; repeated documents each have their rows; columns are taken by name, others ignored.
    """
    rows = items.select(F.col(item_id).alias("i"), letters(F.col(item_text)).alias("s")).where("s is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]
    if size > ITEM_LETTERS:
        parts = -(-size // ITEM_LETTERS)
        slices = [leaks(docs, doc_id, text, items.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == k), item_id, item_text, run, errors) for k in range(parts)]
        out = slices[0]
        for x in slices[1:]:
            out = out.unionByName(x)
        return out
    sent = docs.sparkSession.sparkContext.broadcast([(r.i, r.s) for r in rows.collect()])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(sent.value, run, errors)
        for b in batches:
            out = [(d, m.items[k][0], n) for d, s in zip(b["d"], b["s"], strict=True) for k, n in m.distances(s).items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance"])

    lean = spread(docs.select(F.col(doc_id), F.col(text))).select(F.col(doc_id).alias("d"), letters(F.col(text)).alias("s")).where(F.length("s") >= run - errors)
    return lean.mapInPandas(scan, "doc_id bigint, item_id bigint, distance int")
