"""Problem 9: documents of several sources mixed to target shares of the tokens.

Soft-membership mixing: a classifier fitted on the labelled table gives every document posteriors over the domains, its
own label being strong but not certain evidence. Nonnegative document rates, capped by the repeats its source allows, are
then fitted by projected gradients to the least squares between the expected token totals of the domains and the targets;
each step is one distributed sum. Rates become whole copies by rounding with a hash.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kordel.common import bounded_sample, materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Cells of the histogram by which rounding is set right.
CELLS = 8192
#: The pre-tokenisation of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: The classifier is fitted on about FIT_ROWS labelled documents, over hashed words.
FIT_ROWS, BUCKETS = 20_000, 1 << 14
#: A document's words together weigh like so many; the chance that a label is wrong.
EFFECTIVE_WORDS, LABEL_NOISE = 10.0, 0.001
STEPS, TOLERANCE = 40, 1e-4
OTHER = "\x00other"
_WORD = regex.compile(r"[\p{L}\p{M}]+|\p{N}")


@lru_cache(2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str, into: str = "tokens", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Adds the number of tokens of the whole text; null and empty text have 0. path must exist on the executors."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        e = _encoder(path, pattern)
        return pd.Series([len(e.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in s], dtype="int64")

    return docs.withColumn(into, count(F.col(text)))


@lru_cache(200_000)
def _bucket(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


def _features(text) -> np.ndarray:
    words = [_bucket(w) for w in _WORD.findall(text.lower())] if isinstance(text, str) else []
    return np.asarray(words, dtype=np.int64)


def fit_domains(docs: DataFrame, id_col: str, text: str, source: str, domains: list[str], fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log word probabilities) by domain, counted by the executors on a sample of about fit_rows labelled
    documents; one vector of BUCKETS numbers a domain comes back."""
    at = {d: i for i, d in enumerate(domains)}
    labelled = docs.select(F.col(id_col).alias("id"), F.col(source).alias("s"), F.col(text).alias("t")).where("s is not null and t is not null")
    labelled = bounded_sample(labelled, ["id"], fit_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, rows = np.zeros((len(domains), BUCKETS)), np.zeros(len(domains))
        for b in batches:
            for s, t in zip(b["s"], b["t"], strict=True):
                i = at.get(s, at[OTHER])
                rows[i] += 1
                np.add.at(c[i], _features(t), 1.0)
        for i in np.flatnonzero(rows):
            k = np.flatnonzero(c[i])
            yield pd.DataFrame({"domain": int(i), "bucket": [*k.tolist(), -1], "n": [*c[i][k].tolist(), rows[i]]})

    out, rows = np.full((len(domains), BUCKETS), 0.5), np.ones(len(domains))
    for r in labelled.mapInPandas(count, "domain int, bucket int, n double").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            rows[r.domain] += r.n
        else:
            out[r.domain, r.bucket] += r.n
    return np.log(rows / rows.sum()), np.log(out / out.sum(1, keepdims=True))


def memberships(docs: DataFrame, id_col: str, text: str, source: str, targets: dict[str, tuple[float, int]], path: str = TOKENIZER) -> tuple[DataFrame, list[str]]:
    """(id, source, tokens, cap, p array<double>) and the order of domains; documents of a source without a target have cap 0."""
    domains = [*sorted(targets), OTHER]
    prior, words = fit_domains(docs, id_col, text, source, domains)
    at = {d: i for i, d in enumerate(domains)}
    caps = np.array([float(targets[d][1]) if d in targets else 0.0 for d in domains])
    sent = docs.sparkSession.sparkContext.broadcast((prior, words))
    wrong = math.log(LABEL_NOISE / max(1, len(domains) - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoder(path, PATTERN)
        pr, wd = sent.value
        for b in batches:
            rows = []
            for i, s, t in zip(b["id"], b["source"], b["t"], strict=True):
                f = _features(t)
                score = pr + (wd[:, f].sum(1) * (EFFECTIVE_WORDS / max(EFFECTIVE_WORDS, len(f))) if len(f) else 0.0)
                if isinstance(s, str):
                    label = np.full(len(domains), wrong)
                    label[at.get(s, at[OTHER])] = math.log(1 - LABEL_NOISE)
                    score = score + label
                p = np.exp(score - score.max())
                p /= p.sum()
                cap = caps[at.get(s, at[OTHER])] if isinstance(s, str) else caps[int(p.argmax())]
                rows.append((i, s if isinstance(s, str) else None, len(e.encode_ordinary(t)) if isinstance(t, str) and t else 0, float(cap), p.tolist()))
            yield pd.DataFrame(rows, columns=["id", "source", "tokens", "cap", "p"])

    lean = spread(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("t")))
    return materialize(lean.mapInPandas(run, "id bigint, source string, tokens bigint, cap double, p array<double>"), "memberships"), domains


def _rates(p: np.ndarray, cap: np.ndarray, start: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    r = np.minimum(p @ start, cap)
    for e in history:
        r = np.clip(r - p @ e, 0.0, cap)
    return r


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(history of errors, starting rates, total): what a document's rate is computed from. One distributed sum a step; only
    a vector of as many numbers as domains reaches the driver. total: tokens of the mixture, by default the most that the
    caps allow."""
    m = len(domains)

    def sums(start: np.ndarray | None, history: list[np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = np.zeros((3, m))
            for b in batches:
                if not len(b):
                    continue
                p, t, cap = np.array(b["p"].tolist()), b["tokens"].to_numpy(float)[:, None], b["cap"].to_numpy(float)
                got[0] += (p * t * (cap[:, None] > 0)).sum(0)
                own = p * (p == p.max(1, keepdims=True))  # what a domain's own documents can give; others run at other rates
                got[1] += (own * t * cap[:, None]).sum(0)
                if start is not None:
                    got[2] += (p * t * _rates(p, cap, start, history)[:, None]).sum(0)
            yield pd.DataFrame({"k": range(3 * m), "v": got.ravel()})

        out = np.zeros(3 * m)
        for r in members.select("tokens", "cap", "p").mapInPandas(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out.reshape(3, m)

    have, most, _ = sums(None, [])
    share = np.array([targets[d][0] if d in targets else 0.0 for d in domains])
    share = share / (share.sum() or 1.0)
    if total is None:
        limits = [most[i] / share[i] for i in range(m) if share[i] > 0]
        total = 0.995 * min(limits) if limits else 0.0
    goal = share * total
    mass = np.maximum(have, 1.0)
    start, history, worst = goal / mass, [], []
    for _ in range(STEPS):
        s = sums(start, history)[2]
        worst.append(float(np.abs((s - goal)[share > 0]).max(initial=0.0)))
        if worst[-1] <= TOLERANCE * max(total, 1.0) or len(worst) > 5 and worst[-1] > 0.98 * worst[-4]:
            break  # on target, or as near as the caps allow
        history.append(np.where(share > 0, (s - goal) / mass, 0.0))
    return history, start, total


def rates(members: DataFrame, domains: list[str], targets: dict[str, tuple[float, int]], total: float | None = None) -> DataFrame:
    """(id, source, tokens, rate, copies). copies is the rate rounded down, or up where a hash of the id lies below the
    fraction; one histogram of tokens by source and distance to the fraction shifts that limit so that the sources' totals
    come out right as whole copies (at most CELLS rows a source reach the driver)."""
    history, start, total = fit_rates(members, domains, targets, total)

    @F.pandas_udf(T.DoubleType())
    def rate(p: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.array(p.tolist()), cap.to_numpy(float), start, history)) if len(p) else pd.Series([], dtype=float)

    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = materialize(
        members.withColumn("rate", rate("p", "cap")).select("id", "source", "tokens", "cap", "rate").withColumn("cell", F.floor((u - (F.col("rate") - F.floor("rate")) + 1) * (CELLS // 2))), "rates",
    )
    room = F.col("cap") >= F.floor("rate") + 1
    cells = rated.groupBy("source", "cell").agg(F.sum(F.col("tokens") * F.floor("rate")).alias("base"), F.sum(F.when(room, F.col("tokens")).otherwise(0)).alias("more")).collect()
    whole = sum(share for share, _ in targets.values()) or 1.0
    limit = None
    for name, (share, _) in sorted(targets.items()):
        own = sorted((r.cell, r.more) for r in cells if r.source == name)
        lack = share / whole * total - sum(r.base for r in cells if r.source == name)
        at = 0
        for cell, more in own:
            if lack < more / 2:
                break
            lack -= more
            at = cell + 1
        limit = F.when(F.col("source") == name, at) if limit is None else limit.when(F.col("source") == name, at)
    limit = F.coalesce(limit, F.lit(CELLS // 2)) if limit is not None else F.lit(CELLS // 2)
    copies = F.floor("rate") + F.when(room & (F.col("cell") < limit), 1).otherwise(0)
    return rated.select("id", "source", "tokens", "rate", copies.cast("bigint").alias("copies"))


def shares(rated: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: what there is, what the mixture takes, its actual share and the most repeats of a document."""
    by = rated.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_repeats"),
    )
    total = by.agg(F.sum("mixed_tokens").alias("total"))
    return (
        by.join(F.broadcast(total)).join(targets.select("source", "target_share", "max_repeats"), "source", "left")
        .select("source", "documents", "tokens", "target_share", "max_repeats", "mixed_tokens", "most_repeats", F.try_divide("mixed_tokens", "total").alias("actual_share"))
    )
