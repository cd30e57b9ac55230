"""Expansion of rows (E1-E13) and look-ups."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import norm_key
from kordel.functions.predicates import translation_verdict
from kordel.operators.registry import WIDE_LANGUAGES, family_of

#: Rules are a list that people write; more than this many are refused rather than broadcast.
MOST_RULES = 10_000
# Our own rephrasing rules: a pattern over the input in lower case, and templates with {1}, {2} for its groups.
RULES: list[tuple[str, list[str]]] = [
    (r"^call (.+)$", ["ring {1}", "phone {1} please", "get {1} on the line"]),
    (r"^transfer ([0-9.]+) to (.+)$", ["send {2} {1}", "move {1} over to {2}"]),
    (r"^pay (\S+) ([0-9.]+) dollars$", ["give {1} {2} dollars", "send {2} dollars to {1}"]),
    (r"^wake (\S+) at ([0-9:]+)$", ["alarm for {1} at {2}", "get {1} up at {2}"]),
    (r"^play something by (.+)$", ["put {1} on", "play {1}"]),
]


def variations(df: DataFrame, text: str, keep: list[str], rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(keep..., variation, base_input): the input itself and every template of every matching rule, first
    occurrence of each (case and outer whitespace aside), templates equal to the input left out. The rules are a bounded
    list folded into one expression per rule, so the input is scanned once and never joined with itself."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are sent to the executors")
    base = F.col(text)
    low = norm_key(base)

    def fill(pattern: str, template: str) -> Column:
        out = F.lit(template)
        for i in range(1, 10):
            if f"{{{i}}}" in template:
                out = F.replace(out, F.lit(f"{{{i}}}"), F.regexp_extract(low, pattern, i))
        return out

    made = F.flatten(F.array(*[F.when(F.rlike(low, F.lit(p)), F.array(*[fill(p, t) for t in ts])).otherwise(F.array().cast("array<string>")) for p, ts in rules]))
    every = F.concat(F.array(base), F.filter(made, lambda v: norm_key(v) != low))
    first = F.filter(every, lambda v, i: ~F.exists(F.slice(every, 1, i), lambda u: norm_key(u) == norm_key(v)))
    return df.where(base.isNotNull()).select(*keep, F.explode(first).alias("variation"), base.alias("base_input"))


def translate(df: DataFrame, text: str, dictionary: DataFrame, language: str = "lang") -> DataFrame:
    """Left look-up of (phrase, lang) -> text; phrases compare in lower case, trimmed. Spark chooses the join by size."""
    d = dictionary.select(norm_key(F.col("phrase")).alias("__p"), F.col("lang").alias("__l"), F.col("text").alias("translation"))
    return df.join(d, (norm_key(F.col(text)) == F.col("__p")) & (F.col(language) == F.col("__l")), "left").drop("__p", "__l")


def wide_translations(df: DataFrame, key: str, text: str, dictionary: DataFrame, strict: bool = False) -> DataFrame:
    """(key, inputs map): English and every valid translation; strict drops rows that lack a language."""
    langs = [*WIDE_LANGUAGES]
    rows = translate(df.withColumn("lang", F.explode(F.array(*map(F.lit, langs)))), text, dictionary)
    good = rows.withColumn("ok", translation_verdict(F.col("translation"), F.col("lang"), F.col(text)).isNull())
    wide = good.groupBy(key, text).agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("lang", "translation")))).alias("pairs"))
    out = wide.select(key, F.map_concat(F.create_map(F.lit("english"), F.col(text)), F.map_from_entries("pairs")).alias("inputs"))
    return out.where(F.size("inputs") == len(langs) + 1) if strict else out


def long_rows(df: DataFrame, inputs: str, keep: list[str]) -> DataFrame:
    """A row per language with its family; null and empty texts left out."""
    return df.select(*keep, F.explode(inputs).alias("language", "input")).where("input is not null and input != ''").withColumn("family", family_of(F.col("language")))


def ordered_pairs(df: DataFrame, key: str, name: str, group: str) -> DataFrame:
    """(a, b) with a before b, within a group, by an equi-join on the group; for groups of bounded size."""
    a, b = df.select(F.col(group).alias("g"), F.col(key).alias("ka"), F.col(name).alias("a")), df.select(F.col(group).alias("g"), F.col(key).alias("kb"), F.col(name).alias("b"))
    return a.join(b, "g").where("ka < kb").select("g", "a", "b")


def clock24(hour12: Column, pm: Column) -> Column:
    """A 12-hour clock as HH:00."""
    return F.format_string("%02d:00", (hour12 % 12 + F.when(pm, 12).otherwise(0)).cast("int"))


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows drawn without replacement by a seeded hash; the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def vary(phrases: list[str], n: int, seed: int) -> list[str]:
    """N phrases drawn from templates, on the driver."""
    r = random.Random(seed)
    return [r.choice(phrases) for _ in range(n)]


def mock_program(text: Column) -> Column:
    """A rule-based stand-in for a model: our own ordered rules, `unmapped_intent` if none matches."""
    s = norm_key(F.regexp_replace(text, r"\s+", " "))
    return (
        F.when(F.rlike(s, F.lit(r"\b(?:what|tell|get|give|show)\b.*\b(?:time|clock)\b")), ". time.now")
        .when(F.rlike(s, F.lit(r"\b(?:save|store|remember|note)\b.*\b(?:note|text|memo) (\w+)")), F.concat(F.lit('. memory.store :text="'), F.regexp_extract(s, r"\b(?:note|text|memo) (\w+)", 1), F.lit('"')))
        .when(F.rlike(s, F.lit(r"^(?:call|ring|phone) (\w+)")), F.concat(F.lit('. call.start :to="'), F.regexp_extract(s, r"^(?:call|ring|phone) (\w+)", 1), F.lit('"')))
        .when(F.rlike(s, F.lit(r"\bread\b.*\bmemory\b")), ". memory.read")
        .otherwise("unmapped_intent")
    )


def generate(df: DataFrame, text: str, into: str, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """The output of an injected model, a batch at a time; the mock without one."""
    if model is None:
        return df.withColumn(into, mock_program(F.col(text)))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model(s.tolist()), dtype=object)

    return df.withColumn(into, run(F.col(text)))


def encode_pair(prompt_ids: Column, label_ids: Column, eos: int, pad: int, length: int = 256) -> Column:
    """struct(input_ids, attention_mask, labels), each of `length`: prompt and label cut, padded; prompt masked."""
    ids = F.slice(F.concat(prompt_ids, label_ids, F.array(F.lit(eos))), 1, length)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), label_ids, F.array(F.lit(eos))), 1, length)
    n = F.lit(length) - F.size(ids)
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(pad), n)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n)).alias("attention_mask"),
        F.concat(labels, F.array_repeat(F.lit(-100), n)).alias("labels"),
    )


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table in the code."""
    return spark.createDataFrame(rows, schema)
