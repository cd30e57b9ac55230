"""Aggregates over corpora (H1-H19) and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.functions.text import words
from kordel.operators.order import numbered


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """H1: (token, count)."""
    return df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def token_totals(df: DataFrame, text: str) -> DataFrame:
    """H1: rows, tokens in all, distinct tokens."""
    counts = token_counts(df, text).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens"))
    return counts.crossJoin(df.agg(F.count(F.lit(1)).alias("total_rows")))  # one row each


def token_bias(df: DataFrame, text: str, threshold: float = 0.05) -> DataFrame:
    """H2: tokens with more than `threshold` of all tokens. The total is one scalar, not an unpartitioned window."""
    counts = token_counts(df, text)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total).where(F.col("share") > threshold)


def top_tokens(df: DataFrame, text: str, order: str, k: int = 20) -> DataFrame:
    """The k most frequent tokens, ties by where they first occur."""
    at = df.select(order, F.posexplode(words(F.col(text))).alias("p", "token"))
    return at.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(order, "p")).alias("first")).orderBy(F.desc("count"), "first").limit(k).select("token", "count")


def op_frequency(df: DataFrame, ops: Column) -> DataFrame:
    """H3: (kind, name, count) of ops and argument keys, a key once per op that has it."""
    o = df.select(F.explode(ops).alias("o"))
    names = F.concat(F.array(F.struct(F.lit("op").alias("kind"), F.col("o.op").alias("name"))), F.transform(F.map_keys("o.args"), lambda k: F.struct(F.lit("arg").alias("kind"), k.alias("name"))))
    return o.select(F.explode(names).alias("n")).select("n.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("count"))


def distribution(df: DataFrame, by: Column, name: str = "value") -> DataFrame:
    """(value, count)."""
    return df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def fan_out(df: DataFrame, key: str) -> DataFrame:
    """H7: rows, distinct keys and rows per key."""
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys"))
    return a.withColumn("fan_out", F.try_divide(F.col("rows").cast("double"), "distinct_keys"))


def length_statistics(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """H8: mean, population deviation and sum of two lengths, and the ratio of the means (null if the second is 0)."""
    s = df.select(a.alias("a"), b.alias("b"))
    return s.agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("avg_a"), F.coalesce(F.stddev_pop("a"), F.lit(0.0)).alias("dev_a"), F.sum("a").alias("sum_a"),
        F.avg("b").alias("avg_b"), F.coalesce(F.stddev_pop("b"), F.lit(0.0)).alias("dev_b"), F.try_divide(F.avg("a"), F.avg("b")).alias("ratio"),
    )


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    """H9: one row for each of 1..10 and 11+, zeros included."""
    counts = [F.count_if(length == k).alias(f"n{k}") for k in range(1, 11)] + [F.count_if(length >= 11).alias("n11")]
    return df.agg(*counts).select(F.explode(F.array(*[F.struct(F.lit(f"{k}" if k < 11 else "11+").alias("ops"), F.col(f"n{k}").alias("count")) for k in range(1, 12)])).alias("s")).select("s.*")


def poor_intents(df: DataFrame, intent: str, text: Column, least: int = 2) -> DataFrame:
    """Intents with fewer than `least` different inputs."""
    return df.groupBy(intent).agg(F.countDistinct(text).alias("inputs")).where(F.col("inputs") < least)


def status_by(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """A row per key, a counter per status."""
    return df.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def reason_histogram(df: DataFrame, reasons: Column) -> DataFrame:
    """(reason, count) by what stands before the colon."""
    return df.select(F.explode(reasons).alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def rollup_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key and in all (key null)."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("count"))


def distinct_ids(df: DataFrame, ids: Column) -> DataFrame:
    """The union of all ids."""
    return df.select(F.explode(ids).alias("id")).distinct()


def safe_average(df: DataFrame, value: str) -> DataFrame:
    """The sum by the number of rows, at least 1."""
    return df.agg((F.coalesce(F.sum(value), F.lit(0)) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("average"))


def marker_sweep(df: DataFrame, leaves: Column, marker) -> DataFrame:
    """(field, count) of string leaves with a stand-in marker; leaves is a map of path to text."""
    return df.select(F.explode(leaves).alias("field", "text")).where(marker(F.col("text"))).groupBy("field").agg(F.count(F.lit(1)).alias("count"))


def vocabulary_top_up(vocab: DataFrame, used: DataFrame, target: int) -> DataFrame:
    """All used ids and, up to `target`, short printable tokens, then the lowest ids; new_id is dense by id. Used
    ids beyond the target stay, and nothing is added to them."""
    have = vocab.join(used, "id", "left_semi")
    rest = vocab.join(used, "id", "left_anti").withColumn("class", F.when((F.length("token") <= 3) & F.rlike("token", F.lit(r"^[\p{L}\p{M}\p{N}\p{P}\p{S} ]*\z")), 1).otherwise(2))
    first = rest.orderBy("class", "id").limit(target).withColumn("place", F.row_number().over(W.orderBy("class", "id")))
    added = first.where(F.col("place") <= F.lit(target) - have.agg(F.count(F.lit(1))).scalar()).drop("class", "place")
    return numbered(have.unionByName(added), "id", "new_id").withColumn("new_id", F.col("new_id") - 1)

