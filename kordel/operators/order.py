"""Order-dependent operators (G1-G7): first wins, later ones labelled, conflicts, stop at n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import materialize


def digest(keys: list[Column]) -> Column:
    """32 bytes that agree exactly where all keys do; null agrees with null only."""
    parts = [x for k in keys for x in (F.when(k.isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.length(k.cast("string")), F.lit(0)).cast("string"), F.lit(":"), F.coalesce(k.cast("string"), F.lit("")))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def first_ids(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The smallest `order` of each key, one column: a hash aggregate over fixed-width digests, combined before the shuffle.
    Null keys are equal to each other; an empty table gives none."""
    return df.select(digest(keys).alias("__k"), F.col(order)).groupBy("__k").agg(F.min(order).alias(order)).select(order)


def first_wins(df: DataFrame, keys: list[Column], order: list[str], unique: bool = False) -> DataFrame:
    """The first row of each key. unique: the one order column identifies a row; then only digests are aggregated and
    whole rows move once, by the join back. Otherwise an aggregate of whole rows, which settles ties to one row. Either
    combines before the shuffle, so a key with a third of all rows sends one row per task. Null keys are equal to each other."""
    if unique and len(order) == 1:
        return df.join(first_ids(df, keys, order[0]), order[0], "left_semi")
    names = [f"__k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def label_later(df: DataFrame, key: Column, order: list[str], taking_part: Column, into: str = "is_later", settle: bool = False) -> DataFrame:
    """True for rows whose key an earlier row that takes part already had; rows that take no part claim nothing.
    The first of each key is found by a combining aggregate and joined back, so no window holds a whole hot key. settle: df
    is written first, for where it is dear to make, as it is read twice."""
    keyed = df.withColumn("__k", F.when(F.coalesce(taking_part, F.lit(False)) & key.isNotNull(), digest([key]))).withColumn("__o", F.col(order[0]) if len(order) == 1 else F.struct(*order))
    keyed = materialize(keyed, "keyed") if settle else keyed
    firsts = keyed.where("__k is not null").groupBy("__k").agg(F.min("__o").alias("__first"))
    return keyed.join(firsts, "__k", "left").withColumn(into, F.coalesce(F.col("__o") > F.col("__first"), F.lit(False))).select(*df.columns, into)


def conflicts(df: DataFrame, keys: list[Column], value: str, order: list[str], into: str = "is_conflict", settle: bool = False) -> DataFrame:
    """Rows whose value differs from the first value seen for the key. Only digests of key and value are aggregated. A null
    first value or a null value is no conflict. settle: as for label_later."""
    keyed = df.withColumn("__k", digest(keys)).withColumn("__v", F.unhex(F.sha2(F.col(value), 256)))
    keyed = materialize(keyed, "keyed") if settle else keyed
    firsts = keyed.groupBy("__k").agg(F.min_by("__v", F.struct(*order)).alias("__first"))
    return keyed.join(firsts, "__k", "left").withColumn(into, F.coalesce(F.col("__v") != F.col("__first"), F.lit(False))).select(*df.columns, into)


def prefix_count(df: DataFrame, flag: Column, order: str, into: str = "running") -> DataFrame:
    """Running count of flag by order, in two passes: counts by range partition, then offsets added; no single task sees
    all rows. Rows of equal order are counted in any order."""
    return _prefix_counts(df, {into: flag}, order)


def _prefix_counts(df: DataFrame, flags: dict[str, Column], order: str) -> DataFrame:
    marks = [f"__f{i}" for i in range(len(flags))]
    ranged = df.withColumns({m: F.coalesce(f, F.lit(False)).cast("bigint") for m, f in zip(marks, flags.values(), strict=True)})
    ranged = materialize(ranged.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "ranged")
    w = W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = ranged.groupBy("__p").agg(*[F.sum(m).alias(f"{m}n") for m in marks])
    # one row a partition of the range exchange
    before = sums.alias("a").join(sums.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(*[F.coalesce(F.sum(f"b.{m}n"), F.lit(0)).alias(f"{m}b") for m in marks])
    out = ranged.join(F.broadcast(before), "__p")
    return out.withColumns({name: F.sum(m).over(w) + F.col(f"{m}b") for name, m in zip(flags, marks, strict=True)}).drop("__p", *marks, *[f"{m}b" for m in marks])


def numbered(df: DataFrame, order: str, into: str) -> DataFrame:
    """Dense numbers from 1 by order, without a window over all rows."""
    return prefix_count(df, F.lit(True), order, into)


def attempt_limit(n: int) -> int:
    """How many candidates are tried at most for n accepted ones."""
    return max(n * 200, n + 5000)


def target_count(n: int, least: int = 100, most: int = 1000) -> int:
    """The number of samples asked for, held within the generator's bounds."""
    return max(least, min(n, most))


def stop_at(df: DataFrame, accepted: Column, order: str, n: int, attempts: int | None = None) -> DataFrame:
    """Rows in order up to and with the n-th accepted one, and no more of them than `attempts` (by default
    attempt_limit(n)). The attempts are counted, whatever the values of the order column."""
    most = attempt_limit(n) if attempts is None else attempts
    counted = _prefix_counts(df.withColumn("__a", F.coalesce(accepted, F.lit(False))), {"__accepted": F.col("__a"), "__tried": F.lit(True)}, order)
    return counted.where((F.col("__accepted") - F.col("__a").cast("bigint") < n) & (F.col("__tried") <= most)).drop("__accepted", "__tried", "__a")


def first_k(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each group before the shuffle."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
