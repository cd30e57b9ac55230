"""Problem 1: how often every distinct value and term occurs, and in how many records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import LMN

RARE_AT_MOST = 2
COMMON_ABOVE = 0.01


def terms(text: Column) -> Column:
    """The longest runs of letters, marks and digits, lower-cased; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LMN}]+"), 0), F.lower)


def _per_record(values: Column, kind: str) -> Column:
    """array<struct<kind,val,occ>> of one record: its values sorted and run-length counted, O(n log n) inside the JVM."""
    def runs(sorted_values: Column) -> Column:
        n = F.size(sorted_values)
        starts = F.filter(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 1) | (F.element_at(sorted_values, i) != F.element_at(sorted_values, F.greatest(i - 1, F.lit(1)))),
        )
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n + 1))
        return F.zip_with(
            starts, F.slice(ends, 1, F.size(starts)),
            lambda a, b: F.struct(F.lit(kind).alias("kind"), F.element_at(sorted_values, a).alias("val"), (b - a).cast("bigint").alias("occ")),
        )

    empty = F.array().cast("array<struct<kind:string,val:string,occ:bigint>>")
    # a one-element transform keeps the sorted array bound to a lambda variable, so it is computed once
    return F.coalesce(F.flatten(F.transform(F.array(F.array_sort(values)), runs)), empty)


def frequencies(df: DataFrame, value_cols: dict[str, str], term_cols: dict[str, str]) -> DataFrame:
    """(kind, val, occurrences, records) of every distinct value and term of df.

    value_cols and term_cols map a kind to a column. Each record first counts its own terms; the hash
    aggregate then combines within its partition before the shuffle, so a value in a third of all rows
    sends one row per map task. Nulls are left out, empty text has no terms and counts as an empty value,
    an empty table gives no rows; other columns are never read.
    """
    pieces = [
        F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(k).alias("kind"), F.col(c).alias("val"), F.lit(1).cast("bigint").alias("occ"))))
        .otherwise(F.array().cast("array<struct<kind:string,val:string,occ:bigint>>"))
        for k, c in value_cols.items()
    ] + [_per_record(terms(F.col(c)), k) for k, c in term_cols.items()]
    return (
        df.select(F.explode(F.concat(*pieces)).alias("t"))
        .select("t.kind", "t.val", "t.occ")
        .groupBy("kind", "val")
        .agg(F.sum("occ").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    )


def mark(counts: DataFrame, total_rows: Column, rare_at_most: int = RARE_AT_MOST, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Adds mark: `rare`, else `common`, else null."""
    return counts.withColumn(
        "mark",
        F.when(F.col("occurrences") <= rare_at_most, "rare").when(F.col("records") > F.lit(common_above) * total_rows, "common"),
    )


def marked_frequencies(df: DataFrame, value_cols: dict[str, str], term_cols: dict[str, str], **bounds) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return mark(frequencies(df, value_cols, term_cols), total, **bounds)
