"""Row-local operators on streams: the same expressions over a streaming table, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kordel.functions import program as A
from kordel.functions import scripts as C
from kordel.functions.text import sanitize


def routed(stream: DataFrame, text: str) -> DataFrame:
    return stream.withColumn("family", C.route(F.col(text)))


def canonicalized(stream: DataFrame, intent: str) -> DataFrame:
    return stream.withColumn("program", A.canonicalize(A.parse(sanitize(F.col(intent)))))


def family_counts(stream: DataFrame, text: str, time: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows by family and tumbling window; rows later than the watermark are dropped by Spark."""
    return routed(stream, text).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "family").agg(F.count(F.lit(1)).alias("n")).select("w.start", "family", "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """One row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
