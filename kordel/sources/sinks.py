"""Sinks (W1-W9). A path that is read is never overwritten: the new data goes beside it and is swapped in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.operators.order import first_wins
from kordel.operators.registry import FAMILIES


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_jsonl(df: DataFrame, path: str) -> None:
    """W1, W9."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_family(df: DataFrame, path: str, family: str = "family") -> None:
    """A folder per family, those without rows included."""
    df.write.mode("overwrite").partitionBy(family).json(path)
    spark = df.sparkSession
    for f in FAMILIES:
        fs, p = _fs(spark, f"{path}/{family}={f}")
        fs.mkdirs(p)


def only_new(new: DataFrame, existing: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows of new whose key is not in existing, the first of each key."""
    return first_wins(new.withColumn("__k", key).join(existing.select(key.alias("__k")), "__k", "left_anti").drop("__k"), [key], order)


def append_new(new: DataFrame, path: str, key: Column, order: list[str]) -> None:
    """W3. The rows are settled before anything is written to the path they are compared with."""
    from kordel.common import materialize

    existing = new.sparkSession.read.schema(new.schema).json(path)
    materialize(only_new(new, existing, key, order), "append").write.mode("append").json(path)


def rebuild(df: DataFrame, path: str, key: Column, order: list[str]) -> None:
    """W4."""
    rewrite(first_wins(df, [key], order), path)


def rewrite(df: DataFrame, path: str) -> None:
    """Writes beside path, then swaps; df may have been read from path."""
    spark, beside, old = df.sparkSession, f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").json(beside)
    fs, p = _fs(spark, path)
    fs.delete(_fs(spark, old)[1], True)
    if fs.exists(p):
        fs.rename(p, _fs(spark, old)[1])
    fs.rename(_fs(spark, beside)[1], p)
    fs.delete(_fs(spark, old)[1], True)


def write_generation(judged: DataFrame, path: str, text: str, raw: str) -> None:
    """Accepted, rejected and statistics. The judged rows are settled once and read three times."""
    from kordel.common import materialize
    from kordel.operators.accept import reason_counts

    j = materialize(judged, "judged")
    write_jsonl(j.where("reason is null").select(F.col(text).alias("input"), "program"), f"{path}/accepted")
    write_jsonl(j.where("reason is not null").select(F.col(text).alias("input"), F.col(raw).alias("raw"), "reason"), f"{path}/rejected")
    write_jsonl(reason_counts(j).coalesce(1), f"{path}/stats")


def update_manifest(path: str, family: str, sha256: str, size_mb: float) -> None:
    """One small file on the driver."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)
    m["families"][family] |= {"sha256": sha256, "size_mb": round(size_mb, 1)}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(m, f, indent=2, ensure_ascii=False)
