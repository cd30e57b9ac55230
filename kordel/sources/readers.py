"""Readers (R1-R13): JSON lines with line numbers and bad lines, many files, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kordel.common import strip_ws
from kordel.operators.registry import DEFAULT_FAMILY

CORRUPT = "_corrupt"
DEFAULT_PROMPT = "<START>\nINPUT: {input}\nOUTPUT: "
MANIFEST = "version string, default_family string, families map<string, struct<gguf:string,adapter:string,base_model:string,scripts:array<string>,version:string,prompt_format:string,sha256:string,size_mb:double>>"


def numbered_lines(spark: SparkSession, paths: str | list[str], columns: str) -> DataFrame:
    """(file, line, raw, columns..., error): exact line numbers, blank lines skipped but counted, a bad line kept with
    its text. Files are read whole, as a line number needs; for corpora of big files use jsonl."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("p", "raw")).where(strip_ws(F.col("raw")) != "")
    j = lines.select("file", (F.col("p") + 1).alias("line"), "raw", F.from_json("raw", f"{columns}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j"))
    return j.select("file", "line", "raw", "j.*").withColumn("error", F.when(F.col(CORRUPT).isNotNull(), "json")).drop(CORRUPT)


def jsonl(spark: SparkSession, paths: str | list[str], columns: str, bad: str = "keep", recursive: bool = False) -> DataFrame:
    """A splittable scan of files, lists, globs or folders. bad: `keep` (column _corrupt), `skip` or `raise`."""
    r = spark.read.option("recursiveFileLookup", recursive)
    if recursive:
        r = r.option("pathGlobFilter", "*.jsonl")
    if bad == "raise":
        return r.option("mode", "FAILFAST").schema(columns).json(paths)
    df = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(f"{columns}, {CORRUPT} string").json(paths)
    return df if bad == "keep" else df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def first_filled(*columns: str):
    """Aliases of a field: the first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


@F.udf(T.StringType(), useArrow=True)
def _model_output(output):
    try:
        out = json.loads(output) if output else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(out, dict) or "intent" not in out or "params" not in out:
        return None
    return json.dumps({"intent": out["intent"], "params": out["params"]}, ensure_ascii=False)


def training_rows(df: DataFrame) -> DataFrame:
    """(input, output) of rows with both, output being the JSON text of intent and params as they stand, without other
    keys; others are to be counted by skipped()."""
    return df.where("input != ''").select("input", _model_output("output").alias("output")).where("output is not null")


def skipped(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("input") != "", F.lit(False)).alias("ok"), _model_output("output").alias("o")).agg(F.count_if(~F.col("ok") | F.col("o").isNull()).alias("skipped"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(family, config..., is_default), with defaults filled in; an error where structure or a required field
    is missing."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))
    checked = raw.select(F.when(F.col("m.families").isNull(), F.raise_error(F.lit("invalid manifest structure"))).otherwise(F.col("m.families")).alias("families"), F.coalesce(F.nullif(F.col("m.default_family"), F.lit("")), F.lit(DEFAULT_FAMILY)).alias("default"))
    c = checked.select("default", F.explode("families").alias("family", "c"))
    required = lambda f: F.when(F.coalesce(F.col(f"c.{f}"), F.lit("")) == "", F.raise_error(F.concat(F.lit(f"missing {f}: "), "family"))).otherwise(F.col(f"c.{f}"))
    filled = lambda f, d: F.coalesce(F.nullif(F.col(f"c.{f}"), F.lit("")), F.lit(d)).alias(f)
    return c.select(
        "family", *[required(f).alias(f) for f in ("gguf", "adapter", "base_model")], F.coalesce("c.scripts", F.array().cast("array<string>")).alias("scripts"),
        filled("version", "1.0"), filled("prompt_format", DEFAULT_PROMPT), filled("sha256", ""), F.coalesce("c.size_mb", F.lit(0.0)).alias("size_mb"), (F.col("family") == F.col("default")).alias("is_default"),
    )


def file_integrity(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, size_mb) of binary files, for files small enough for one row each."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size_mb"))
