"""Dataset validators (V1-V8): one table of findings; a row yields its first error only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import norm_key
from kordel.functions import predicates as P
from kordel.functions import program as A
from kordel.functions.text import sanitize
from kordel.operators import order as O
from kordel.operators.registry import WIDE_LANGUAGES, family_of

FINDING = ["check", "severity", "id", "message"]


def parsed(df: DataFrame, intent: str) -> DataFrame:
    """df with columns parsed and canonical: the program is parsed once and the struct reused."""
    return df.withColumn("parsed", A.parse(sanitize(F.col(intent)))).withColumn("canonical", A.canonicalize(F.col("parsed")))


def valid_rows(df: DataFrame, intent: str) -> DataFrame:
    """Df with column canonical, for rows whose program can be read and resolved and whose canonical form can be read again."""
    return parsed(df, intent).drop("parsed").where("canonical is not null").where(A.parse(F.col("canonical"))["error"].isNull())


def _verdict(intent: str, text: str | None, fields: list[str]) -> Column:
    missing = [F.when(F.col(f).isNull(), F.lit(f"missing_{f}")) for f in fields]
    marker = F.when(P.has_marker(F.col(text)), "fake_marker") if text else F.lit(None).cast("string")
    v = A.intent_verdict(F.col(intent), F.col("parsed"), F.col("canonical"))
    return F.coalesce(*missing, marker, F.when(v != "ok", v))


def _errors(df: DataFrame, check: str, key: str, column: str = "verdict") -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.lit(check).alias("check"), F.lit("error").alias("severity"), F.col(key).alias("id"), F.col(column).alias("message"))


def canonical_findings(df: DataFrame, key: str) -> DataFrame:
    """V1: field, marker and intent errors; a warning per intent with a single input among valid rows (id null)."""
    v = parsed(df, "intent").withColumn("verdict", _verdict("intent", "input", ["intent", "input"]))
    poor = v.where("verdict is null").groupBy("intent").agg(F.countDistinct(norm_key(F.col("input"))).alias("n")).where("n < 2")
    warn = poor.select(F.lit("canonical").alias("check"), F.lit("warning").alias("severity"), F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("single_input: "), "intent").alias("message"))
    return _errors(v, "canonical", key).unionByName(warn)


def variation_findings(df: DataFrame, key: str) -> DataFrame:
    """V2."""
    return _errors(parsed(df, "intent").withColumn("verdict", _verdict("intent", "input", ["intent", "input", "base_input"])), "variations", key)


def multilingual_findings(df: DataFrame, key: str) -> DataFrame:
    """V3: row errors, then per language marker, sameness with English, and a warning for lost numbers."""
    v = parsed(df, "intent").withColumn("verdict", F.coalesce(F.when(F.col("intent").isNull(), F.lit("missing_intent")), F.when(F.col("inputs").isNull(), F.lit("missing_inputs")), _verdict("intent", None, [])))
    english = F.col("inputs")["english"]
    each = v.where("verdict is null").select(key, english.alias("english"), F.explode("inputs").alias("lang", "text")).where("text is not null")
    each = each.withColumn("bad", F.when(P.has_marker(F.col("text")), "fake_marker").when(F.col("english").isNotNull() & ~P.is_diverse(F.col("text"), F.col("lang"), F.col("english")), "same_as_english"))
    bad = each.where("bad is not null").select(F.lit("multilingual").alias("check"), F.lit("error").alias("severity"), F.col(key).alias("id"), F.concat_ws(": ", "bad", "lang").alias("message"))
    lost = each.where(F.col("bad").isNull() & F.col("english").isNotNull() & P.numbers_lost(F.col("text"), F.col("english")))
    warn = lost.select(F.lit("multilingual").alias("check"), F.lit("warning").alias("severity"), F.col(key).alias("id"), F.concat(F.lit("numbers_lost: "), "lang").alias("message"))
    none = v.where("verdict is null and size(inputs) = 0").select(F.lit("multilingual").alias("check"), F.lit("warning").alias("severity"), F.col(key).alias("id"), F.lit("no_inputs").alias("message"))
    return _errors(v, "multilingual", key).unionByName(bad).unionByName(warn).unionByName(none)


def family_findings(df: DataFrame, key: str) -> DataFrame:
    """V4, V5: all families in one scan; conflicts of intent for one input within a family, among rows that pass."""
    v = parsed(df, "intent").withColumn("verdict", _verdict("intent", "input", ["intent", "input", "language", "family"]))
    c = O.conflicts(v.where("verdict is null").select(key, "family", "input", "intent"), [F.col("family"), norm_key(F.col("input"))], "intent", [key])
    clash = c.where("is_conflict").select(F.lit("family").alias("check"), F.lit("error").alias("severity"), F.col(key).alias("id"), F.lit("conflict").alias("message"))
    return _errors(v, "family", key).unionByName(clash)


def marker_findings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """V6: every text field with a stand-in marker; reports only."""
    leaves = df.select(F.col(key).alias("id"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "text"))
    return leaves.where(P.has_marker(F.col("text"))).select(F.lit("markers").alias("check"), F.lit("error").alias("severity"), "id", F.concat_ws(": ", "field", P.marker(F.col("text"))).alias("message"))


def summary(findings: DataFrame) -> DataFrame:
    """(check, severity, count)."""
    return findings.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("count"))


def gate(findings: DataFrame) -> DataFrame:
    """V7: one row; exit_code is 1 if there is any error."""
    n = F.count_if(F.col("severity") == "error")
    return findings.agg(n.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.when(n > 0, 1).otherwise(0).alias("exit_code"))


def shown(findings: DataFrame, errors: int = 20, warnings: int = 10) -> DataFrame:
    """T4: the first errors and warnings of a report, in order."""
    pick = lambda s, n: findings.where(F.col("severity") == s).orderBy("check", "id", "message").limit(n)
    return pick("error", errors).unionByName(pick("warning", warnings))


def family_records(df: DataFrame, key: str) -> DataFrame:
    """Trimmed input, loosely parsed intent and params; records without either left out."""
    p = df.select(key, F.regexp_replace("input", r"^\s+|\s+$", "").alias("input"), A.loose_parse(F.col("intent")).alias("p"))
    return p.select(key, "input", "p.intent", "p.params").where("input != '' and intent != ''")


def wide_records(df: DataFrame, key: str) -> DataFrame:
    """Wide translations as records of the families of their languages, English left out."""
    long = df.select(key, "intent", F.explode("inputs").alias("language", "input")).where(F.col("language").isin(list(WIDE_LANGUAGES)))
    p = long.select(key, "language", family_of(F.col("language")).alias("family"), F.regexp_replace("input", r"^\s+|\s+$", "").alias("input"), A.loose_parse(F.col("intent")).alias("p"))
    return p.select(key, "language", "family", "input", "p.intent", "p.params").where("input != '' and intent != ''")


def convert_family(records: DataFrame, key: str) -> DataFrame:
    """V8: first of each (input, intent), then repaired spans; rows with a value that is not in the input are dropped."""
    unique = O.first_wins(records, [F.concat_ws("|", "input", "intent")], [key])
    fixed = unique.withColumn("params", P.repair_spans(F.col("params"), F.col("input"))).where("params is not null")
    return fixed.where(P.spans_hold(F.col("params"), F.col("input")))
