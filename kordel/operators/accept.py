"""Generate, accept or reject (F14, F15, F19, G3, G5, H3, H4) and batch inference around an injected model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kordel.functions import predicates as P
from kordel.functions import program as A
from kordel.functions import text as B
from kordel.functions.scripts import route
from kordel.operators import order as O
from kordel.operators.registry import literal_map

REASONS = ["format", "multi_line", "no_dot", "parse_error", "invalid", "too_long", "duplicate"]


def judge(df: DataFrame, raw: str, order: list[str], dedup: bool = True) -> DataFrame:
    """adds program and reason (null where accepted), the first failing check in the order of REASONS. Only rows that
    pass all other checks claim a hash; later rows with it are duplicates."""
    line = df.withColumn("__line", B.strict_line(F.col(raw))).withColumn("__early", B.strict_reason(F.col(raw)))
    p = line.withColumn("__p", A.parse(F.col("__line"))).withColumn("program", A.canonicalize(F.col("__p")))
    ast = A.first_occurrences(A.resolve_ops(F.col("__p")["ops"]))
    reason = (
        F.when(F.col("__early").isNotNull(), F.col("__early")).when(F.col("program").isNull(), "parse_error")
        .when(~A.is_valid_program(F.col("program")), "invalid").when(F.size(ast) > A.MAX_OPS, "too_long")
    )
    checked = p.withColumn("reason", reason).withColumn("hash", F.when(F.col("program").isNotNull(), A.program_hash(ast)))
    if dedup:
        checked = O.label_later(checked, F.col("hash"), order, F.col("reason").isNull(), settle=True).withColumn("reason", F.when(F.col("is_later"), "duplicate").otherwise(F.col("reason"))).drop("is_later")
    return checked.drop("__line", "__early", "__p")


def clean_teacher_output(df: DataFrame, raw: str, into: str = "clean") -> DataFrame:
    """Adds the teacher's line; null where it repeats characters or words, is too long or all digits, or is no program."""
    line = df.withColumn(into, B.teacher_line(F.col(raw)))
    s = F.col(into)
    bad = P.repeated_chars(s) | P.repeated_tokens(s) | P.too_long(s) | P.pure_digits(s) | A.parse(s)["error"].isNotNull()
    return line.withColumn(into, F.when(~bad, s))


def accepted(judged: DataFrame) -> DataFrame:
    """F15."""
    return judged.where("reason is null")


def reason_counts(judged: DataFrame) -> DataFrame:
    """H4: (reason, count), `accepted` for none."""
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def infer(df: DataFrame, text: str, templates: dict[str, str], model: Callable[[str, list[str]], list[str]]) -> DataFrame:
    """Routed batch inference: rows of a family together, prompts built, an injected model called per family and batch,
    output extracted, canonicalised and marked VALID or INVALID."""
    fmt = F.coalesce(literal_map(templates)[F.col("family")], F.lit("{input}")) if templates else F.lit("{input}")
    # a salt beside the family keeps a family with most rows from being one task
    routed = df.withColumn("family", route(F.col(text))).withColumn("prompt", B.build_prompt(fmt, F.col(text)))
    routed = routed.repartition(F.col("family"), F.pmod(F.xxhash64(text), F.lit(32))).sortWithinPartitions("family")

    @F.pandas_udf("string")
    def call(family: pd.Series, prompt: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompt), dtype=object)
        for name, at in prompt.groupby(family).groups.items():
            out.loc[at] = model(name, prompt.loc[at].tolist())
        return out

    done = routed.withColumn("raw", call("family", "prompt")).withColumn("extracted", B.extract_program(F.col("raw")))
    parsed = done.withColumn("__p", A.parse(F.col("extracted"))).withColumn("program", A.canonicalize(F.col("__p")))
    return parsed.withColumn("status", F.when(F.col("program").isNotNull(), "VALID").otherwise("INVALID")).drop("__p", "prompt")
