"""Queries of the ten problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kordel.common import scratch, table
from kordel.llm import copies, defects, frequency, language, leaks, lookalike, mixing, residue, sentences, splits


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_frequencies(table(spark, d, "canonical"), {"intent": "intent"}, {"term": "input"})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).where("mark is not null").select("kind", "val", "mark")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    groups, _ = copies.representatives(table(spark, d, "canonical"), "canon_id", "input", "intent")
    return groups.select("keep_id", "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.representatives(table(spark, d, "canonical"), "canon_id", "input", "intent")[1]


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return residue.entries(table(spark, d, "canonical"), table(spark, d, "multilingual_intents"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every entry that is stored otherwise."""
    e = residue.split_residue(_entries(spark, d), "text").where("not is_residue")
    return lookalike.same_form(e, "text", "form", lookalike.member_frequency(_entries(spark, d), "text")).where("form != text").select("src", "lang", "id", "text", "form")


def _same_looks(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    commands = lambda rows: residue.split_residue(rows, "text", e, "text").where("not is_residue")
    return lookalike.same_look_rows(e, lookalike.member_frequency(e, "text"), keep=commands)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every entry whose look others have in different characters, with its class and the number of those others."""
    return lookalike.same_look_classes(_same_looks(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(_same_looks(spark, d))


def _language_model(spark: SparkSession, d: str) -> language.Model:
    return language.fit(table(spark, d, "families"), "input", "language", ["fam_id"])


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of families and canonical with its language and confidence."""
    families = table(spark, d, "families").select(F.lit("families").alias("src"), F.col("fam_id").alias("rec_id"), "input")
    canonical = table(spark, d, "canonical").select(F.lit("canonical").alias("src"), F.col("canon_id").alias("rec_id"), "input")
    rows = language.identify(families.unionByName(canonical), "input", _language_model(spark, d))
    return rows.select("src", "rec_id", F.posexplode("segments").alias("segment", "s")).select("src", "rec_id", "segment", "s.lang", "s.confidence", "s.start")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    model = _language_model(spark, d)
    a = language.label_cases(table(spark, d, "families"), model).select(F.lit("families").alias("src"), "rec_id", "lang")
    canonical = table(spark, d, "canonical").select("canon_id", "input")
    b = residue.split_residue(language.foreign_cases(canonical, model), "input", canonical.where("input is not null"), "input")
    return a.unionByName(b.where("not is_residue").select(F.lit("canonical").alias("src"), "rec_id", "lang"))


def _split_store(spark: SparkSession, d: str) -> splits.SplitStore:
    """All of canonical taken into an empty store in two batches, as it would come in: rows that reached us within a day of
    their making first, late rows and those of unknown age then."""
    shares = {r.split_name: r.target_share for r in table(spark, d, "split_shares").collect()}
    store, rows = splits.SplitStore(spark, scratch(spark, "splits")), table(spark, d, "canonical")
    early = F.coalesce(F.col("loaded_at") <= F.col("created_at") + F.expr("interval 1 day"), F.lit(False))
    for batch in (rows.where(early), rows.where(~early)):
        store.update(batch, "canon_id", ["intent", "input"], table(spark, d, "entities"), shares)
    return store


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its component and split; quarantine where a later batch has tied two splits together."""
    return _split_store(spark, d).members().withColumnRenamed("id", "canon_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_store(spark, d).members().where(~F.startswith("component", F.lit("\x01")))  # not alone
    least = rows.groupBy("component").agg(F.min("id").alias("group_id"))
    return rows.join(least, "component").where("id != group_id").select("group_id", F.col("id").alias("canon_id"))


def p7_flags(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their texts. Inputs of problem 6 have no defect."""
    registry = frozenset(r.op.lower() for r in table(spark, d, "op_registry").select("op").collect())
    pairs = defects.pairs_of(table(spark, d, "canonical"), table(spark, d, "distill"))
    flagged = defects.flag(pairs, registry, _language_model(spark, d), defects.fit_contexts(pairs, registry)).where("defect is not null")
    return residue.split_residue(flagged, "text", pairs, "text").where("not is_residue").drop("is_residue")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_flags(spark, d).select("src", "rec_id", "defect")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return residue.residue_scores(e, "text", e, "text").select("src", "lang", "id", "text", "coverage")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.split_residue(_entries(spark, d), "text").where("is_residue").select("src", F.col("id").alias("rec_id"), "lang")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of 40 letters of an item, with at most one edit."""
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("distance = 0").select("doc_id", "item_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its tokens, its rate in the mixture and its whole copies."""
    targets = {r.source: (r.target_share, r.max_repeats) for r in table(spark, d, "mix_targets").collect()}
    members, domains = mixing.memberships(table(spark, d, "documents"), "doc_id", "text", "source", targets)
    return mixing.rates(members, domains, targets).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(p9_rates(spark, d), table(spark, d, "mix_targets"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_offsets(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("start").alias("sent_start"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_counts, p1_found, p2_groups, p2_found, p3_forms, p3_classes, p3_found, p4_segments, p4_found, p5_splits, p5_found, p6_scores, p6_found, p7_flags, p7_found, p8_leaks, p8_found, p9_rates, p9_shares, p10_sentences, p10_found)
}
