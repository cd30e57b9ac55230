"""Queries of sections E, G, H, J, R, T, U, V and W."""

from __future__ import annotations

from pyspark.sql import functions as F

from kordel.common import norm_key, scratch, strip_ws, table
from kordel.functions import predicates as P
from kordel.functions import program as A
from kordel.functions.text import category, sanitize, word_count, words
from kordel.operators import aggregates as H
from kordel.operators import expand as E
from kordel.operators import order as O
from kordel.operators import registry as D
from kordel.operators import validate as V
from kordel.plans import sqltext as S
from kordel.plans.catalog import query
from kordel.sources import readers, sinks

_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S.key('text')} ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1)"


@query(f"SELECT coalesce(lang, '?') AS lang, count(*) AS kept, sum(({S.digit_spam('text')})::INT) AS digit_spam, sum((len({S.words('text')}) > 20)::INT) AS long FROM {_FIRST} GROUP BY 1")
def flagship_clean_by_language(s, d):
    """Documents: key, first of each key, quality reasons, counts by language: one scan, two shuffles."""
    first = O.first_wins(table(s, d, "documents").where("text is not null").select("doc_id", "lang", "text"), [norm_key(F.col("text"))], ["doc_id"], unique=True)
    t = F.col("text")
    return first.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count(F.lit(1)).alias("kept"), F.sum(P.digit_spam(t).cast("int")).alias("digit_spam"), F.sum(P.too_long(t).cast("int")).alias("long"))


@query(f"SELECT canon_id FROM (SELECT canon_id, row_number() OVER (PARTITION BY intent, {S.key('input')} ORDER BY canon_id) AS rn FROM canonical) WHERE rn = 1")
def g1_first_wins(s, d):
    return O.first_ids(table(s, d, "canonical"), [F.col("intent"), norm_key(F.col("input"))], "canon_id")


@query("SELECT canon_id FROM (SELECT canon_id, row_number() OVER (PARTITION BY input || '|' || intent ORDER BY canon_id) AS rn FROM canonical WHERE input IS NOT NULL AND intent IS NOT NULL) WHERE rn = 1")
def g2_first_wins_exact(s, d):
    rows = table(s, d, "canonical").where("input is not null and intent is not null")
    return O.first_ids(rows, [F.concat_ws("|", "input", "intent")], "canon_id")


@query(f"SELECT canon_id, row_number() OVER (PARTITION BY {S.key('input')} ORDER BY canon_id) > 1 AS is_later FROM canonical WHERE input IS NOT NULL")
def g3_label_later(s, d):
    rows = table(s, d, "canonical").where("input is not null").select("canon_id", "input")
    return O.label_later(rows, norm_key(F.col("input")), ["canon_id"], F.lit(True)).select("canon_id", "is_later")


@query(f"SELECT canon_id, intent <> first_value(intent) OVER (PARTITION BY {S.key('input')} ORDER BY canon_id) AS is_conflict FROM canonical WHERE input IS NOT NULL AND intent IS NOT NULL")
def g4_conflicts(s, d):
    rows = table(s, d, "canonical").where("input is not null and intent is not null").select("canon_id", "input", "intent")
    return O.conflicts(rows, [norm_key(F.col("input"))], "intent", ["canon_id"]).select("canon_id", "is_conflict")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def g6_first_k(s, d):
    return O.first_k(table(s, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 3)


@query(f"WITH r AS (SELECT doc_id, sum(({S.digit_spam('text')} IS NOT TRUE)::INT) OVER (ORDER BY doc_id) - ({S.digit_spam('text')} IS NOT TRUE)::INT AS before, row_number() OVER (ORDER BY doc_id) AS tried FROM documents) SELECT doc_id FROM r WHERE before < 500 AND tried <= 100000")
def g5_g7_stop_at_n(s, d):
    rows = table(s, d, "documents").select("doc_id", P.digit_spam(F.col("text")).alias("spam"))
    return O.stop_at(rows, ~F.coalesce("spam", F.lit(False)), "doc_id", O.target_count(500)).select("doc_id")


_TOKENS = f"(SELECT unnest({S.words('intent')}) AS token FROM canonical)"


@query(f"SELECT token, count(*) AS count FROM {_TOKENS} GROUP BY token")
def h1_token_counts(s, d):
    return H.token_counts(table(s, d, "canonical"), "intent")


@query(f"SELECT (SELECT count(*) FROM canonical) AS total_rows, count(*) AS total_tokens, count(DISTINCT token) AS unique_tokens FROM {_TOKENS}")
def h1_token_totals(s, d):
    return H.token_totals(table(s, d, "canonical"), "intent")


@query(f"SELECT token, count(*) AS count, round(count(*) / (SELECT count(*) FROM {_TOKENS}), 9) AS share FROM {_TOKENS} GROUP BY token HAVING count(*) > 0.01 * (SELECT count(*) FROM {_TOKENS})")
def h2_token_bias(s, d):
    return H.token_bias(table(s, d, "canonical"), "intent", 0.01).withColumn("share", F.round("share", 9))


@query(f"WITH t AS (SELECT canon_id, {S.words('intent')} AS w FROM canonical), u AS (SELECT canon_id, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM t) SELECT token, count(*) AS count FROM u GROUP BY token ORDER BY count(*) DESC, min(canon_id * 100000 + p) LIMIT 20")
def t1_top_tokens(s, d):
    return H.top_tokens(table(s, d, "canonical"), "intent", "canon_id", 20)


@query("SELECT intent AS value, count(*) AS count FROM canonical GROUP BY 1")
def h5_intent_distribution(s, d):
    return H.distribution(table(s, d, "canonical"), F.col("intent"))


@query("SELECT split_part(split_part(intent, ' ', 2), '.', 1) AS value, count(*) AS count FROM families GROUP BY 1")
def h6_t2_t3_categories(s, d):
    return H.distribution(table(s, d, "families"), category(F.col("intent"))).orderBy(F.desc("count"), "value")


@query("SELECT count(*) AS rows, count(DISTINCT intent) AS distinct_keys, round(count(*)::DOUBLE / count(DISTINCT intent), 9) AS fan_out FROM families")
def h7_fan_out(s, d):
    return H.fan_out(table(s, d, "families"), "intent").withColumn("fan_out", F.round("fan_out", 9))


_LEN = f"(SELECT length(text) AS a, len({S.words('text')}) AS b FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT count(*) AS n, round(avg(a), 6) AS avg_a, round(stddev_pop(a), 6) AS dev_a, sum(a) AS sum_a, round(avg(b), 6) AS avg_b, round(stddev_pop(b), 6) AS dev_b, round(avg(a) / avg(b), 6) AS ratio FROM {_LEN}")
def h8_length_statistics(s, d):
    out = H.length_statistics(table(s, d, "documents").where("text is not null"), F.length("text"), word_count(F.col("text")))
    return out.select("n", "sum_a", *[F.round(c, 6).alias(c) for c in ("avg_a", "dev_a", "avg_b", "dev_b", "ratio")])


@query(f"WITH l AS (SELECT len({S.words('input')}) AS n FROM canonical), k AS (SELECT unnest(range(1, 12)) AS k) SELECT CASE WHEN k < 11 THEN k::VARCHAR ELSE '11+' END AS ops, (SELECT count(*) FROM l WHERE n = k OR k = 11 AND n >= 11) AS count FROM k")
def h9_length_histogram(s, d):
    return H.length_histogram(table(s, d, "canonical"), word_count(F.col("input")))


@query()
def h9_program_lengths(s, d):
    p = table(s, d, "canonical").select(A.parse(sanitize(F.col("intent"))).alias("p")).where("p.error is null")
    return H.length_histogram(p, F.size("p.ops"))


@query(f"SELECT intent, count(DISTINCT {S.key('input')}) AS inputs FROM canonical GROUP BY intent HAVING count(DISTINCT {S.key('input')}) < 2")
def h10_poor_intents(s, d):
    return H.poor_intents(table(s, d, "canonical"), "intent", norm_key(F.col("input")))


_STATUS = f"(SELECT lang, CASE WHEN text IS NULL THEN 'skipped' WHEN {S.strip('text')} = '' OR {S.marker('text')} THEN 'rejected' ELSE 'translated' END AS status FROM {S.LONG})"


@query(f"SELECT lang, count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'rejected') AS rejected FROM {_STATUS} GROUP BY lang")
def h11_translation_status(s, d):
    long = table(s, d, "multilingual_intents").select(F.explode("inputs").alias("lang", "text"))
    st = long.withColumn("status", F.when(F.col("text").isNull(), "skipped").when((strip_ws(F.col("text")) == "") | P.has_marker(F.col("text")), "rejected").otherwise("translated"))
    return H.status_by(st, "lang", "status", ["translated", "skipped", "rejected"])


@query()
def h13_reason_histogram(s, d):
    x = table(s, d, "distill").withColumn("p", A.parse(F.col("output")))
    return H.reason_histogram(x, P.output_reasons(F.col("output"), F.col("output"), F.col("p.error").isNull()))


@query("SELECT family, count(*) AS count FROM families GROUP BY ROLLUP (family)")
def h14_rollup(s, d):
    return H.rollup_by(table(s, d, "families"), "family")


@query(f"SELECT DISTINCT unnest({S.words('text')}) AS id FROM documents")
def h15_u2_distinct_ids(s, d):
    return H.distinct_ids(table(s, d, "documents"), words(F.col("text")))


@query("SELECT round(coalesce(sum(value), 0) / greatest(1, count(*)), 6) AS average FROM events")
def h16_safe_average(s, d):
    return H.safe_average(table(s, d, "events"), "value").select(F.round("average", 6).alias("average"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS valid, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def h17_run_summary(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("valid"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"SELECT lang AS field, count(*) AS count FROM {S.LONG} WHERE {S.marker('text')} GROUP BY lang")
def h18_marker_sweep(s, d):
    return H.marker_sweep(table(s, d, "multilingual_intents"), F.col("inputs"), P.has_marker)


@query(f"""WITH v AS (SELECT DISTINCT unnest({S.words('text')}) AS token FROM documents), n AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM v),
u AS (SELECT DISTINCT unnest({S.words('input')}) AS token FROM canonical),
c AS (SELECT n.id, n.token, CASE WHEN n.token IN (SELECT token FROM u) THEN 0 WHEN length(n.token) <= 3 AND regexp_matches(n.token, '^[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}\\p{{S}} ]*$') THEN 1 ELSE 2 END AS class FROM n),
k AS (SELECT *, row_number() OVER (ORDER BY class, id) AS place FROM c)
SELECT id, token, row_number() OVER (ORDER BY id) - 1 AS new_id FROM k WHERE class = 0 OR place <= 3000""")
def t5_u4_u5_j7_vocabulary(s, d):
    vocab = O.numbered(H.distinct_ids(table(s, d, "documents"), words(F.col("text"))).withColumnRenamed("id", "token"), "token", "id")
    used = vocab.join(H.distinct_ids(table(s, d, "canonical"), words(F.col("input"))).withColumnRenamed("id", "token"), "token", "left_semi").select("id")
    return H.vocabulary_top_up(vocab, used, 3000).select("id", "token", "new_id")


@query()
def e1_e2_j8_variations(s, d):
    return E.variations(table(s, d, "canonical"), "input", ["canon_id"])


@query()
def e3_canonical_build(s, d):
    v = V.parsed(table(s, d, "canonical").where("input is not null").select("canon_id", "intent", "input"), "intent").where("canonical is not null")
    return O.first_wins(v.select("canon_id", "canonical", "input"), [F.col("canonical"), norm_key(F.col("input"))], ["canon_id"])


_DICT = "(SELECT min(text) AS text, phrase, lang FROM (SELECT english AS phrase, lang, text FROM " + S.LONG + " WHERE english IS NOT NULL AND text IS NOT NULL AND lang <> 'english') GROUP BY phrase, lang)"


def _dictionary(s, d):
    long = table(s, d, "multilingual_intents").select(F.col("inputs")["english"].alias("phrase"), F.explode("inputs").alias("lang", "text")).where("phrase is not null and text is not null and lang != 'english'")
    return long.groupBy("phrase", "lang").agg(F.min("text").alias("text"))


@query(f"WITH d AS (SELECT {S.key('phrase')} AS p, lang, min(text) AS text FROM {_DICT} GROUP BY 1, 2) SELECT c.canon_id, l.lang, d.text AS translation FROM canonical c CROSS JOIN (VALUES ('greek'), ('thai')) AS l(lang) LEFT JOIN d ON d.p = {S.key('c.input')} AND d.lang = l.lang")
def j1_translate(s, d):
    dic = _dictionary(s, d).groupBy(norm_key(F.col("phrase")).alias("phrase"), "lang").agg(F.min("text").alias("text"))
    rows = table(s, d, "canonical").select("canon_id", "input", F.explode(F.array(F.lit("greek"), F.lit("thai"))).alias("lang"))
    return E.translate(rows, "input", dic).select("canon_id", "lang", "translation")


@query()
def e5_wide_translations(s, d):
    dic = _dictionary(s, d).groupBy(norm_key(F.col("phrase")).alias("phrase"), "lang").agg(F.min("text").alias("text"))
    wide = E.wide_translations(table(s, d, "canonical").where("input is not null"), "canon_id", "input", dic)
    return wide.select("canon_id", F.array_join(F.array_sort(F.map_keys("inputs")), ",").alias("languages"))


@query(f"SELECT ml_id, lang AS language, text AS input, coalesce(m.f, 'english') AS family FROM {S.LONG} LEFT JOIN {S.FAMILY_VALUES} AS m(l, f) ON lang = m.l WHERE text IS NOT NULL AND text <> ''")
def e6_u1_long_rows(s, d):
    return E.long_rows(table(s, d, "multilingual_intents"), "inputs", ["ml_id"])


@query("SELECT a.n_regionkey AS g, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def e8_j9_ordered_pairs(s, d):
    return E.ordered_pairs(table(s, d, "nation"), "n_nationkey", "n_name", "n_regionkey")


@query("SELECT event_id, printf('%02d:00', (hour(ts) % 12) + CASE WHEN hour(ts) >= 12 THEN 12 ELSE 0 END) AS clock FROM events")
def e8_clock(s, d):
    h = F.hour("ts")
    return table(s, d, "events").select("event_id", E.clock24(F.when(h % 12 == 0, 12).otherwise(h % 12), h >= 12).alias("clock"))


@query()
def e9_sample_by_hash(s, d):
    return E.sample_by_hash(table(s, d, "canonical").select("canon_id", "intent"), "canon_id", 1000, 7)


@query()
def e11_e12_mock_programs(s, d):
    return E.generate(table(s, d, "canonical").select("canon_id", "input"), "input", "program").select("canon_id", "program")


@query("""WITH t AS (SELECT canon_id, list_transform(string_split(coalesce(input, ''), ' '), lambda w: length(w)::INT) AS a, list_transform(string_split(coalesce(intent, ''), ' '), lambda w: length(w)::INT) AS b FROM canonical),
e AS (SELECT canon_id, len(list_concat(list_concat(a, b), [0])[1:8]) AS n, list_concat(list_concat(a, b), [0])[1:8] AS ids, list_concat(list_concat(list_transform(a, lambda x: -100), b), [0])[1:8] AS labels FROM t)
SELECT canon_id, array_to_string(list_resize(ids, 8, -1), ',') AS input_ids, array_to_string(list_resize(list_transform(ids, lambda x: 1), 8, 0), ',') AS attention_mask, array_to_string(list_resize(labels, 8, -100), ',') AS labels FROM e""")
def e13_encode_pair(s, d):
    ids = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w))
    e = table(s, d, "canonical").select("canon_id", E.encode_pair(ids(F.col("input")), ids(F.col("intent")), 0, -1, 8).alias("e"))
    return e.select("canon_id", *[F.array_join(F.transform(f"e.{n}", lambda x: x.cast("string")), ",").alias(n) for n in ("input_ids", "attention_mask", "labels")])


@query(f"SELECT l, f FROM {S.FAMILY_VALUES} AS m(l, f) WHERE f IN (SELECT DISTINCT family FROM families)")
def j5_languages_of_families(s, d):
    have = table(s, d, "families").select("family").distinct()
    return D.families_table(s).join(have, "family").select(F.col("language").alias("l"), F.col("family").alias("f"))


@query(f"SELECT min(fam_id) AS fam_id FROM families f WHERE input IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical c WHERE c.input IS NOT NULL AND {S.key('c.input')} = {S.key('f.input')}) GROUP BY {S.key('input')}")
def w3_j6_only_new(s, d):
    new = table(s, d, "families").where("input is not null").select("fam_id", "input")
    return sinks.only_new(new, table(s, d, "canonical").where("input is not null").select("input"), norm_key(F.col("input")), ["fam_id"]).select("fam_id")


@query("SELECT canon_id FROM canonical WHERE input IS NOT NULL AND intent IS NOT NULL")
def r1_w1_jsonl_round_trip(s, d):
    at = scratch(s, "jsonl")
    sinks.write_jsonl(table(s, d, "canonical").where("input is not null and intent is not null").select("canon_id", "intent", "input"), at)
    return readers.jsonl(s, at, "canon_id bigint, intent string, input string", bad="skip").select("canon_id")


@query("SELECT family, count(*) AS n FROM families WHERE family IN ('english','cjk','arabic','indic','cyrillic','greek','hebrew','southeast_asian','ethiopic') GROUP BY family")
def w2_by_family(s, d):
    at = scratch(s, "families")
    sinks.write_by_family(table(s, d, "families").where(F.col("family").isin(D.FAMILIES)).select("fam_id", "intent", "input", "family"), at)
    return s.read.schema("fam_id bigint, intent string, input string, family string").json(at).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query()
def r2_r3_valid_rows(s, d):
    rows = table(s, d, "families").select("fam_id", F.coalesce("input", F.lit("")).alias("input"), readers.first_filled("intent").alias("intent")).where("intent is not null")
    return V.valid_rows(rows, "intent").select("fam_id", "input", F.col("canonical").alias("program"))


@query()
def r4_training_rows(s, d):
    return readers.training_rows(table(s, d, "distill"))


@query()
def r6_family_records(s, d):
    return V.family_records(table(s, d, "families"), "fam_id").select("fam_id", "input", "intent", F.to_json("params").alias("params"))


@query()
def r7_wide_records(s, d):
    return V.wide_records(table(s, d, "multilingual_intents"), "ml_id").select("ml_id", "language", "family", "input", "intent")


@query()
def v1_canonical_findings(s, d):
    return V.canonical_findings(table(s, d, "canonical"), "canon_id")


@query()
def v2_variation_findings(s, d):
    rows = E.variations(table(s, d, "canonical"), "input", ["canon_id", "intent"]).withColumnRenamed("variation", "input")
    return V.variation_findings(rows, "canon_id")


@query()
def v3_multilingual_findings(s, d):
    return V.multilingual_findings(table(s, d, "multilingual_intents"), "ml_id")


@query()
def v4_v5_family_findings(s, d):
    return V.family_findings(table(s, d, "families"), "fam_id")


@query(f"SELECT 'markers' AS \"check\", 'error' AS severity, ml_id AS id, 'text: ' || regexp_extract(text, '(【[^\\n]*?】|\\[[A-Z]{{2,4}}\\]|^【|】$)', 1) AS message FROM {S.LONG} WHERE {S.marker('text')}")
def v6_marker_findings(s, d):
    return V.marker_findings(table(s, d, "multilingual_intents").select("ml_id", F.explode("inputs").alias("lang", "text")), "ml_id", ["text"])


@query()
def v7_h12_gate(s, d):
    return V.gate(V.canonical_findings(table(s, d, "canonical"), "canon_id").unionByName(V.family_findings(table(s, d, "families"), "fam_id")))


@query()
def t4_shown_findings(s, d):
    return V.shown(V.canonical_findings(table(s, d, "canonical"), "canon_id"))


@query("SELECT op, len(required) AS fields FROM op_registry")
def r10_r13_registry(s, d):
    return table(s, d, "op_registry").select("op", F.size("required").alias("fields")).orderBy("op")


@query(f"SELECT k AS alias, o AS op FROM {S.ALIAS_VALUES} AS a(k, o)")
def r10_aliases(s, d):
    return D.aliases_table(s)
