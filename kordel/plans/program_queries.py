"""Queries of section A, the look-ups and the accept/reject cascade, over the programs of canonical and distill."""

from __future__ import annotations

from pyspark.sql import functions as F

from kordel.common import table
from kordel.functions import predicates as P
from kordel.functions import program as A
from kordel.functions.text import sanitize, valid_json
from kordel.operators import accept as R
from kordel.operators import registry as D
from kordel.operators import validate as V
from kordel.plans import sqltext as S
from kordel.plans.catalog import query


def _programs(s, d):
    return table(s, d, "canonical").select("canon_id", "intent").withColumn("p", A.parse(sanitize(F.col("intent"))))


@query()
def a1_split_chain(s, d):
    return table(s, d, "canonical").select("canon_id", F.array_join(A.split_segments(F.col("intent")), "\x01").alias("segments"))


@query()
def a2_a5_parse(s, d):
    return _programs(s, d).select("canon_id", F.size("p.ops").alias("ops"), F.col("p.error").alias("error"))


@query()
def a6_valid(s, d):
    return _programs(s, d).groupBy(F.col("p.error").isNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT canon_id, '"' || replace(replace(input, '\\', '\\\\'), '"', '\\"') || '"' AS quoted FROM canonical""")
def a7_quote(s, d):
    return table(s, d, "canonical").select("canon_id", A.quote(F.col("input")).alias("quoted"))


@query()
def a8_serialize(s, d):
    return _programs(s, d).where("p.error is null").select("canon_id", A.serialize(F.col("p.ops")).alias("program"))


@query()
def a9_a10_canonicalize(s, d):
    return _programs(s, d).select("canon_id", A.canonicalize(F.col("p")).alias("program"))


_OP = r"regexp_extract(intent, '^\s*\.\s*([^\s:;=\"]+)', 1)"


@query(f"SELECT canon_id, op, CASE WHEN contains(op, '.') THEN op ELSE a.o END AS resolved FROM (SELECT canon_id, {_OP} AS op FROM canonical WHERE intent IS NOT NULL) LEFT JOIN {S.ALIAS_VALUES} AS a(k, o) ON NOT contains(op, '.') AND lower(op) = a.k")
def a11_j2_resolve_op(s, d):
    op = F.regexp_extract("intent", r'^\s*\.\s*([^\s:;="]+)', 1)
    return table(s, d, "canonical").where("intent is not null").select("canon_id", op.alias("op")).withColumn("resolved", D.resolve_op(F.col("op")))


_BODY = f"CASE WHEN starts_with({S.strip('intent')}, '. ') THEN substr({S.strip('intent')}, 3) WHEN starts_with({S.strip('intent')}, '.') THEN regexp_replace(substr({S.strip('intent')}, 2), '^[{S.WS}]+', '') ELSE {S.strip('intent')} END"


@query(f"""WITH b AS (SELECT canon_id, {_BODY} AS body FROM canonical WHERE intent IS NOT NULL),
p AS (SELECT canon_id, {S.strip("regexp_extract(body, '(?s)^([^ ]*)', 1)")} AS op, regexp_extract_all(regexp_extract(body, '(?s)^[^ ]* (.*)$', 1), ':[\\p{{L}}\\p{{N}}_]+=(?:"[^"]*"|\\S*)') AS found FROM b),
e AS (SELECT canon_id, op, unnest(found) AS a, generate_subscripts(found, 1) AS i FROM p),
k AS (SELECT canon_id, regexp_extract(a, '^:([^=]+)=', 1) AS key, arg_max(regexp_replace(regexp_extract(a, '(?s)^:[^=]+=(.*)$', 1), '(?s)^"(.*)"$', '\\1'), i) AS value FROM e GROUP BY 1, 2)
SELECT p.canon_id, p.op, coalesce(string_agg(k.key || '=' || k.value, ',' ORDER BY k.key), '') AS params FROM p LEFT JOIN k ON p.canon_id = k.canon_id GROUP BY 1, 2""")
def a12_loose_parse(s, d):
    p = table(s, d, "canonical").where("intent is not null").select("canon_id", A.loose_parse(F.col("intent")).alias("p"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("p.params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return p.select("canon_id", F.col("p.intent").alias("op"), pairs.alias("params"))


@query()
def a13_fingerprint(s, d):
    return _programs(s, d).where("p.error is null").select("canon_id", A.fingerprint(F.col("p.ops")).alias("fingerprint"))


@query("SELECT canon_id, sha256(replace(input, ' ', '|')) AS digest FROM canonical WHERE input IS NOT NULL")
def a14_sha256(s, d):
    one = F.array(F.struct(F.replace("input", F.lit(" "), F.lit("|")).alias("op"), F.create_map().cast("map<string,string>").alias("args")))
    return table(s, d, "canonical").where("input is not null").select("canon_id", A.program_hash(one).alias("digest"))


@query()
def a14_program_hash(s, d):
    return _programs(s, d).where("p.error is null").groupBy(A.program_hash(F.col("p.ops")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query()
def a15_a16_atoms(s, d):
    return table(s, d, "canonical").select("canon_id", A.join_atoms(F.col("intent")).alias("atoms"))


@query(f"""WITH w AS (SELECT canon_id, intent, {S.words('intent')} AS w FROM canonical WHERE intent IS NOT NULL)
SELECT canon_id, CASE WHEN starts_with(intent, '.') AND len(w) > 0 AND a.o IS NOT NULL THEN '.' || a.o || CASE WHEN len(w) > 1 THEN ' ' || array_to_string(w[2:], ' ') ELSE '' END ELSE intent END AS fixed
FROM w LEFT JOIN {S.ALIAS_VALUES} AS a(k, o) ON substr(w[1], 2) = a.k""")
def a17_legacy_alias_fix(s, d):
    return table(s, d, "canonical").where("intent is not null").select("canon_id", A.legacy_alias_fix(F.col("intent")).alias("fixed"))


@query()
def a18_all_namespaced(s, d):
    return _programs(s, d).where("p.error is null").select("canon_id", A.all_namespaced(F.col("p.ops")).alias("namespaced"))


@query()
def a19_intent_verdict(s, d):
    v = V.parsed(table(s, d, "canonical"), "intent")
    return v.groupBy(A.intent_verdict(F.col("intent"), F.col("parsed"), F.col("canonical")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_PARAMS = "CASE WHEN json_valid(output) AND json_type(output, '$.params') = 'OBJECT' THEN json_keys(output, '$.params') ELSE []::VARCHAR[] END"


@query(f"SELECT distill_id, o.op AS op, array_to_string(list_filter(o.req, lambda f: NOT list_contains(keys, f)), ',') AS missing FROM (SELECT distill_id, json_extract_string(output, '$.intent') AS op, {_PARAMS} AS keys FROM distill WHERE json_valid(output)) r JOIN {S.OPS_VALUES} AS o(op, req) ON r.op = o.op")
def a20_j3_missing_fields(s, d):
    r = table(s, d, "distill").where(valid_json(F.col("output"))).select("distill_id", F.get_json_object("output", "$.intent").alias("op"), F.coalesce(F.json_object_keys(F.get_json_object("output", "$.params")), F.array().cast("array<string>")).alias("keys"))
    m = D.missing_fields(r.where(F.col("op").isin(list(D.OPS))), "op", F.col("keys"))
    return m.select("distill_id", "op", F.array_join("missing", ",").alias("missing"))


@query("SELECT distill_id, r.op AS op, array_to_string(list_filter(o.required, lambda f: NOT list_contains(keys, f)), ',') AS missing FROM (SELECT distill_id, json_extract_string(output, '$.intent') AS op, " + _PARAMS + " AS keys FROM distill WHERE json_valid(output)) r JOIN op_registry o ON r.op = o.op")
def j3_missing_by_registry(s, d):
    reg = table(s, d, "op_registry")
    r = table(s, d, "distill").where(valid_json(F.col("output"))).select("distill_id", F.get_json_object("output", "$.intent").alias("op"), F.coalesce(F.json_object_keys(F.get_json_object("output", "$.params")), F.array().cast("array<string>")).alias("keys"))
    m = D.missing_fields(r.join(reg.select("op"), "op", "left_semi"), "op", F.col("keys"), reg)
    return m.select("distill_id", "op", F.array_join("missing", ",").alias("missing"))


@query(f"""SELECT canon_id, array_to_string(list_sort(list_distinct(list_filter({S.words('intent')}, lambda w: NOT contains(w, '.') AND NOT starts_with(w, ':') AND w NOT IN (';', '->')))), ' ') AS bare FROM canonical WHERE intent IS NOT NULL""")
def a21_bare_words(s, d):
    return table(s, d, "canonical").where("intent is not null").select("canon_id", F.array_join(F.array_sort(A.bare_words(F.col("intent"))), " ").alias("bare"))


@query()
def f9_f10_v8_convert(s, d):
    rows = V.family_records(table(s, d, "families").where("input is not null and intent is not null"), "fam_id")
    return V.convert_family(rows, "fam_id").select("fam_id", "input", "intent", F.to_json("params").alias("params"))


@query(r"""WITH p AS (SELECT distill_id, input, json_keys(output, '$.params') AS ks, output FROM distill WHERE input IS NOT NULL AND json_valid(output) AND json_type(output, '$.params') = 'OBJECT'),
v AS (SELECT distill_id, input, list_transform(ks, lambda k: json_extract_string(output, '$.params."' || k || '"')) AS vs FROM p)
SELECT distill_id, len(list_filter(vs, lambda x: NOT contains(input, x))) = 0 AS holds FROM v""")
def f10_spans_hold(s, d):
    p = table(s, d, "distill").where(valid_json(F.col("output"))).select("distill_id", "input", F.from_json(F.get_json_object("output", "$.params"), "map<string,string>").alias("params"))
    return p.where("input is not null and params is not null").select("distill_id", P.spans_hold(F.col("params"), F.col("input")).alias("holds"))


def _judged(s, d):
    return R.judge(table(s, d, "distill").select("distill_id", "input", "output"), "output", ["distill_id"])


@query()
def f13_output_reasons(s, d):
    x = table(s, d, "distill").withColumn("p", A.parse(F.col("output")))
    return x.select("distill_id", F.array_join(P.output_reasons(F.col("output"), F.col("output"), F.col("p.error").isNull()), ",").alias("reasons"))


@query()
def f14_g3_accept_or_reject(s, d):
    return _judged(s, d).select("distill_id", "program", "reason")


@query()
def f15_f19_accepted(s, d):
    return R.accepted(_judged(s, d)).select("distill_id", "input", "program")


@query()
def h4_reason_counts(s, d):
    return R.reason_counts(_judged(s, d))


@query()
def h3_op_frequency(s, d):
    from kordel.operators.aggregates import op_frequency

    return op_frequency(_programs(s, d).where("p.error is null"), F.col("p.ops"))


@query()
def h19_fixed_and_rejected(s, d):
    return _programs(s, d).agg(F.sum(A.fixed_ops(F.col("p"))).alias("fixed"), F.sum(A.rejected_ops(F.col("p"))).alias("rejected"))


@query()
def g5_stop_at(s, d):
    from kordel.operators.order import stop_at, target_count

    j = _judged(s, d)
    return stop_at(j, F.col("reason").isNull(), "distill_id", target_count(500)).select("distill_id", "reason")


@query()
def model_batch_inference(s, d):
    from kordel.plans.stubs import echo_model

    out = R.infer(table(s, d, "families").where("input is not null").select("fam_id", "input"), "input", {"english": "EN {input}"}, echo_model)
    return out.groupBy("family", "status").agg(F.count(F.lit(1)).alias("n"))
