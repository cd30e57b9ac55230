"""Queries of sections B, C and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from kordel.common import norm_key, table
from kordel.functions import predicates as P
from kordel.functions import scripts as C
from kordel.functions import text as B
from kordel.operators import accept as R
from kordel.operators.registry import family_of
from kordel.plans import sqltext as S
from kordel.plans.catalog import query

_CODE = "[\\x{{{}}}-\\x{{{}}}]"


def _scripts_sql(name: str) -> str:
    body = "".join("-".join(f"\\x{{{e}}}" for e in r.split("-")) for r in C.RANGES[name].split())
    return f"[{body}]"


_LONG_TEXT = f"SELECT ml_id, lang, text FROM {S.LONG} WHERE text IS NOT NULL"


def _long(s, d):
    return table(s, d, "multilingual_intents").select("ml_id", "base_input", F.col("inputs")["english"].alias("english"), F.explode("inputs").alias("lang", "text"))


@query(f"SELECT distill_id, {S.sanitize('output')} AS clean FROM distill")
def b1_sanitize(s, d):
    return table(s, d, "distill").select("distill_id", B.sanitize(F.col("output")).alias("clean"))


_LINES_SQL = f"list_filter(list_transform(string_split_regex({S.sanitize('coalesce(output, chr(32))')}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {S.strip('x')}), lambda x: x <> '')"
_REASON_SQL = f"CASE WHEN len({_LINES_SQL}) = 0 THEN 'format' WHEN len({_LINES_SQL}) > 1 THEN 'multi_line' WHEN NOT starts_with(({_LINES_SQL})[1], '.') THEN 'no_dot' END"


@query(f"SELECT distill_id, {_REASON_SQL} AS reason FROM distill")
def b2_strict_reason(s, d):
    return table(s, d, "distill").select("distill_id", B.strict_reason(F.col("output")).alias("reason"))


@query(f"SELECT distill_id, CASE WHEN {_REASON_SQL} IS NULL THEN ({_LINES_SQL})[1] END AS line FROM distill")
def b3_strict_line(s, d):
    return table(s, d, "distill").select("distill_id", B.strict_line(F.col("output")).alias("line"))


def _marks(x: str, marks: list[str], by: str) -> str:
    for m in marks:
        x = f"replace({x}, {S.q(m)}, {S.q(by)})"
    return x


_PRINTABLE = "regexp_replace({}, '\\pC|[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')"


@query(f"SELECT distill_id, {S.strip('regexp_extract(' + S.squeeze(S.sanitize(_PRINTABLE.format(_marks('output', ['<OUTPUT>', '<|endoftext|>', '</s>'], ' ')))) + ', $$(?s)(\\..*)$$, 1)')} AS program FROM distill")
def b4_extract_program(s, d):
    return table(s, d, "distill").select("distill_id", B.extract_program(F.col("output")).alias("program"))


@query()
def b5_extract_program_respaced(s, d):
    return table(s, d, "distill").select("distill_id", B.extract_program_respaced(F.col("output")).alias("program"))


@query("SELECT distill_id, coalesce(output, '') AS text FROM distill")
def b6_first_choice_text(s, d):
    x = table(s, d, "distill").withColumn("choices", F.when(F.col("output").isNotNull(), F.array(F.struct(F.col("output").alias("text")))).otherwise(F.array().cast("array<struct<text:string>>")))
    return x.select("distill_id", B.first_choice_text(F.col("choices")).alias("text"))


_CLEAN = S.squeeze("regexp_replace(string_split(" + _marks("output", ["<|endoftext|>", "</s>", "<END>", "<START>", "�"], "") + ", chr(10))[1], '[^\\x00-\\x7f]+$', '')")


@query(f"SELECT distill_id, CASE WHEN output = '' THEN output WHEN {_CLEAN} <> '' AND NOT starts_with({_CLEAN}, '.') THEN '. ' || {_CLEAN} ELSE {_CLEAN} END AS clean FROM distill")
def b7_clean_output(s, d):
    return table(s, d, "distill").select("distill_id", B.clean_output(F.col("output")).alias("clean"))


_T0 = S.strip(_marks("output", ["<|endoftext|>", "</s>", "<END>"], ""))
_T1 = f"CASE WHEN contains({_T0}, 'OUTPUT:') THEN {S.strip(f'substr({_T0}, instr({_T0}, $$OUTPUT:$$) + 7)')} ELSE {_T0} END"
_T2 = S.strip(f"string_split({_T1}, chr(10))[1]")


@query(f"SELECT distill_id, CASE WHEN t = '' THEN NULL WHEN starts_with(t, '.') THEN t ELSE '. ' || t END AS line FROM (SELECT distill_id, {_T2} AS t FROM distill)")
def b8_teacher_line(s, d):
    return table(s, d, "distill").select("distill_id", B.teacher_line(F.col("output")).alias("line"))


@query()
def b8_clean_teacher_output(s, d):
    return R.clean_teacher_output(table(s, d, "distill").select("distill_id", "output"), "output").select("distill_id", "clean")


@query("SELECT distill_id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS json FROM (SELECT distill_id, regexp_extract(output, '(?s)(\\{.*\\})', 1) AS j FROM distill)")
def b9_extract_json(s, d):
    return table(s, d, "distill").select("distill_id", B.extract_json(F.col("output")).alias("json"))


@query("SELECT canon_id, replace('<START>' || chr(10) || 'INPUT: {input}' || chr(10) || 'OUTPUT: ', '{input}', input) AS prompt FROM canonical")
def b10_build_prompt(s, d):
    return table(s, d, "canonical").select("canon_id", B.build_prompt(F.lit("<START>\nINPUT: {input}\nOUTPUT: "), F.col("input")).alias("prompt"))


@query(f"SELECT doc_id, len({S.words('text')}) AS n FROM documents")
def b11_word_count(s, d):
    return table(s, d, "documents").select("doc_id", B.word_count(F.col("text")).alias("n"))


@query(f"SELECT canon_id, {S.key('input')} AS key FROM canonical")
def b12_norm_key(s, d):
    return table(s, d, "canonical").select("canon_id", norm_key(F.col("input")).alias("key"))


@query(r"SELECT canon_id, array_to_string(list_sort(list_distinct(regexp_extract_all(input, '\p{Nd}+'))), ',') AS numbers FROM canonical WHERE input IS NOT NULL")
def b13_numbers(s, d):
    return table(s, d, "canonical").where("input is not null").select("canon_id", F.array_join(F.array_sort(B.numbers(F.col("input"))), ",").alias("numbers"))


@query()
def b14_params_json(s, d):
    return table(s, d, "multilingual_intents").where("inputs is not null").select("ml_id", B.params_json(F.col("inputs")).alias("params"))


@query("SELECT split_part(split_part(intent, ' ', 2), '.', 1) AS category, count(*) AS n FROM canonical GROUP BY 1")
def b15_category(s, d):
    return table(s, d, "canonical").groupBy(B.category(F.col("intent")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, left(text, 60) AS shown FROM documents")
def b16_prefix(s, d):
    return table(s, d, "documents").select("doc_id", B.prefix(F.col("text")).alias("shown"))


@query("SELECT ml_id, lang, " + S.count_in("text", "[\\x{41}-\\x{5A}]") + f" AS n FROM ({_LONG_TEXT})")
def c0_count_range(s, d):
    return _long(s, d).where("text is not null").select("ml_id", "lang", C.count_range(F.col("text"), 0x41, 0x5A).alias("n"))


@query("SELECT ml_id, lang, " + ", ".join(f"{S.count_in('text', _scripts_sql(n))} AS {n}" for n in C.RANGES) + f", {S.count_in('text', chr(92) + 'p{L}')} AS letters FROM ({_LONG_TEXT})")
def c1_c14_script_counts(s, d):
    t = F.col("text")
    return _long(s, d).where("text is not null").select("ml_id", "lang", *[C.count_script(t, n).alias(n) for n in C.RANGES], C.count_letters(t).alias("letters"))


def _group_sql(x: str) -> str:
    rows = [f"{{'m': -({' + '.join(S.count_in(x, _scripts_sql(n)) for n in names)}), 'i': {i}, 'name': '{g}', 'family': '{C.family_name(g)}'}}" for i, (g, names) in enumerate(C.GROUPS.items())]
    return f"list_sort([{', '.join(rows)}])"


_DIST = f"(SELECT *, {_group_sql('text')} AS dist, {S.count_in('text', chr(92) + 'p{L}')} AS letters FROM ({_LONG_TEXT}))"
_ROUTE = "coalesce(list_filter(dist, lambda r: r.m < 0 AND -r.m >= CASE WHEN r.family = 'english' THEN 0.5 ELSE 0.3 END * letters)[1].family, 'english')"
_ROUTED = f"CASE WHEN {S.strip('text')} = '' OR letters = 0 THEN 'english' ELSE {_ROUTE} END"


@query(f"SELECT ml_id, lang, array_to_string(list_transform(dist, lambda r: r.name || '=' || (-r.m)::VARCHAR), ',') AS distribution FROM {_DIST}")
def c15_distribution(s, d):
    j = F.array_join(F.transform(C.distribution(F.col("text")), lambda r: F.concat(r["name"], F.lit("="), r["count"].cast("string"))), ",")
    return _long(s, d).where("text is not null").select("ml_id", "lang", j.alias("distribution"))


@query(f"SELECT ml_id, lang, {_ROUTED} AS family FROM {_DIST}")
def c16_route(s, d):
    return _long(s, d).where("text is not null").select("ml_id", "lang", C.route(F.col("text")).alias("family"))


@query(f"SELECT ml_id, lang, {_ROUTED} AS family, dist[1].name AS top FROM {_DIST}")
def c17_route_details(s, d):
    r = _long(s, d).where("text is not null").select("ml_id", "lang", C.route_details(F.col("text")).alias("r"))
    return r.select("ml_id", "lang", "r.family", F.col("r.distribution")[0]["name"].alias("top"))


@query(f"SELECT ml_id, lang, len(list_filter(dist, lambda r: r.m < 0)) > 1 AS mixed FROM {_DIST}")
def c18_is_mixed(s, d):
    return _long(s, d).where("text is not null").select("ml_id", "lang", C.is_mixed(F.col("text")).alias("mixed"))


@query(f"SELECT fam_id, coalesce(m.f, 'english') AS mapped FROM families LEFT JOIN {S.FAMILY_VALUES} AS m(l, f) ON lower(language) = m.l")
def c19_j4_family_of(s, d):
    return table(s, d, "families").select("fam_id", family_of(F.col("language")).alias("mapped"))


@query(f"WITH r AS (SELECT lang, {_ROUTED} AS family, coalesce(m.f, 'english') AS want FROM {_DIST} LEFT JOIN {S.FAMILY_VALUES} AS m(l, f) ON lang = m.l) SELECT want, count(*) AS n, round(avg((family = want)::INT), 6) AS accuracy FROM r GROUP BY want")
def c20_routing_accuracy(s, d):
    r = _long(s, d).where("text is not null").select(C.route(F.col("text")).alias("family"), family_of(F.col("lang")).alias("want"))
    return r.groupBy("want").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("family") == F.col("want")).cast("int")), 6).alias("accuracy"))


@query(f"SELECT ml_id, lang, array_to_string(list_transform(dist[1:3], lambda r: r.name), ',') AS top FROM {_DIST}")
def t6_top_scripts(s, d):
    return _long(s, d).where("text is not null").select("ml_id", "lang", F.array_join(F.transform(C.top_scripts(F.col("text")), lambda r: r["name"]), ",").alias("top"))


@query(f"SELECT ml_id, lang, regexp_extract(text, '(【[^\\n]*?】|\\[[A-Z]{{2,4}}\\]|^【|】$)', 1) AS marker FROM ({_LONG_TEXT}) WHERE {S.marker('text')}")
def f1_markers(s, d):
    return _long(s, d).where(P.has_marker(F.col("text"))).select("ml_id", "lang", P.marker(F.col("text")).alias("marker"))


@query(f"SELECT canon_id FROM canonical WHERE {S.chars_repeat('input')}")
def f2_repeated_chars(s, d):
    return table(s, d, "canonical").where(P.repeated_chars(F.col("input"))).select("canon_id")


@query(f"SELECT count(*) AS n FROM canonical WHERE {S.tokens_repeat('input')}")
def f3_repeated_tokens(s, d):
    return table(s, d, "canonical").agg(F.count_if(P.repeated_tokens(F.col("input"))).alias("n"))


@query()
def f3b_repeated_words(s, d):
    return table(s, d, "documents").select("doc_id", P.repeated_words(F.col("text")).alias("repeated"))


@query(f"SELECT canon_id, {S.digit_spam('input')} AS spam FROM canonical WHERE input IS NOT NULL")
def f4_digit_spam(s, d):
    return table(s, d, "canonical").where("input is not null").select("canon_id", P.digit_spam(F.col("input")).alias("spam"))


@query(f"SELECT canon_id, {S.pure_digits('input')} AS pure FROM canonical WHERE input IS NOT NULL")
def f5_pure_digits(s, d):
    return table(s, d, "canonical").where("input is not null").select("canon_id", P.pure_digits(F.col("input")).alias("pure"))


@query(f"SELECT canon_id, len({S.words('input')}) > 20 AS long FROM canonical WHERE input IS NOT NULL")
def f6_too_long(s, d):
    return table(s, d, "canonical").where("input is not null").select("canon_id", P.too_long(F.col("input")).alias("long"))


@query("SELECT distill_id, coalesce(output <> '' AND NOT contains(output, '<END>'), false) AS missing FROM distill")
def f7_missing_end(s, d):
    return table(s, d, "distill").select("distill_id", P.missing_end(F.col("output")).alias("missing"))


_F8 = f"CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN {S.strip('text')} = '' THEN 'blank' WHEN {S.marker(S.strip('text'))} THEN 'placeholder' WHEN regexp_matches({S.strip('text')}, '[\\[【】]') THEN 'bracket' WHEN lang <> 'english' AND {S.key('text')} = {S.key('english')} THEN 'identical' END"


@query(f"SELECT ml_id, lang, {_F8} AS verdict FROM {S.LONG}")
def f8_translation_verdict(s, d):
    return _long(s, d).select("ml_id", "lang", P.translation_verdict(F.col("text"), F.col("lang"), F.col("english")).alias("verdict"))


@query(f"SELECT ml_id, lang, lang = 'english' OR {S.key('text')} <> {S.key('english')} AS diverse FROM {S.LONG} WHERE text IS NOT NULL AND english IS NOT NULL")
def f11_language_diversity(s, d):
    return _long(s, d).where("text is not null and english is not null").select("ml_id", "lang", P.is_diverse(F.col("text"), F.col("lang"), F.col("english")).alias("diverse"))


@query(rf"SELECT ml_id, lang, len(regexp_extract_all(english, '\p{{Nd}}+')) > 0 AND NOT list_has_any(regexp_extract_all(english, '\p{{Nd}}+'), regexp_extract_all(text, '\p{{Nd}}+')) AS lost FROM {S.LONG} WHERE text IS NOT NULL AND english IS NOT NULL")
def f12_u3_numbers_lost(s, d):
    return _long(s, d).where("text is not null and english is not null").select("ml_id", "lang", P.numbers_lost(F.col("text"), F.col("english")).alias("lost"))


@query(f"SELECT canon_id FROM canonical WHERE NOT coalesce({S.chars_repeat('intent')} OR {S.tokens_repeat('intent')} OR {S.digit_spam('intent')} OR {S.pure_digits('intent')}, false)")
def f16_clean_rows(s, d):
    return table(s, d, "canonical").where(P.is_clean(F.col("intent"))).select("canon_id")


_F17 = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in ((S.chars_repeat("intent"), "repeated_chars"), (S.tokens_repeat("intent"), "repeated_tokens"), (S.digit_spam("intent"), "digit_spam"), (S.chars_repeat("input"), "input_repeated_chars"), (S.digit_spam("input"), "input_digit_spam")))


@query(f"SELECT * FROM (SELECT canon_id, array_to_string(list_filter([{_F17}], lambda x: x IS NOT NULL), ',') AS reasons FROM canonical) WHERE reasons <> ''")
def f17_sample_reasons(s, d):
    return table(s, d, "canonical").select("canon_id", F.array_join(P.sample_reasons(F.col("intent"), F.col("input")), ",").alias("reasons")).where("reasons != ''")


@query("SELECT ml_id FROM multilingual_intents WHERE cardinality(inputs) = 9")
def f18_strict_languages(s, d):
    return table(s, d, "multilingual_intents").where(F.size("inputs") == 9).select("ml_id")
