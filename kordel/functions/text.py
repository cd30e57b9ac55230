"""Cleaning of text and of model output (B1-B16), as Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import WS, strip_ws

LINES = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
CONTROLS = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{80}-\x{9f}\x{feff}]"


def sanitize(s: Column) -> Column:
    """B1: without control characters other than tab and line breaks, and without byte order marks."""
    return F.regexp_replace(s, CONTROLS, "")


def squeeze(s: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return strip_ws(F.regexp_replace(s, f"[{WS}]+", " "))


def _without(s: Column, marks: list[str], by: str) -> Column:
    for m in marks:
        s = F.replace(s, F.lit(m), F.lit(by))
    return s


def _lines(raw: Column) -> Column:
    return F.filter(F.transform(F.split(sanitize(F.coalesce(raw, F.lit(""))), LINES), strip_ws), lambda x: x != "")


def strict_reason(raw: Column) -> Column:
    """B2: format, multi_line or no_dot; null for a single program line."""
    lines = _lines(raw)
    return F.when(F.size(lines) == 0, "format").when(F.size(lines) > 1, "multi_line").when(~F.startswith(lines[0], F.lit(".")), "no_dot")


def strict_line(raw: Column) -> Column:
    """The line, or null."""
    return F.when(strict_reason(raw).isNull(), F.get(_lines(raw), F.lit(0)))


def _printable(s: Column) -> Column:
    return F.regexp_replace(s, r"[\p{C}\p{Z}&&[^ ]]", "")


def _from_dot(s: Column) -> Column:
    return F.regexp_extract(s, r"(?s)(\..*)$", 1)


def extract_program(raw: Column) -> Column:
    """From the first dot on, printable characters only (which joins lines, as they are dropped before any cut)."""
    return strip_ws(_from_dot(squeeze(sanitize(_printable(_without(raw, ["<OUTPUT>", "<|endoftext|>", "</s>"], " "))))))


def extract_program_respaced(raw: Column) -> Column:
    """As B4 with more marks, `:k=` without inner spaces and ` ; ` between ops."""
    s = _from_dot(squeeze(_printable(_without(raw, ["<OUTPUT>", "<END>", "<START>", "<|endoftext|>", "</s>"], " "))))
    s = F.regexp_replace(s, r"(?s)<INPUT>.*$", "")
    s = F.regexp_replace(s, rf":[{WS}]*([A-Za-z_][A-Za-z0-9_]*)[{WS}]*=[{WS}]*", ":$1=")
    return squeeze(F.regexp_replace(s, rf"[{WS}]*;[{WS}]*", " ; "))


def first_choice_text(choices: Column) -> Column:
    """Text of the first choice of a completion, empty if there is none."""
    return F.coalesce(F.get(choices, F.lit(0))["text"], F.lit(""))


def clean_output(text: Column) -> Column:
    """B7."""
    s = _without(text, ["<|endoftext|>", "</s>", "<END>", "<START>", "�"], "")
    s = squeeze(F.regexp_replace(F.split(s, "\n")[0], r"[^\x{0}-\x{7f}]+$", ""))
    return F.when(text == "", text).when((s != "") & ~F.startswith(s, F.lit(".")), F.concat(F.lit(". "), s)).otherwise(s)


def teacher_line(raw: Column) -> Column:
    """B8, first half: what follows OUTPUT:, its first line, with a leading dot; null if nothing is left."""
    s = strip_ws(_without(raw, ["<|endoftext|>", "</s>", "<END>"], ""))
    s = (
        F.when(F.contains(s, F.lit("OUTPUT:")), strip_ws(F.regexp_replace(s, r"(?s)^.*?OUTPUT:", "")))
        .when(F.contains(s, F.lit("<OUTPUT>")), strip_ws(F.regexp_replace(s, r"(?s)^.*?<OUTPUT>", "")))
        .otherwise(s)
    )
    s = strip_ws(F.split(s, "\n")[0])
    return F.when(s == "", None).when(F.startswith(s, F.lit(".")), s).otherwise(F.concat(F.lit(". "), s))


def valid_json(s: Column) -> Column:
    """Whether the whole text is one JSON value; wrapped, as the parser itself ignores what follows the first value."""
    return F.try_parse_json(F.concat(F.lit('{"x":'), s, F.lit("}"))).isNotNull()


def extract_json(text: Column) -> Column:
    """From the first `{` to the last `}`, null if that is no JSON."""
    s = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when((s != "") & valid_json(s), s)


def build_prompt(template: Column, text: Column) -> Column:
    """B10."""
    return F.replace(template, F.lit("{input}"), text)


def words(s: Column) -> Column:
    return F.filter(F.split(s, f"[{WS}]+"), lambda w: w != "")


def word_count(s: Column) -> Column:
    """B11."""
    return F.size(words(s))


def numbers(s: Column) -> Column:
    """The distinct runs of decimal digits, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"\p{Nd}+"), 0))


def params_json(params: Column) -> Column:
    """JSON text of a map with its keys in order; a null value is a null of JSON."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))), {"ignoreNullFields": "false"})


def category(intent: Column) -> Column:
    """The namespace of the first op."""
    return F.split_part(F.split_part(intent, F.lit(" "), F.lit(2)), F.lit("."), F.lit(1))


def prefix(s: Column, n: int = 60) -> Column:
    """B16."""
    return F.left(s, F.lit(n))
