"""Quality predicates over text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import WS, blank, norm_key, strip_ws
from kordel.functions.text import numbers, word_count

WORD = r"[\p{L}\p{N}_]"
MARKER = r"【[^\n]*?】|\[[A-Z]{2,4}\]|^【|】$"
REPEATED_CHARS = r"(?d)(.)\1{3,}"
REPEATED_TOKENS = rf"(?<!{WORD})({WORD}+)(?:[{WS}]+\1){{3,}}(?!{WORD})"
REPEATED_WORDS = rf"(?<!{WORD})([^{WS}]+)(?:[{WS}]+\1){{2,}}(?!{WORD})"
DIGIT_SPAM = r"\p{Nd}{5,}"
MAX_WORDS = 20


def has_marker(s: Column) -> Column:
    """a stand-in marker instead of a translation."""
    return F.rlike(s, F.lit(MARKER))


def marker(s: Column) -> Column:
    """the matched marker, null if there is none."""
    return F.nullif(F.regexp_extract(s, f"({MARKER})", 1), F.lit(""))


def repeated_chars(s: Column) -> Column:
    """four or more of a character in a row."""
    return F.rlike(s, F.lit(REPEATED_CHARS))


def repeated_tokens(s: Column) -> Column:
    """four or more of a word in a row."""
    return F.rlike(s, F.lit(REPEATED_TOKENS))


def repeated_words(s: Column) -> Column:
    """Three or more of a run without spaces in a row."""
    return F.rlike(s, F.lit(REPEATED_WORDS))


def digit_spam(s: Column) -> Column:
    """five or more digits in a row."""
    return F.rlike(s, F.lit(DIGIT_SPAM))


def pure_digits(s: Column) -> Column:
    """nothing but digits apart from program punctuation."""
    return F.rlike(F.regexp_replace(s, rf'[.:;="{WS}]', ""), F.lit(r"^\p{Nd}+$"))


def too_long(s: Column, limit: int = MAX_WORDS) -> Column:
    """F6."""
    return word_count(s) > limit


def missing_end(raw: Column) -> Column:
    """raw output given, and no end mark in it."""
    return F.coalesce((raw != "") & ~F.contains(raw, F.lit("<END>")), F.lit(False))


def translation_verdict(text: Column, language: Column, original: Column) -> Column:
    """F8: why a translation is none; null if it is one."""
    t = strip_ws(text)
    return (
        F.when(text.isNull() | (text == ""), "empty").when(t == "", "blank").when(has_marker(t), "placeholder")
        .when(F.rlike(t, F.lit(r"[\[【】]")), "bracket").when((language != "english") & (norm_key(t) == norm_key(original)), "identical")
    )


def repair_span(value: Column, text: Column) -> Column:
    """F9 for one value: itself where the text holds it, the text's own spelling where only case differs, else null."""
    at = F.instr(F.lower(text), F.lower(value))
    return F.when(F.contains(text, value), value).when(at > 0, F.substring(text, at, F.length(value)))


def repair_spans(params: Column, text: Column) -> Column:
    """the params with repaired values; null where a value isn't in the text, so that the row is dropped."""
    fixed = F.transform_values(params, lambda _, v: repair_span(v, text))
    return F.when(F.forall(F.map_values(fixed), lambda v: v.isNotNull()), fixed)


def spans_hold(params: Column, text: Column) -> Column:
    """F10."""
    return F.forall(F.map_values(params), lambda v: F.contains(text, v))


def is_diverse(text: Column, language: Column, english: Column) -> Column:
    """a translation differs from the English text."""
    return (language == "english") | (norm_key(text) != norm_key(english))


def numbers_lost(text: Column, original: Column) -> Column:
    """the original has numbers and the text none of them."""
    n = numbers(original)
    return (F.size(n) > 0) & ~F.arrays_overlap(n, numbers(text))


def output_reasons(text: Column, raw: Column, valid: Column, require_end: bool = False) -> Column:
    """all reasons against an output; syntax only where there is no other."""
    s = strip_ws(text)
    found = F.array_compact(
        F.array(
            F.when(repeated_chars(s), F.concat(F.lit("repeated_char:'"), F.left(F.regexp_extract(s, REPEATED_CHARS, 0), F.lit(10)), F.lit("'"))),
            F.when(repeated_words(s), F.concat(F.lit("repeated_word:'"), F.left(F.regexp_extract(s, REPEATED_WORDS, 0), F.lit(20)), F.lit("'"))),
            F.when(digit_spam(s), F.lit("digit_spam")),
            F.when(pure_digits(s), F.lit("pure_digits")),
            F.when(too_long(s), F.concat(F.lit("too_long:"), word_count(s).cast("string"), F.lit("_tokens"))),
            F.when(missing_end(raw) if require_end else F.lit(False), F.lit("missing_END")),
        )
    )
    return F.when(blank(text), F.array(F.lit("empty_output"))).when((F.size(found) == 0) & ~valid, F.array(F.lit("invalid_syntax"))).otherwise(found)


def sample_reasons(intent: Column, text: Column) -> Column:
    """F17."""
    return F.array_compact(
        F.array(
            F.when(repeated_chars(intent), "repeated_chars"), F.when(repeated_tokens(intent), "repeated_tokens"), F.when(digit_spam(intent), "digit_spam"),
            F.when(repeated_chars(text), "input_repeated_chars"), F.when(digit_spam(text), "input_digit_spam"),
        )
    )


def is_clean(intent: Column) -> Column:
    """F16: what the clean-row filter keeps."""
    bad = repeated_chars(intent) | repeated_tokens(intent) | digit_spam(intent) | pure_digits(intent)
    return ~F.coalesce(bad, F.lit(False))
