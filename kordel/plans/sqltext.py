"""Pieces of DuckDB SQL shared by the oracle statements."""

from __future__ import annotations

from kordel.operators.registry import ALIASES, LANGUAGE_FAMILY, OPS

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
W = r"[\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def sanitize(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{80}}-\x{{9f}}\x{{feff}}]', '', 'g')"


def count_in(x: str, body: str) -> str:
    return f"len(regexp_extract_all({x}, '{body}'))"


def chars_repeat(x: str) -> str:
    """Four of a character other than a line feed in a row, without back references."""
    return f"len(list_filter(range(1, length({x}) - 2), lambda i: substr({x}, i, 1) <> chr(10) AND substr({x}, i, 4) = repeat(substr({x}, i, 1), 4))) > 0"


def tokens_repeat(x: str) -> str:
    w = words(x)
    return (
        f"len(list_filter(range(1, len({w}) - 2), lambda i: regexp_full_match(({w})[i+1], '{W}+') AND ({w})[i+1] = ({w})[i+2] "
        f"AND regexp_extract(({w})[i], '({W}+)$', 1) = ({w})[i+1] AND regexp_extract(({w})[i+3], '^({W}+)', 1) = ({w})[i+1])) > 0"
    )


def digit_spam(x: str) -> str:
    return rf"regexp_matches({x}, '\p{{Nd}}{{5,}}')"


def pure_digits(x: str) -> str:
    return rf"""regexp_matches(regexp_replace({x}, '[.:;="{WS}]', '', 'g'), '^\p{{Nd}}+$')"""


def marker(x: str) -> str:
    return rf"regexp_matches({x}, '【[^\n]*?】|\[[A-Z]{{2,4}}\]|^【|】$')"


def values(d: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in d.items()) + ")"


ALIAS_VALUES, FAMILY_VALUES = values(ALIASES), values(LANGUAGE_FAMILY)
OPS_VALUES = "(VALUES " + ", ".join(f"({q(k)}, [{', '.join(map(q, v))}]::VARCHAR[])" for k, v in OPS.items()) + ")"
#: Every text of multilingual_intents as a row.
LONG = "(SELECT ml_id, intent, base_input, inputs['english'] AS english, e.key AS lang, e.value AS text FROM (SELECT *, unnest(map_entries(inputs)) AS e FROM multilingual_intents))"
