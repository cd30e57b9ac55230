"""The command language: scanning, resolving, serialising and fingerprinting of programs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from kordel.common import WS, strip_ws
from kordel.functions.text import sanitize
from kordel.operators.registry import ALIASES, literal_map

OPS_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType()))]))
PROGRAM_TYPE = T.StructType([T.StructField("ops", OPS_TYPE), T.StructField("error", T.StringType())])
MAX_OPS = 6

_UNIT = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|;|->|[^";\-]+|-', re.S)
_OP = re.compile(r"[A-Za-z0-9_.]+")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ARG_HEAD = re.compile(r":([^\s=]*)(=?)\s*", re.S)
_STRING = re.compile(r'"((?:\\.|[^"\\])*)"', re.S)
_BARE = re.compile(r"\S+")


def split_chain(text: str) -> list[str]:
    """Segments between `;` and `->`, which count only outside quotes; trimmed, empty ones left out."""
    groups: list[list[str]] = [[]]
    for unit in _UNIT.findall(text):
        if unit in (";", "->"):
            groups.append([])
        else:
            groups[-1].append(unit)
    return [s for s in ("".join(g).strip() for g in groups) if s]


def scan_args(text: str) -> tuple[dict[str, str], str | None]:
    """Arguments of a segment, the last of equal keys winning, and the error, if any."""
    args: dict[str, str] = {}
    rest = text.lstrip()
    while rest:
        head = _ARG_HEAD.match(rest)
        if not head:
            return {}, "expected :key=value"
        if not _KEY.fullmatch(head[1]):
            return {}, "invalid key"
        if not head[2]:
            return {}, "missing ="
        rest = rest[head.end() :]
        if not rest:
            return {}, "missing value"
        value = (_STRING if rest[0] == '"' else _BARE).match(rest)
        if not value:
            return {}, "unterminated"
        args[head[1]] = re.sub(r"\\(.)", r"\1", value[1], flags=re.S) if rest[0] == '"' else value[0]
        rest = rest[value.end() :].lstrip()
    return args, None


def parse_text(program: str | None) -> tuple[list[dict] | None, str | None]:
    """(ops, error): exactly one of them is None. Argument keys are in order."""
    body = (program or "").strip()
    if not body.startswith("."):
        return None, "must start with '.'"
    segments = split_chain(body[1:].strip())
    if not segments:
        return None, "no operations"
    ops = []
    for s in segments:
        op, _, rest = s.partition(" ")
        if not _OP.fullmatch(op):
            return None, "invalid op"
        args, error = scan_args(rest)
        if error:
            return None, error
        ops.append({"op": op, "args": dict(sorted(args.items()))})
    return ops, None


@F.udf(PROGRAM_TYPE, useArrow=True)
def _parse(program):
    return parse_text(program)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _split(text):
    return None if text is None else split_chain(text)


def parse(program: Column) -> Column:
    """struct(ops, error). A null program has the error of an empty one; nothing is ever raised."""
    return _parse(program)


def split_segments(text: Column) -> Column:
    """A1."""
    return _split(text)


def quote(value: Column) -> Column:
    """The value in quotes, backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def entries(args: Column) -> Column:
    return F.array_sort(F.map_entries(args))


def serialize(ops: Column) -> Column:
    """`. op :k="v" ; op2`, keys in order."""
    part = lambda o: F.array_join(F.concat(F.array(o["op"]), F.transform(entries(o["args"]), lambda e: F.concat(F.lit(":"), e["key"], F.lit("="), quote(e["value"])))), " ")
    return F.concat(F.lit(". "), F.array_join(F.transform(ops, part), " ; "))


def op_key(op: Column) -> Column:
    """A10: what makes two ops the same."""
    return F.struct(op["op"].alias("op"), entries(op["args"]).alias("args"))


def resolve_ops(ops: Column) -> Column:
    """A11 over a program; an op that can't be resolved becomes null."""
    name = lambda o: F.when(F.contains(o["op"], F.lit(".")), o["op"]).otherwise(literal_map(ALIASES)[F.lower(o["op"])])
    return F.transform(ops, lambda o: F.struct(name(o).alias("op"), o["args"].alias("args")))


def first_occurrences(ops: Column) -> Column:
    """Later repeats of an op with equal arguments go, wherever they stand. Maps can't be compared, so entries are."""
    keyed = F.array_distinct(F.transform(ops, op_key))
    return F.transform(keyed, lambda o: F.struct(o["op"].alias("op"), F.map_from_entries(o["args"]).alias("args")))


def canonicalize(parsed: Column) -> Column:
    """A9 on a struct of parse(): the canonical text, null where parsing or resolving failed. Parse sanitized text."""
    resolved = resolve_ops(parsed["ops"])
    known = parsed["error"].isNull() & F.forall(resolved, lambda o: o["op"].isNotNull())
    return F.when(known, sanitize(serialize(first_occurrences(resolved))))


def fixed_ops(parsed: Column) -> Column:
    """How many ops an alias lookup repaired."""
    return F.size(F.filter(F.coalesce(parsed["ops"], F.array().cast(OPS_TYPE)), lambda o: ~F.contains(o["op"], F.lit(".")) & literal_map(ALIASES)[F.lower(o["op"])].isNotNull()))


def rejected_ops(parsed: Column) -> Column:
    """1 where some op has no mapping; the first such op ends the program."""
    return F.coalesce(F.exists(resolve_ops(parsed["ops"]), lambda o: o["op"].isNull()), F.lit(False)).cast("int")


def fingerprint(ops: Column) -> Column:
    """`op:k=v,k2=v2|op2`, values as they are."""
    part = lambda o: F.when(F.size(o["args"]) == 0, o["op"]).otherwise(F.concat(o["op"], F.lit(":"), F.array_join(F.transform(entries(o["args"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")))
    return F.array_join(F.transform(ops, part), "|")


def program_hash(ops: Column) -> Column:
    """A14."""
    return F.sha2(fingerprint(ops), 256)


def loose_parse(text: Column) -> Column:
    """struct(intent, params) from the first op and all `:k=v` of the rest, the last of equal keys winning."""
    s = strip_ws(text)
    body = F.when(F.startswith(s, F.lit(". ")), F.substring(s, 3, 1 << 30)).when(F.startswith(s, F.lit(".")), F.regexp_replace(F.substring(s, 2, 1 << 30), f"^[{WS}]+", "")).otherwise(s)
    found = F.regexp_extract_all(F.regexp_extract(body, r"(?s)^[^ ]* (.*)$", 1), F.lit(r':[\p{L}\p{N}_]+=(?:"[^"]*"|\S*)'), 0)
    kv = F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"^:([^=]+)=", 1).alias("key"), F.regexp_replace(F.regexp_extract(a, r"(?s)^:[^=]+=(.*)$", 1), r'(?s)^"(.*)"$', "$1").alias("value")))
    last = F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.size(kv)), lambda later: later["key"] == e["key"]))
    return F.struct(strip_ws(F.regexp_extract(body, r"(?s)^([^ ]*)", 1)).alias("intent"), F.map_from_entries(last).alias("params"))


#: Atoms in the order in which they are tried.
ATOMS = r'->|;|\*|\$[0-9]+|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\z)|:|=|(?<!\S)\.|[\p{L}_][\p{L}\p{N}._]*|\S'


def scan_atoms(text: Column) -> Column:
    """One regular expression, ordered alternatives; whitespace separates atoms and is dropped."""
    return F.regexp_extract_all(text, F.lit(ATOMS), 0)


def join_atoms(text: Column) -> Column:
    """A16."""
    return F.array_join(scan_atoms(text), "\x01")


def legacy_alias_fix(text: Column) -> Column:
    """`.now` -> `.time.now`, first op only, whitespace runs becoming one space where it changes anything."""
    words = F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")
    op = F.substring(words[0], 2, 1 << 30)
    to = literal_map(ALIASES)[op]
    fixed = F.concat(F.lit("."), to, F.when(F.size(words) > 1, F.concat(F.lit(" "), F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " "))).otherwise(F.lit("")))
    return F.when(F.startswith(text, F.lit(".")) & (F.size(words) > 0) & to.isNotNull(), fixed).otherwise(text)


def all_namespaced(ops: Column) -> Column:
    """A18."""
    return F.forall(ops, lambda o: F.contains(o["op"], F.lit(".")))


def is_valid_program(text: Column) -> Column:
    """One line that starts with a dot."""
    return F.startswith(text, F.lit(".")) & ~F.contains(text, F.lit("\n")) & ~F.contains(text, F.lit("\r"))


def intent_verdict(text: Column, parsed: Column, canonical: Column) -> Column:
    """The first failing check of empty, op names, syntax, canonical form; `ok` if none."""
    return (
        F.when(F.coalesce(F.length(strip_ws(text)), F.lit(0)) == 0, "empty")
        .when(parsed["error"].isNotNull(), "syntax")
        .when(~all_namespaced(parsed["ops"]), "op_name")
        .when(canonical.isNull() | (canonical != text), "not_canonical")
        .otherwise("ok")
    )


def bare_words(text: Column) -> Column:
    """Words of a program that stand where an op does and have no namespace."""
    return F.array_distinct(F.filter(F.split(text, rf"[{WS}]+"), lambda w: (w != "") & ~F.contains(w, F.lit(".")) & ~F.startswith(w, F.lit(":")) & ~w.isin(";", "->")))
