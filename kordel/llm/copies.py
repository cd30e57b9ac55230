"""Problem 2: records that differ in formatting only, and how many copies each has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import LMN, materialize

#: Keys with at least HOT_ROWS rows, which one task can well hold, are hot; HOT_KEYS of them (32 bytes each) are broadcast at once.
HOT_ROWS, HOT_KEYS, SALTS = 20_000, 100_000, 64

_CUT, _ARG = "\x01", "\x02"
_QUOTED = r'"(?:\\(?s:.)|[^"\\])*(?:"|\z)'
_TOKENS = rf'{_QUOTED}|;|->|[^";\-]+|-'
_VALUE = rf'(?:{_QUOTED}|[^\s"]\S*)?'
_ARGUMENT = rf":\s*[^\s:=\"]+\s*=\s*{_VALUE}"
_PROGRAM = rf"(?s)^\s*\.?\s*[^\s:=\"]+\s*(?:{_ARGUMENT}\s*)*$"


def letters_key(c: Column) -> Column:
    """Letters lower-cased in their order; whatever stands between two digits is one break, all else is dropped."""
    broken = F.regexp_replace(F.lower(c), rf"(?<=\p{{N}})[^{LMN}]+(?=\p{{N}})", _CUT)
    return F.regexp_replace(broken, f"[^{LMN}{_CUT}]+", "")


def pieces(intent: Column) -> Column:
    """The intent cut at `;` and `->` outside quotes, by one tokenising pass."""
    tokens = F.regexp_extract_all(intent, F.lit(f"(?s){_TOKENS}"), 0)
    joined = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(";", "->"), F.lit(_CUT)).otherwise(t)), "")
    return F.split(joined, _CUT)


def piece_key(piece: Column) -> Column:
    """Op and sorted arguments of a piece that is a program; the letters of any other piece."""
    op = letters_key(F.regexp_extract(piece, r'(?s)^\s*\.?\s*([^\s:="]+)', 1))
    args = F.transform(
        F.regexp_extract_all(F.regexp_extract(piece, r'(?s)^\s*\.?\s*[^\s:="]+(.*)$', 1), F.lit(f"(?s){_ARGUMENT}"), 0),
        lambda a: F.concat(
            letters_key(F.regexp_extract(a, r'(?s)^:\s*([^\s:="]+)', 1)), F.lit("="),
            letters_key(F.regexp_replace(F.regexp_extract(a, r'(?s)^:\s*[^\s:="]+\s*=(.*)$', 1), r"\\(?=[\"\\])", "")),
        ),
    )
    return F.when(F.rlike(piece, F.lit(_PROGRAM)), F.concat(op, F.lit(_ARG), F.array_join(F.array_sort(args), _ARG))).otherwise(letters_key(piece))


def intent_key(intent: Column) -> Column:
    kept = F.filter(pieces(intent), lambda p: F.rlike(p, F.lit(f"[{LMN}]")))
    return F.array_join(F.transform(kept, piece_key), "\x03")


def canonical_key(text: Column, intent: Column) -> Column:
    """32 bytes that agree exactly for records equal up to formatting. Null agrees with null only."""
    def side(raw: Column, key: Column) -> Column:
        return F.when(raw.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), key))

    return F.unhex(F.sha2(F.concat(side(text, letters_key(text)), F.lit("\x04"), side(intent, intent_key(intent))), 256))


def _hot_split(keyed: DataFrame, hot_rows: int, hot_keys: int) -> tuple[list[DataFrame], DataFrame]:
    """Rows of hot keys, in slices of at most hot_keys keys or thereabouts, and the rest. Hot keys, with more rows than one task
    should have, are counted exactly; each slice of them is broadcast by itself, however many slices there are."""
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") >= hot_rows).select("key"), "hot-keys")
    parts = -(-hot.count() // hot_keys)
    slices, rest = [], keyed
    for k in range(parts):
        some = F.broadcast(hot.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k) if parts > 1 else hot)
        slices.append(keyed.join(some, "key", "left_semi"))
        rest = rest.join(some, "key", "left_anti")
    return slices, rest


def representatives(df: DataFrame, id_col: str, text_col: str, intent_col: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> tuple[DataFrame, DataFrame]:
    """(groups, members): groups(key, keep_id, copies) has one row per distinct record, members(keep_id, copy_id) one per
    surplus copy.

    Hot keys go through a salted two-level aggregate and broadcasts of at most about HOT_KEYS representatives, so no task
    sees a whole hot group; all other keys, of fewer than hot_rows rows each, take one shuffle on the key. The representative
    is the smallest identifier. Rows with a null or empty text or intent are records like any other; an empty table gives
    empty results.
    """
    keyed = materialize(df.select(F.col(id_col).alias("id"), canonical_key(F.col(text_col), F.col(intent_col)).alias("key")), "copy-keys")
    hot, rest = _hot_split(keyed, hot_rows, hot_keys)
    groups = rest.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    members = rest.join(groups.where("copies > 1"), "key")
    for rows in hot:
        own = (
            rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
            .groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
        )
        groups, members = groups.unionByName(own), members.unionByName(rows.join(F.broadcast(own), "key"))
    return groups, members.where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))
