"""Script counts and routing of text to a family (C0-C20), generated from one table of ranges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kordel.common import blank

# Ranges of code points of each script, in hexadecimal.
RANGES: dict[str, str] = {
    "latin": "41-5A 61-7A C0-FF 100-17F 180-24F 1E00-1EFF",
    "han": "4E00-9FFF 3400-4DBF 20000-2A6DF F900-FAFF",
    "hiragana": "3040-309F",
    "katakana": "30A0-30FF 31F0-31FF",
    "hangul": "AC00-D7AF 1100-11FF 3130-318F",
    "arabic": "600-6FF 750-77F 8A0-8FF FB50-FDFF FE70-FEFF",
    "devanagari": "900-97F A8E0-A8FF",
    "tamil": "B80-BFF",
    "telugu": "C00-C7F",
    "bengali": "980-9FF",
    "gujarati": "A80-AFF",
    "kannada": "C80-CFF",
    "malayalam": "D00-D7F",
    "punjabi": "A00-A7F",
    "cyrillic": "400-4FF 500-52F 2DE0-2DFF A640-A69F",
    "greek": "370-3FF 1F00-1FFF",
    "hebrew": "590-5FF FB1D-FB4F",
    "thai": "E00-E7F",
    "lao": "E80-EFF",
    "khmer": "1780-17FF 19E0-19FF",
    "myanmar": "1000-109F AA60-AA7F",
    "ethiopic": "1200-137F 1380-139F 2D80-2DDF",
}
# Families of scripts in the order that breaks ties.
GROUPS: dict[str, list[str]] = {
    "cjk": ["han", "hiragana", "katakana", "hangul"],
    "arabic": ["arabic"],
    "indic": ["devanagari", "tamil", "telugu", "bengali", "gujarati", "kannada", "malayalam", "punjabi"],
    "cyrillic": ["cyrillic"],
    "greek": ["greek"],
    "hebrew": ["hebrew"],
    "southeast_asian": ["thai", "lao", "khmer", "myanmar"],
    "ethiopic": ["ethiopic"],
    "latin": ["latin"],
}
LATIN_SHARE, OTHER_SHARE, DEFAULT = 0.50, 0.30, "english"


def char_class(*scripts: str) -> str:
    body = "".join("-".join(f"\\x{{{e}}}" for e in r.split("-")) for s in scripts for r in RANGES[s].split())
    return f"[{body}]"


def count_range(text: Column, first: int, last: int) -> Column:
    """C0."""
    return F.regexp_count(text, F.lit(f"[\\x{{{first:x}}}-\\x{{{last:x}}}]"))


def count_script(text: Column, *scripts: str) -> Column:
    """Characters in the ranges of the scripts."""
    return F.regexp_count(text, F.lit(char_class(*scripts)))


def count_letters(text: Column) -> Column:
    """C14."""
    return F.regexp_count(text, F.lit(r"\p{L}"))


def family_name(group: str) -> str:
    return "english" if group == "latin" else group


def distribution(text: Column) -> Column:
    """Array of struct(name, family, count), most frequent first, ties in the order of GROUPS."""
    rows = [
        F.struct((-count_script(text, *s)).alias("minus"), F.lit(i).alias("i"), F.lit(g).alias("name"), F.lit(family_name(g)).alias("family")) for i, (g, s) in enumerate(GROUPS.items())
    ]
    return F.transform(F.array_sort(F.array(*rows)), lambda r: F.struct(r["name"].alias("name"), r["family"].alias("family"), (-r["minus"]).alias("count")))


def route(text: Column) -> Column:
    """The first family in C15 whose share of the letters reaches its threshold; english otherwise."""
    t = F.coalesce(text, F.lit(""))
    letters = count_letters(t)
    enough = F.filter(distribution(t), lambda r: (r["count"] > 0) & (r["count"] >= F.when(r["family"] == "english", LATIN_SHARE).otherwise(OTHER_SHARE) * letters))
    return F.when(blank(t) | (letters == 0), DEFAULT).otherwise(F.coalesce(F.get(enough, F.lit(0))["family"], F.lit(DEFAULT)))


def route_details(text: Column) -> Column:
    """C17."""
    return F.struct(route(text).alias("family"), distribution(F.coalesce(text, F.lit(""))).alias("distribution"))


def is_mixed(text: Column) -> Column:
    """More than one family of scripts present."""
    return F.size(F.filter(distribution(F.coalesce(text, F.lit(""))), lambda r: r["count"] > 0)) > 1


def top_scripts(text: Column, k: int = 3) -> Column:
    """T6."""
    return F.slice(distribution(text), 1, k)
