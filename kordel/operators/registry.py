"""Fixed dimension tables: ops with their required fields, aliases, languages with their families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Op and its required fields.
OPS: dict[str, list[str]] = {
    "message.send": ["to", "text"],
    "payment.send": ["to", "amount"],
    "payment.request": ["from_", "amount"],
    "payment.balance": [],
    "payment.history": [],
    "memory.store": ["text"],
    "memory.read": [],
    "memory.write": ["key", "value"],
    "memory.delete": ["key"],
    "memory.clear": [],
    "memory.list": [],
    "time.now": [],
    "time.date": [],
    "time.timestamp": [],
    "time.timezone": ["zone"],
    "web.search": ["query"],
    "web.request": ["url"],
    "timer.set": ["duration"],
    "alarm.set": ["time"],
    "call.start": ["to"],
    "email.send": ["to", "subject", "body"],
    "notify.send": ["text"],
    "system.status": [],
    "system.help": [],
    "system.version": [],
    "settings.volume": ["level"],
    "settings.brightness": ["level"],
    "weather.current": ["location"],
    "navigate.to": ["destination"],
    "music.play": ["query"],
    "music.pause": [],
    "music.next": [],
    "music.previous": [],
}

# Short names and the op each stands for.
ALIASES: dict[str, str] = {
    "now": "time.now",
    "time": "time.now",
    "date": "time.date",
    "timestamp": "time.timestamp",
    "timezone": "time.timezone",
    "store": "memory.store",
    "save": "memory.store",
    "write": "memory.write",
    "read": "memory.read",
    "get": "memory.read",
    "delete": "memory.delete",
    "clear": "memory.clear",
    "list": "memory.list",
    "send": "payment.send",
    "pay": "payment.send",
    "transfer": "payment.send",
    "request": "payment.request",
    "balance": "payment.balance",
    "history": "payment.history",
    "fetch": "web.request",
    "load": "web.request",
    "search": "web.search",
    "set_timer": "timer.set",
    "timer": "timer.set",
    "set_alarm": "alarm.set",
    "alarm": "alarm.set",
    "message": "message.send",
    "call": "call.start",
    "email": "email.send",
    "notify": "notify.send",
    "status": "system.status",
    "help": "system.help",
    "version": "system.version",
    "weather": "weather.current",
    "navigate": "navigate.to",
    "play": "music.play",
    "pause": "music.pause",
}

# Families and their languages.
FAMILY_LANGUAGES: dict[str, list[str]] = {
    "english": "english spanish french german portuguese italian dutch polish romanian turkish vietnamese indonesian malay tagalog swahili".split(),
    "cjk": "chinese mandarin cantonese japanese korean".split(),
    "arabic": "arabic persian urdu pashto farsi".split(),
    "indic": "hindi bengali tamil telugu marathi gujarati kannada malayalam punjabi nepali sinhala".split(),
    "cyrillic": "russian ukrainian bulgarian serbian macedonian belarusian kazakh".split(),
    "greek": ["greek"],
    "hebrew": "hebrew yiddish".split(),
    "southeast_asian": "thai khmer lao myanmar burmese".split(),
    "ethiopic": "amharic tigrinya geez".split(),
}
FAMILIES = list(FAMILY_LANGUAGES)
LANGUAGE_FAMILY = {lang: family for family, langs in FAMILY_LANGUAGES.items() for lang in langs}
#: The languages a wide row of translations has beside English, and the family of each.
WIDE_LANGUAGES = {x: LANGUAGE_FAMILY[x] for x in "arabic chinese russian amharic greek hebrew hindi thai".split()}
DEFAULT_FAMILY = "english"


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def ops_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OPS.items()), "op string, required array<string>")


def aliases_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, op string")


def families_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGE_FAMILY.items()), "language string, family string")


def family_of(language: Column) -> Column:
    """The family of a language name, english by default."""
    return F.coalesce(literal_map(LANGUAGE_FAMILY)[F.lower(language)], F.lit(DEFAULT_FAMILY))


def resolve_op(op: Column) -> Column:
    """A namespaced op passes; a known alias becomes its op; anything else is null."""
    return F.when(F.contains(op, F.lit(".")), op).otherwise(literal_map(ALIASES)[F.lower(op)])


def missing_fields(rows: DataFrame, op: str, present: Column, registry: DataFrame | None = None, into: str = "missing") -> DataFrame:
    """The required fields of the op that are not present, in their order; [] for an unknown op.

    The registry has a row per op; it is broadcast as the fixed list it is unless a table is given, which is joined."""
    if registry is None:
        required = F.coalesce(F.create_map(*[x for k, v in OPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])[F.col(op)], F.array().cast("array<string>"))
        return rows.withColumn(into, F.array_except(required, present))
    joined = rows.join(registry.select(F.col("op").alias("__op"), "required"), F.col(op) == F.col("__op"), "left")
    return joined.withColumn(into, F.array_except(F.coalesce("required", F.array().cast("array<string>")), present)).drop("__op", "required")
