"""Problem 5: splits that never part related records.

Records that name a common entity, and chains of them, form a component. The component table is persisted and grows with
each batch: merges are resolved by pointer jumping, a component keeps the split it has, new ones fill what the splits
still lack, and a merge of components with different splits is quarantined.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from kordel.common import discard, materialize
from kordel.llm import lookalike

#: Components with more than 1 / LARGE of all rows are placed one by one: there are fewer than LARGE of them.
LARGE, MAX_ROUNDS = 1000, 60
QUARANTINE = "quarantine"
_LATIN = r"[\p{IsLatin}\p{M}]+"
_TOKEN = rf"{_LATIN}|\p{{N}}+|[^\s\p{{Z}}]"


def _looks(c: Column) -> Column:
    """Text as it looks, in lower case; only text outside ASCII goes to Python."""

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lookalike.fold, na_action="ignore").astype(object)

    odd = F.rlike(c, F.lit(r"[^\x{0}-\x{7f}]"))
    return F.lower(F.coalesce(F.when(~odd, c), fold(F.when(odd, c))))


def _tokens(look: Column) -> Column:
    """Runs of Latin letters, runs of digits, and every other visible character by itself."""
    return F.regexp_extract_all(look, F.lit(_TOKEN), 0)


def mentions(rows: DataFrame, id_col: str, text_cols: list[str], entities: DataFrame, name_col: str = "entity_name") -> DataFrame:
    """(id, entity) distinct pairs; entity is the name as it looks, in lower case.

    A name counts where it stands whole, mark for mark, no Latin letter touching; how wide its spaces are does not matter. Runs
    of tokens of the lengths that names have are joined with the names, which are never broadcast: a text gives as many
    keys as it has tokens for each such length, and only keys that begin as some name does. Null texts name nothing."""
    names = entities.select(F.regexp_replace(_looks(F.col(name_col)), r"\s+", " ").alias("entity")).where("entity is not null").distinct()
    toks = _tokens(F.col("entity"))
    names = names.select("entity", F.size(toks).alias("n"), F.array_join(toks, " ").alias("key")).where("n > 0").withColumn("latin", F.rlike("key", F.lit(f"^{_LATIN}")))
    kinds = sorted((r.n, r.latin) for r in names.groupBy("n", "latin").count().collect())  # two a length of name at most
    text = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.col(c) for c in text_cols])).alias("t")).where("t is not null")
    # names of one Latin word each, the common case, need no other tokens
    words_only = kinds == [(1, True)]
    look = _looks(F.col("t"))
    text = text.select("id", (F.regexp_extract_all(look, F.lit(_LATIN), 0) if words_only else _tokens(look)).alias("toks")).where(F.size("toks") > 0)
    held = F.col("toks")

    def runs(k: int) -> Column:
        grams = held if k == 1 else F.transform(F.sequence(F.lit(1), F.greatest(F.size(held) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(held, i, k), " "))
        which = {latin for n, latin in kinds if n == k}
        return grams if len(which) == 2 or words_only else F.filter(grams, lambda g: F.rlike(g, F.lit(f"^{_LATIN}")) == F.lit(True in which))

    lengths = sorted({n for n, _ in kinds})
    if not lengths:
        return text.select("id", F.lit("").alias("entity")).where("false")
    keys = text.select("id", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, lengths))))).alias("key"))
    return keys.join(names.select("key", "entity"), "key").select("id", "entity").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): component is the smallest node reachable. Hooking to the smallest neighbour and pointer jumping
    by turns: the number of rounds grows with the logarithm of the longest chain. Each round is written to the shared
    folder, so no lineage builds up, and only counts reach the driver. Both joins are on nodes; a node with many edges
    is combined before the shuffle, and its label is sent once per edge as any join key, where skew handling applies."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct(), "edges")
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).where("node is not null").distinct()
    label = materialize(nodes.join(both.groupBy("x").agg(F.min("y").alias("m")), F.col("node") == F.col("x"), "left").select("node", F.least("node", "m").alias("component")), "labels")
    last = label
    for _ in range(max_rounds):
        # hook: the root of a node takes the smallest root among the node's neighbours
        l1, l2 = label.select(F.col("node").alias("x"), F.col("component").alias("cx")), label.select(F.col("node").alias("y"), F.col("component").alias("cy"))
        hooks = both.join(l1, "x").join(l2, "y").where("cy < cx").groupBy(F.col("cx").alias("root")).agg(F.min("cy").alias("to"))
        hooked = label.join(hooks, F.col("component") == F.col("root"), "left").select("node", F.coalesce("to", "component").alias("component"), F.col("root").isNotNull().alias("moved"))
        hooked = materialize(hooked, "hooked")
        if not hooked.where("moved").limit(1).count():
            discard(hooked)
            discard(both)
            return label
        discard(last)
        last = hooked
        label = hooked.select("node", "component")
        # jump until every pointer is at its root
        for _ in range(max_rounds):
            up = label.select(F.col("node").alias("p"), F.col("component").alias("pp"))
            jumped = materialize(label.join(up, F.col("component") == F.col("p"), "left").select("node", F.coalesce("pp", "component").alias("component"), (F.coalesce(F.col("pp"), F.col("component")) != F.col("component")).alias("moved")), "jumped")
            discard(last)
            last, label = jumped, jumped.select("node", "component")
            if not jumped.where("moved").limit(1).count():
                break
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fill_deficits(sizes: DataFrame, shares: dict[str, float], have: dict[str, int] | None = None) -> DataFrame:
    """sizes(component, rows) -> (component, split). Large components, fewer than LARGE, are placed one by one where most is
    lacking; all others go by a hash of their name, in proportion to what each split then lacks."""
    have = dict.fromkeys(shares, 0) | (have or {})
    new = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    total = new + sum(have.values())
    lack = {s: shares[s] * total - have[s] for s in sorted(shares)}
    large = sizes.where(F.col("rows") > max(1, total // LARGE)).orderBy(F.desc("rows"), "component").collect()
    placed = []
    for r in large:
        s = max(sorted(lack), key=lambda x: lack[x])
        placed.append((r.component, s))
        lack[s] -= r.rows
    room = {s: max(0.0, v) for s, v in lack.items()}
    mass = sum(room.values()) or 1.0
    if not any(room.values()):
        room, mass = dict(shares), sum(shares.values())
    u = F.pmod(F.xxhash64("component"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pick, upto = None, 0.0
    for s in sorted(room):
        upto += room[s] / mass
        pick = F.when(u < upto, s) if pick is None else pick.when(u < upto, s)
    pick = pick.otherwise(max(sorted(room), key=lambda x: room[x]))
    spark = sizes.sparkSession
    one_by_one = spark.createDataFrame(placed, "component string, chosen string")
    return sizes.join(F.broadcast(one_by_one), "component", "left").select("component", F.coalesce("chosen", pick).alias("split"))


class SplitStore:
    """Persisted tables under a folder: generation-n/{nodes(node, component), splits(component, split, rows), members(id, node)};
    members of a generation are those of its batch, the other two tables are whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, p: str) -> bool:
        return self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))

    def generation(self) -> int:
        n = 0
        while self._exists(f"{self.path}/generation-{n + 1}/done/_SUCCESS"):
            n += 1
        return n

    def tables(self) -> tuple[DataFrame, DataFrame]:
        n = self.generation()
        if not n:
            return self.spark.createDataFrame([], "node string, component string"), self.spark.createDataFrame([], "component string, split string, rows bigint")
        at = f"{self.path}/generation-{n}"
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/splits")

    def members(self) -> DataFrame:
        """(id, component, split) of all rows of all batches, as things stand now. Rows without an entity are components of their
        own."""
        nodes, splits = self.tables()
        rows = self.spark.read.parquet(*[f"{self.path}/generation-{k}/members" for k in range(1, self.generation() + 1)])
        return rows.join(nodes, "node", "left").select("id", F.coalesce("component", "node").alias("component")).join(splits.select("component", "split"), "component")

    def update(self, rows: DataFrame, id_col: str, text_cols: list[str], entities: DataFrame, shares: dict[str, float]) -> DataFrame:
        """Takes a batch in; (id, component, split) of its rows. Only the components that the batch touches are worked on: its
        links are lifted to the components known so far, and what is left of them is merged by pointer jumping."""
        old_nodes, old_splits = self.tables()
        pairs = materialize(mentions(rows, id_col, text_cols, entities), "mentions")
        firsts = pairs.groupBy("id").agg(F.min("entity").alias("first"))
        known = lambda side: old_nodes.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
        links = pairs.join(firsts, "id").select(F.col("first").alias("a"), F.col("entity").alias("b")).distinct()
        links = links.join(known("a"), "a", "left").join(known("b"), "b", "left")
        lifted = links.where("a_in is null or b_in is null or a_in != b_in").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")).distinct()
        moved = components(materialize(lifted, "links"))
        now = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
        fresh = moved.join(old_nodes.select("node"), "node", "left_anti")
        at = f"{self.path}/generation-{self.generation() + 1}"
        old_nodes.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component")).unionByName(fresh.select("node", "component")).write.mode("overwrite").parquet(f"{at}/nodes")
        nodes = self.spark.read.parquet(f"{at}/nodes")
        alone = F.concat(F.lit("\x01"), F.col("id").cast("string"))
        rows.select(F.col(id_col).alias("id")).join(firsts, "id", "left").select("id", F.coalesce("first", alone).alias("node")).write.mode("overwrite").parquet(f"{at}/members")
        mine = self.spark.read.parquet(f"{at}/members")
        member = mine.join(nodes, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
        added = member.groupBy("component").agg(F.count(F.lit(1)).alias("added"))
        # old components by the component they are now part of
        then = old_splits.join(now, "component", "left").select(F.coalesce("now", "component").alias("component"), "split", "rows")
        kept = then.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.sum("rows").alias("rows"))
        state = materialize(
            added.join(kept, "component", "full").select(
                "component", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), QUARANTINE).alias("split"),
                (F.coalesce("added", F.lit(0)) + F.coalesce("rows", F.lit(0))).alias("rows"),
            ), "state",
        )
        have = {r.split: r.n for r in state.where("split is not null").groupBy("split").agg(F.sum("rows").alias("n")).collect()}
        have.pop(QUARANTINE, None)
        placed = fill_deficits(state.where("split is null").select("component", "rows"), shares, have)
        state.join(placed.withColumnRenamed("split", "new"), "component", "left").select("component", F.coalesce("split", "new").alias("split"), "rows").write.mode("overwrite").parquet(f"{at}/splits")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/done")
        for x in (pairs, state):
            discard(x)
        return member.join(self.spark.read.parquet(f"{at}/splits").select("component", "split"), "component")
