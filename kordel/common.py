"""Helpers that every operator shares: table access, durable cuts of the lineage, regex classes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Letters, combining marks and digits, as the body of a Java character class.
LMN = r"\p{L}\p{M}\p{N}"
#: Whitespace as Python's str.strip sees it, as the body of a Java character class.
WS = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"

_written: list[tuple[SparkSession, str]] = []
_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; on a cluster
    that folder would be another one on each executor and what is read back incomplete, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="kordel-")
    return _own_dir[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{shared_dir(spark)}/kordel/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kordel_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        if path.startswith("file://") and os.path.isdir(path[7:]):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame of materialize(), which is needed no more; of any other DataFrame nothing."""
    path = getattr(df, "_kordel_path", None) if "_kordel_path" in df.__dict__ else None
    for s, p in [x for x in _written if x[1] == path]:
        _delete(s, p)
        _written.remove((s, p))


def release(spark: SparkSession | None = None) -> None:
    """Deletes what materialize has written; call it once no DataFrame made from it is needed any more."""
    for s, path in [x for x in _written if spark is None or x[0] is spark]:
        _delete(s, path)
        _written.remove((s, path))


atexit.register(release)


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """df with at least one partition a core, for Python work over few, dense files. Nothing moves where the scan already has as
    many splits, nor where Catalyst's estimate of the data is above most_bytes: few but large splits are then left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= most_bytes else df


#: Hash values of rows are compared with a share of so many.
_HASHES = 1 << 62


def bounded_sample(df: DataFrame, key: list[str], rows: int, of: int | None = None) -> DataFrame:
    """About `rows` rows of df, and never more than twice as many, so that the result may go to the driver. Drawn by a hash of
    the key columns, which should identify the row: copies of one text are then drawn one by one, and a text in half the
    rows is half the sample. of: the number of rows of df, counted if not given. Where `rows` are no fewer, all of df."""
    n = df.count() if of is None else of
    if n <= rows:
        return df
    drawn = df.where(F.pmod(F.xxhash64(*key), F.lit(_HASHES)) < max(1, rows * _HASHES // n))
    return drawn.limit(2 * rows)


def strip_ws(c: Column) -> Column:
    """str.strip of Python: trim() of Spark takes spaces only."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def norm_key(c: Column) -> Column:
    """The comparison key of the engine: lower case, whitespace cut at both ends."""
    return F.lower(strip_ws(c))


def blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(F.length(strip_ws(c)) == 0, F.lit(True))
