"""What the text operators share: tables in the shared folder, ordered buckets, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, an own one on a local master and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="epistrata-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Paths made inside each ``settled`` that is under way, innermost last.
_under_way: list[list[str]] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's interpreter ends or the ``settled`` around it does."""
    path = f"{shared_dir(spark)}/epistrata/{name}-{uuid.uuid4().hex}"
    if _under_way:
        _under_way[-1].append(path)

    def drop():
        try:
            delete(spark, path)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(drop)
    return path


#: Makes Spark delete an execution's shuffle files at its end. Else they stay until the driver's full collections find what refers to them dead.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files. For writes, whose plan nothing executes again; the setting is put back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing of it. Its shuffle files go with the write."""
    path = table_path(df.sparkSession, name)
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``'s rows as a table. The tables written on the way are deleted as soon as it is there, so they don't pile up
    under later operators; nor do the write's shuffle files."""
    path = table_path(spark, name)
    _under_way.append([])
    try:
        df = build()
        schema = df.schema
        with _shuffles_deleted(spark):
            df.write.parquet(path)
    finally:
        for used in _under_way.pop():
            delete(spark, used)
    return spark.read.schema(schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def unused(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that no column has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def bucket_of(key: Column, splits: list) -> Column:
    """Index of the range that ``key`` lies in: the number of ``splits`` (ascending, all long or all double) that are <= key. Null keys: 0.

    A binary search over one array literal, so its cost is the logarithm of the number of ranges."""
    if not splits:
        return F.lit(0)
    arr = F.lit(np.array(splits, dtype="float64" if isinstance(splits[0], float) else "int64"))
    n = F.lit(len(splits))

    def step(acc, power):
        return F.when((acc + power <= n) & (F.get(arr, acc + power - 1) <= key), acc + power).otherwise(acc)

    powers = F.lit(np.array([1 << b for b in range(len(splits).bit_length() - 1, -1, -1)], dtype="int32"))
    return F.coalesce(F.aggregate(powers, F.lit(0), step), F.lit(0))


#: Ranges of an order, at most: their boundaries are what the driver holds and a task's plan carries.
RANGES = 65_536


def key_splits(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 distinct ascending boundaries that cut the rows into ranges of about equal counts; ``key`` is a number.

    The driver gets the boundaries only, RANGES at most."""
    n = max(1, min(n, RANGES))
    if n == 1:
        return []
    q = df.select(F.percentile_approx(F.col(key), [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(q or []))


def n_buckets(rows: int, each: int) -> int:
    return max(1, min(RANGES, -(-rows // each)))
