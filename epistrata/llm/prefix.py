"""Global order and running totals over rows sorted by a key, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows aimed at in a bucket of the order.
ROWS = 20_000


def in_order(df: DataFrame, key: str, value: str, ties: list[str], ordinal: str = "ordinal", start: str = "start", rows: int = ROWS) -> DataFrame:
    """``df`` with its rank from 0 by (key, ties), nulls first, and the sum of ``value`` over all rows before.

    Ranges of the key (quantiles) are summed first; each row then adds its range's offset to its place within.
    Rows alike in key and ties may take each other's place. ``df`` is read three times: pass a written table."""
    n = df.count()
    splits = common.key_splits(df, key, common.n_buckets(n, rows))
    b = df.withColumn("_bucket", common.bucket_of(F.col(key), splits))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, 4096 at most
    sums = b.groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    offsets = sums.select("_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_sum"))
    within = Window.partitionBy("_bucket").orderBy(key, *ties)
    placed = b.select("*", (F.row_number().over(within) - 1).cast("long").alias("_rn"), F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_in"))
    return placed.join(F.broadcast(offsets), "_bucket").select(
        *[F.col(c) for c in df.columns], (F.col("_rows") + F.col("_rn")).alias(ordinal), (F.col("_sum") + F.col("_in")).cast("long").alias(start))
