"""Sharding by sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Ranges cut per shard at least, rows that a range is to have at most, and key samples drawn per range.
RANGES, ROWS, DRAWS = 256, 200_000, 8
#: Rows alike that are told apart by one task.
ALIKE = 4096


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def told_apart(alike: DataFrame) -> DataFrame:
    """A row per copy of each row of ``alike`` (with ``n``, its copies), numbered from 0 in ``copy``. Many copies are dealt out in blocks."""
    columns = [c for c in alike.columns if c != "n"]
    few = alike.where(F.col("n") <= ALIKE).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    blocks = alike.where(F.col("n") > ALIKE).select(*columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long"))).alias("from"))
    dealt = blocks.repartition(F.xxhash64(*columns, "from"))
    many = dealt.select(*columns, F.explode(F.sequence(F.col("from"), F.least(F.col("from") + ALIKE, F.col("n")) - 1)).alias("copy"))
    return few.union(many)


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", ranges: int = RANGES, rows: int = ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): sizes near equal, each shard one run of the key order.

    The key is a hash of the text, so equal texts lie together and share a shard unless their range is overfull.
    Samples are drawn by a hash of the row, in proportion to its size; their quantiles are the splitters (``shards *
    ranges - 1``, more where ranges would have over ``rows`` rows). The ranges' exact sizes are then counted; a range larger than twice
    the aim (a group of copies, say) is subdivided by a second hash, of doc_id and, among rows alike in everything, of the copy's
    number. Consecutive ranges fill the shards in turn, each range going where its middle falls. Slots count from 0 within a
    shard, by range and then by row within it, so no task sees a whole shard.

    Null texts have size 1 and the crc32 of nothing; repeated rows are separate rows, alike to one another; null doc_ids are ids like
    others; an empty table gives an empty one; only doc_id and text are read. Splitters and samples, not rows, reach the driver."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select("doc_id", size_of(F.col(text)).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key"))
    alike = common.written(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n")), "shard_rows")
    whole = alike.agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).first()
    total = whole["size"] or 0
    n = max(shards * ranges, min(common.RANGES, -(-(whole["n"] or 0) // rows)))
    # Each distinct row stands for size * n * rate samples, rounded by its hash: about n * DRAWS in all.
    uniform = F.pmod(F.xxhash64("doc_id", "key", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    draws = F.floor(F.col("size") * F.col("n") * (n * DRAWS / max(total, 1)) + uniform)
    weighed = alike.select("key", draws.alias("draws")).where("draws > 0").groupBy("key").agg(F.sum("draws").alias("draws"))
    samples = sorted((r["key"], r["draws"]) for r in weighed.collect())  # at most 2 * n * DRAWS keys in expectation
    splits, seen, aim = [], 0, max(1.0, sum(d for _, d in samples) / n)
    for key, d in samples:
        if seen and int(seen / aim) < int((seen + d) / aim):
            splits.append(key)
        seen += d
    target = max(1.0, total / n)
    ranged = alike.withColumn("range", common.bucket_of(F.col("key"), sorted(set(splits))))
    # ways: how often an overfull range is cut again; a row per range, so the table is small whatever the input
    ways = ranged.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("s")).select(
        "range", F.when(F.col("s") > 2 * target, F.least(F.lit(4 * n), F.floor(F.col("s") / target) + 1)).otherwise(F.lit(1)).alias("ways"))
    cut = told_apart(ranged).join(F.broadcast(ways), "range").withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", F.lit(7)), F.col("ways")).cast("int"))
    runs = cut.groupBy("range", "part").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range or part of one
    middle = F.coalesce(F.sum("s").over(before), F.lit(0)) + F.col("s") / 2
    placed = runs.select("range", "part", "n", F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(total, 1)))).cast("int").alias("shard"))
    within_shard = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("range", "part", "shard", F.coalesce(F.sum("n").over(within_shard), F.lit(0)).alias("first"))
    row = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32", "copy")) - 1
    return cut.withColumn("row", row).join(placed, ["range", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("row")).cast("long").alias("slot"))
