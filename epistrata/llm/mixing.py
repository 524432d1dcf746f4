"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Sources in code point order take these weights in turn.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Fragments aimed at in a range of the order by virtual finish.
ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """(source, source_size, target) for sized documents.

    ``budget`` (all words, if None) is shared by weight; a target stops at ``max_epochs`` times its source's size
    and the excess is shared anew. In the order of limit over weight, the sources before the first whose
    share stays below its limit are full; that first share is everybody's. One row per source is all the windows see."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.select("*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * max_epochs).cast("double")
    s = ranked.select("source", "source_size", "rank", w.alias("weight"), cap.alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(budget)) if budget is not None else F.sum(F.col("source_size")).over(whole.orderBy("rank")).cast("double")
    s = s.select(
        "*", total.alias("total"),
        F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    s = s.select("*", ((F.col("total") - F.col("full")) / F.col("rest")).alias("share"))
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "share"))).over(whole.orderBy("rank"))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * level["share"], F.col("cap"))).alias("target"))


def schedule(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None, text: str = "text", bucket_hex: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, ``copies`` and ``taken``.

    Every source queues its documents in the order of md5(doc_id), once per epoch. A copy that begins at word c of
    its queue has virtual start c / target and virtual finish (c + size) / target. A copy in service at virtual time 1, when each source has
    had its target, queues in two fragments, before and after the last whole word by then. All fragments are sorted by virtual
    finish in one order (``finishing``), and words are taken until the budget is spent: a source is within a word for each source
    of its target. ``copies`` lists the taken ones as (epoch, vstart, vfinish, served); ``taken`` is the sum of served.

    The running totals of the queues are cut into buckets of hash prefixes (``bucket_hex`` digits, by the number of rows if None): sums per
    bucket first, then running sums within, so that no source gathers in one task. Null texts have no words; null sources are one
    source, the last; rows without doc_id queue by their text; repeated rows are separate documents; an empty table gives an empty
    one. Only doc_id, source and text are used."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col(text), F.lit("")))
    sized = common.written(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), key.alias("k")), "sized")
    if bucket_hex is None:
        bucket_hex = max(3, (sized.count().bit_length() - 14 + 3) // 4)
    sized = sized.withColumn("bucket", F.substring("k", 1, bucket_hex))
    targets = source_targets(sized, weights, max_epochs, budget)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("offset"))
    o, t = offsets.alias("o"), targets.withColumn("sources", F.count("*").over(Window.partitionBy())).alias("t")  # one row per source
    per_bucket = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "bucket", "offset", "source_size", "target", "sources")
    order = Window.partitionBy("source", "bucket").orderBy("k", "doc_id", "size")
    d = sized.select("*", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner")).alias("d")
    p = per_bucket.alias("p")
    d = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))).select(
        "d.doc_id", "d.k", "d.source", "d.size", "source_size", "target", "sources", (F.col("offset") + F.col("inner")).alias("begin"))
    # a row's place in its source's queue names it: begin, and for rows without words k and doc_id, which then take nothing
    d = common.written(d, "queued")
    goal = F.floor("target")

    def fragments(epoch):
        start = F.col("begin") + epoch.cast("long") * F.col("source_size")
        end = start + F.col("size")
        cut = F.least(F.greatest(start, goal), end)
        at = lambda c: F.when(F.col("target") > 0, c / F.col("target"))
        one = lambda a, b: F.struct(epoch.alias("epoch"), at(start).alias("vstart"), at(end).alias("vfinish"), at(b).alias("finish"), (b - a).alias("words"), a.alias("from"))
        # what starts more words after the target than there are sources can't be reached: less than a word for each is left
        return F.filter(F.array(one(start, cut), one(cut, end)), lambda f: (f["words"] > 0) & (f["from"] < goal + F.col("sources")))

    queued = d.select("source", "begin", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), fragments))).alias("f")).select("source", "begin", "f.*")
    spent = budget if budget is not None else (sized.agg(F.sum("size")).first()[0] or 0)
    served = finishing(queued).withColumn("served", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(spent) - F.col("ahead")))).where("served > 0")
    copies = served.groupBy("source", "begin", "epoch").agg(F.min("vstart").alias("vstart"), F.max("vfinish").alias("vfinish"), F.sum("served").alias("served")).groupBy("source", "begin").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "vstart", "vfinish", "served"))).alias("copies"))
    x, c = d.alias("x"), copies.alias("c")
    whole = x.join(c, F.col("x.source").eqNullSafe(F.col("c.source")) & (F.col("x.begin") == F.col("c.begin")) & (F.col("x.size") > 0), "left").select(
        "x.doc_id", "x.source", "x.size", "x.source_size", "x.target", F.coalesce("c.copies", F.array().cast(copies.schema["copies"].dataType)).alias("copies"))
    return whole.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda acc, e: acc + e["served"]))


def finishing(fragments: DataFrame, rows: int = ROWS) -> DataFrame:
    """``fragments`` with ``ahead``: the words of all that come earlier by (finish, source, from), nulls last.

    A global order by ranges of virtual finish: quantiles split them, their words are summed first, then totals run within each."""
    f = common.written(fragments, "fragments")
    splits = [float(x) for x in common.key_splits(f, "finish", common.n_buckets(f.count(), rows))]
    ranged = f.withColumn("range", common.bucket_of(F.col("finish"), splits))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("range").agg(F.sum("words").alias("w")).select("range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "from").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0)))
    return placed.join(F.broadcast(offsets), "range").select(*f.columns, (F.col("offset") + F.col("inner")).alias("ahead"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row (doc_id, source, size, epoch, vfinish, served) per taken copy, range-sorted by virtual finish time."""
    taken = schedule(docs, **options).select("doc_id", "source", "size", F.explode("copies").alias("c"))
    return taken.select("doc_id", "source", "size", "c.epoch", "c.vfinish", "c.served").orderBy("vfinish", "doc_id", "epoch")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs``' own columns, a row per taken copy; a copy served in part has its first ``served`` words, and n_chars (if any) follows.

    Rows of one doc_id and text are alike to the queue, so either may be the one that is served."""
    row, at = common.unused(docs.columns, "_row", "_k")
    d = docs.withColumn(row, F.xxhash64("doc_id", F.col(text)))
    plan = schedule(d.select(F.col(row).alias("doc_id"), "source", F.col(text).alias("text")), **options)
    served = plan.select("doc_id", "source", "size", F.explode("copies").alias("c"))
    # rows alike: the k-th of them takes the k-th share of an epoch
    numbered = d.withColumn(at, F.row_number().over(Window.partitionBy(row, "source").orderBy(row)))
    k = F.row_number().over(Window.partitionBy("doc_id", "source", "c.epoch").orderBy("c.vfinish"))
    n, s = numbered.alias("n"), served.select("doc_id", "source", "size", F.col("c.served").alias("served"), k.alias("k")).alias("s")
    joined = n.join(s, (F.col(f"n.{row}") == F.col("s.doc_id")) & F.col("n.source").eqNullSafe(F.col("s.source")) & (F.col(f"n.{at}") == F.col("s.k")))
    words = F.filter(F.split(F.col(f"n.`{text}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), lambda w: w != "")
    cut = F.when(F.col("s.served") < F.col("s.size"), F.array_join(F.slice(words, 1, F.col("s.served").cast("int")), "")).otherwise(F.col(f"n.`{text}`"))
    out = joined.select(*[cut.alias(c) if c == text else F.col(f"n.`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in docs.columns else out
