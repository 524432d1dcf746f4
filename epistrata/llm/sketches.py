"""Bottom-k sketches of word shingles, in DataFrame functions alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hashes kept. The standard error of a likeness j is about sqrt(j (1 - j) / K).
K = 128
WIDTH = 5
#: Hashes are cut to this many bits, from 0 up, so ten hexadecimal digits write one.
BITS = 40


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value worked out once: transform over an array of one binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct hashes of a text's shingles of ``width`` words (A-Z lowered), ascending.

    Fewer words: the whole sequence is the one shingle; no words or null: an empty sketch."""
    joined = F.trim(F.regexp_replace(common.lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))

    def hashes(w):
        last = F.greatest(F.size(w) - width, F.lit(0))
        return F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.shiftrightunsigned(F.xxhash64(F.array_join(F.slice(w, i, width), " ")), 64 - BITS))

    def smallest(j):
        found = F.slice(F.array_sort(F.array_distinct(_let(F.split(j, " ", -1), hashes))), 1, k)
        return F.when(j == "", F.array().cast("array<bigint>")).otherwise(found)

    return _let(joined, smallest)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both have. Two empty sketches: 1; null if one is null."""
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of its range."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(s, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too; null if a is empty."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def as_string(s: Column) -> Column:
    """Ten lower-case hexadecimal digits per hash, ascending."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def with_next(docs: DataFrame, columns: list[str], each: int = 2000) -> DataFrame:
    """``docs`` (doc_id, a number, and more) with ``next``: a struct of ``columns`` of the row next in ascending doc_id order (nulls first),
    after the last the first; rows of one doc_id by the other columns. A column called ``next`` gives way.

    Ranges of doc_id are ordered each by itself; the first row of a range is sent to the range before it as well. Of the ranges only
    their first ids reach the driver."""
    names = [c for c in docs.columns if c != "next"]
    here, sent_to, own = common.unused(docs.columns, "_b", "_s", "_own")
    n = docs.count()
    splits = common.key_splits(docs, "doc_id", common.n_buckets(n, each))
    b = docs.select(*[F.col(f"`{c}`") for c in names], common.bucket_of(F.col("doc_id"), splits).alias(here))
    ids = b.groupBy(here).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null_first")).orderBy(here).collect()  # one row per range
    if not ids:
        return docs.select(*names, F.lit(None).cast(f"struct<{','.join(f'{c}:{docs.schema[c].dataType.simpleString()}' for c in columns)}>").alias("next"))
    order = [r[here] for r in ids]
    lead = F.lit(np.array([order[i - 1] for i in range(len(order))], dtype="int32"))  # the range before; the first's is the last
    firsts = F.lit(np.array([r["first"] or 0 for r in ids], dtype="int64"))
    place = common.bucket_of(F.col(here), order) - 1
    is_first = F.col("doc_id") == F.get(firsts, place)
    if ids[0]["null_first"]:  # nulls lie in the first range
        is_first = F.when(F.col(here) == order[0], F.col("doc_id").isNull()).otherwise(is_first)
    # a copy of each range's first rows goes to the end of the range before
    to = lambda c, is_own: F.struct(c.alias("b"), F.lit(is_own).alias("own"))
    mine, other = to(F.col(here), 1), to(F.get(lead, place), 0)
    rows = b.select(*names, F.explode(F.when(is_first, F.array(mine, other)).otherwise(F.array(mine))).alias(sent_to)).select(*names, F.col(f"{sent_to}.b").alias(here), F.col(f"{sent_to}.own").alias(own))
    w = Window.partitionBy(here).orderBy(F.col(own).desc(), F.col("doc_id").asc_nulls_first(), *[c for c in columns if c != "doc_id"])
    return rows.select(*names, own, F.lead(F.struct(*columns)).over(w).alias("next")).where(F.col(own) == 1).drop(own)


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """``text`` whose last floor(n_chars / 4) code points are replaced by the first as many, or all, of ``following``."""
    cut = F.floor(n_chars / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), (n_chars - cut).cast("int")), F.substr(following, F.lit(1), cut))
