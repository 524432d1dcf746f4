"""Packing documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import parts as parts_of
from .tokens import encoder

LENGTH = 1024
#: Pieces packed together by one task. Each such group leaves at most a few sequences unfilled.
GROUP = 100_000


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the order given.

    Of the open bins that an item fits, it goes where the sum of the squared counts of open bins per gap becomes
    smallest; ties: the smallest gap left. A bin is opened only when none fits: with a finite list, bins opened to
    lower the sum would stay half empty."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    far = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # From gap g to g - s the sum grows by 2 (count[g - s] - count[g] + 1); where the bin is full, by 1 - 2 count[g].
        growth, least = 2 * (count[: capacity - s] - count[s:capacity] + 1), far
        if len(growth):
            growth[0] = 1 - 2 * count[s]
            growth[count[s:capacity] == 0] = far
            best = int(growth.argmin())
            least = growth[best]
        if least == far:
            b, gap = len(used), capacity
            used.append(0)
        else:
            gap = best + s
            b = stacks[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, used[b]
        used[b] += s
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def descending(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``sum_of_squares`` over the items from the longest to the shortest, in their own order."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    where[order], offset[order] = sum_of_squares(lengths[order], capacity)
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, keep_ids: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of every whole text (null: empty) and its end id.

    Longer documents are cut from the end, so that the first piece may be shorter. ``row`` tells repeated doc_ids apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for part in parts_of(b, 1):
                out = []
                for d, raw in zip(part.column(0).to_pylist(), enc.encode_all([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    n, at, p = len(raw) // 4, 0, 0
                    while at < n:
                        to = at + ((n - at) % length or length)
                        x = raw[4 * at : 4 * to]
                        out.append((d, p, at, to - at, zlib.crc32(x), x if keep_ids else None))
                        at, p = to, p + 1
                cols = list(zip(*out))
                types = [part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                pa.default_memory_pool().release_unused()  # else a worker keeps what its largest part took

    out = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``parts`` with sequence_id and offset: pieces of 1 to ``length`` tokens in as few sequences as found.

    Full pieces are sequences of their own. The rest is dealt by hash, whatever its document or source, into groups
    of about ``group`` pieces, packed each by the sum-of-squares rule in one task that holds lengths and places
    only. Reruns agree but for the numbers of full pieces. ``parts`` is read twice: pass a written table. Empty in, empty out."""
    n = parts.where(F.col("length") < length).count()
    groups = max(1, round(n / group))
    names, (group_of,) = parts.columns, common.unused(parts.columns, "_group")
    keyed = parts.withColumn(group_of, F.when(F.col("length") == length, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))).cast("long"))
    full = keyed.where(F.col(group_of) < 0).drop(group_of).select("*", (F.lit(1 << 62).bitwiseOR(F.monotonically_increasing_id())).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(table: pa.Table) -> pa.Table:
        # 'doc_id, start, crc' order makes reruns agree, whatever order the rows came in
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        where, offset = descending(lengths, length)
        g = table.column(group_of)[0].as_py()
        out = table.drop_columns([group_of]).append_column("sequence_id", pa.array((np.int64(g) << 32) + where))
        return out.append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    rest = keyed.where(F.col(group_of) >= 0).groupBy(group_of).applyInArrow(run, schema + ", sequence_id long, offset long")
    return full.select(*names, "sequence_id", "offset").union(rest.select(*names, "sequence_id", "offset"))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their sequence and offset; see ``pieces`` and ``pack``."""
    return pack(common.written(pieces(docs, tokenizer, end_id, length), "pieces"), length)
