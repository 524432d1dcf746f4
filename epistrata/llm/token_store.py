"""Token ids in a content-addressed store.

File format, all Parquet under one folder:

``chunks``     (digest, ids): every distinct chunk once. ids: little-endian unsigned 16-bit integers where the
               vocabulary allows, else 32-bit; digest: BLAKE2b of 16 bytes over them.
``recipes``    (ordinal, doc_id, start, n_tokens, digests, root): one row per document in ascending doc_id order;
               its chunks in turn and the Merkle root over their digests.
``manifests``  (part, first, documents, tokens, width, root): one row per PART documents: bytes of an id, and the Merkle root over
               the documents' roots.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .prefix import in_order
from .tokens import BLOCK, encoder

#: A cut where the rolling hash of the last WINDOW ids ends in MASK zero bits, so about every 512 ids.
WINDOW, MASK, LEAST, MOST = 16, (1 << 9) - 1, 64, 4096
MULTIPLIER = 0x9E3779B97F4A7C15
#: Pieces that a worker's encoder keeps in each of two generations. A task holds chunks and recipes beside them, and an executor runs several.
KEPT = 400_000
#: Ids that are hashed at a time, few enough for a core's cache.
SLAB = 16_384
#: Documents of one manifest.
PART = 4096


def _marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows after which a chunk may end, ascending."""
    found = []
    for begin in range(0, len(ids) - WINDOW + 1, SLAB):
        # Rolling hash of the window that ends at each id: a polynomial in an odd multiplier modulo 2^64, by doubling.
        h, size = ids[begin : begin + SLAB + WINDOW - 1].astype(np.uint64), 1
        h += np.uint64(1)
        while size < WINDOW:
            h = h[:-size] * np.uint64(pow(MULTIPLIER, size, 1 << 64)) + h[size:]
            size *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(20)
        h &= np.uint64(MASK)
        found.append(np.flatnonzero(h == 0) + (begin + WINDOW))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _ends(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids with such marks."""
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST and n - m >= 1:
            last = m
            ends.append(m)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. They depend on nearby content only, so equal passages get equal chunks."""
    return _ends(_marks(ids).tolist(), len(ids))


def cuts_of_all(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """``cuts`` of each stream of those that stand in ``ids`` in turn; ``bounds``: 0 and where each ends."""
    marks = _marks(ids)
    # A stream's own windows end WINDOW ids after its begin at the earliest.
    lows, highs = np.searchsorted(marks, bounds[:-1] + WINDOW).tolist(), np.searchsorted(marks, bounds[1:], "right").tolist()
    return [_ends((marks[x:y] - begin).tolist() if x < y else [], end - begin) for x, y, begin, end in zip(lows, highs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over the leaves; an odd node goes up as it is; without leaves, the digest of nothing."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def parts(batch: pa.RecordBatch, text_at: int):
    """The batch's rows in turn, as many at a time as have BLOCK bytes of text, or one."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(), dtype=np.int64)
    begin, done = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, done + BLOCK, "right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(sizes[end - 1])


def _lists(counts: list[int], values: pa.Array) -> pa.Array:
    """``values`` as lists of so many."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts, dtype=np.int64)), pa.int32()), values)


def _encode(path: str, end_id: int, dtype: str, text_at: int):
    def run(batches):
        enc, seen, ended = encoder(path, KEPT), set(), np.array([end_id], dtype="<u4").tobytes()
        width = int(dtype[2])
        for b in batches:
            for part in parts(b, text_at):
                raws = enc.encode_all([t or "" for t in part.column(text_at).to_pylist()])
                counts = np.array([len(r) // 4 + 1 for r in raws], dtype=np.int64)
                bounds = np.append(0, np.cumsum(counts))
                ids = np.frombuffer(b"".join([x for r in raws for x in (r, ended)]), dtype="<u4").astype(dtype)
                held = ids.tobytes()
                names, n_names, new, chunks, fresh, roots = [], [], [], [], [], []
                for begin, ends in zip(bounds.tolist(), cuts_of_all(ids, bounds), strict=False):
                    mine, before, at = [], len(new), width * begin
                    for end in ends:
                        end = width * (begin + end)
                        piece = held[at:end]
                        d = digest(piece)
                        mine.append(d)
                        if d not in seen:  # what this task has already handed on needn't be sent again
                            if len(seen) < 1_000_000:
                                seen.add(d)
                            new.append(d)
                            chunks.append(piece)
                        at = end
                    names += mine
                    n_names.append(len(mine))
                    fresh.append(len(new) - before)
                    roots.append(merkle_root(mine))
                blobs = pa.StructArray.from_arrays([pa.array(new, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "ids"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), _lists(n_names, pa.array(names, pa.binary())), pa.array(roots, pa.binary()), _lists(fresh, blobs)],
                    names=["doc_id", "n_tokens", "digests", "root", "new"])

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, text: str = "text") -> None:
    """Encodes whole texts (null: empty) and writes the store to ``folder``, in the shared file system.

    Each document is its ids and ``end_id``. Repeated rows are documents of their own, in any order among
    themselves; null doc_ids come first. A written first table keeps what was encoded, so that nothing is encoded
    twice even if executors are lost."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab_size()
    dtype = "<u2" if max(vocabulary, end_id) < 1 << 16 else "<u4"
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = common.table_path(docs.sparkSession, "encoded")
    docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        _encode(tokenizer, end_id, dtype, 1),
        f"doc_id {kind}, n_tokens long, digests array<binary>, root binary, new array<struct<digest: binary, ids: binary>>").write.option("compression", "zstd").parquet(raw)
    spark = docs.sparkSession
    encoded = spark.read.parquet(raw)
    encoded.select(F.explode("new").alias("c")).select("c.digest", "c.ids").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = in_order(encoded.select("doc_id", "n_tokens", "digests", "root"), "doc_id", "n_tokens", ["root"])
    recipes.select("ordinal", "doc_id", "start", "n_tokens", "digests", "root").repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(f"{folder}/recipes")
    rooted(spark.read.parquet(f"{folder}/recipes")).withColumn("width", F.lit(int(dtype[2]))).write.parquet(f"{folder}/manifests")
    common.delete(spark, raw)


def rooted(recipes: DataFrame) -> DataFrame:
    """(part, first, documents, tokens, root) of recipes: what their manifests should be. A task has one part's roots, PART at most."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        root = merkle_root(table.column("root").to_pylist())
        return pa.table({
            "part": table.column("part").slice(0, 1), "first": table.column("ordinal").slice(0, 1), "documents": pa.array([table.num_rows], pa.int64()),
            "tokens": pa.array([pc.sum(table.column("n_tokens")).as_py()], pa.int64()), "root": pa.array([root], pa.binary())})

    r = recipes.select((F.col("ordinal") / PART).cast("long").alias("part"), "ordinal", "n_tokens", "root")
    return r.groupBy("part").applyInArrow(run, "part long, first long, documents long, tokens long, root binary")


def checked_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, width, whole): a row per part of the manifests or the recipes; whole if both have it and agree."""
    m, r = spark.read.parquet(f"{folder}/manifests").alias("m"), rooted(spark.read.parquet(f"{folder}/recipes")).alias("r")
    same = F.lit(True)
    for c in ("first", "documents", "tokens", "root"):
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}"))
    return m.join(r, F.col("m.part") == F.col("r.part"), "full").select(F.coalesce("m.part", "r.part").alias("part"), "m.width", same.alias("whole"))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(ordinal, doc_id, start, n_tokens, ids, verified) from the files: ids as 32-bit little-endian bytes.

    ``verified``: every chunk is there and has its digest, the chunks in turn have the document's Merkle root and length, and the
    document's part has the root that its manifest tells. A document whose chunks are lost or whose part has no manifest comes
    back unverified, its ids null if they can't be put together; recipes lost whole show in ``checked_parts``."""
    chunks, recipes = spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/recipes")
    want = recipes.select("ordinal", F.posexplode("digests").alias("at", "digest"))
    found = want.join(chunks, "digest", "left").groupBy("ordinal").agg(F.collect_list(F.struct("at", "digest", "ids")).alias("parts"))
    head = recipes.select("ordinal", "doc_id", "start", "n_tokens", "root", (F.col("ordinal") / PART).cast("long").alias("part"))
    head = head.join(checked_parts(spark, folder), "part", "left").drop("part")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                blobs, right = [], []
                for n, root, width, whole, parts in zip(*(part.column(c).to_pylist() for c in ("n_tokens", "root", "width", "whole", "parts"))):
                    parts = sorted(parts or [], key=lambda p: p["at"])
                    there = width and all(p["ids"] is not None for p in parts)
                    raw = b"".join([p["ids"] for p in parts]) if there else b""
                    there = there and len(raw) == width * n
                    blobs.append(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes() if there else None)
                    right.append(bool(there and whole and all(digest(p["ids"]) == p["digest"] for p in parts) and merkle_root([p["digest"] for p in parts]) == root))
                yield pa.RecordBatch.from_arrays(
                    [part.column("ordinal"), part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(blobs, pa.binary()), pa.array(right)],
                    names=["ordinal", "doc_id", "start", "n_tokens", "ids", "verified"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return head.join(found, "ordinal", "left").mapInArrow(run, f"ordinal long, doc_id {kind}, start long, n_tokens long, ids binary, verified boolean")


def crc32_of(raw: bytes | None) -> int | None:
    return None if raw is None else zlib.crc32(raw)
