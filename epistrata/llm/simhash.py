"""SimHash fingerprints and near-duplicate classes by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Fingerprints this many bits apart still link: with two segments, one of them then differs by at most one bit.
MAX_BITS = 3
SEED = 42
#: Members of a bucket that are compared in one numpy step.
BLOCK = 1 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 if it has no words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(width)))]
    votes = np.zeros(64, dtype=np.int64)
    a = np.array(hashes, dtype="<u8")
    for i in range(0, len(a), 4096):
        votes += np.unpackbits(a[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the SimHash as a signed long. Null texts have no words."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _spread(members: np.ndarray, edges: list) -> None:
    """Appends edges that connect what a chain of near fingerprints connects: breadth first over the members not reached yet."""
    left = members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.concatenate([np.bitwise_count(left[i : i + BLOCK] ^ at) <= MAX_BITS for i in range(0, len(left), BLOCK)])
            if near.any():
                found, left = left[near], left[~near]
                edges.append(np.stack([np.full(len(found), at, dtype=np.uint64), found]))
                queue.extend(found)


def _linked(batches):
    """Edges between the fingerprints of each bucket. Rows come sorted by (key, fp); only a bucket's 8-byte members are held."""

    def flush(keys, fps):
        edges: list = []
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.r_[start, len(keys)])
        small = np.repeat(length <= 32, length) & np.repeat(length > 1, length)
        k, f = keys[small], fps[small]
        for lag in range(1, min(32, len(k))):
            same = k[lag:] == k[:-lag]
            if not same.any():
                break
            x, y = f[lag:][same], f[:-lag][same]
            near = np.bitwise_count(x ^ y) <= MAX_BITS
            if near.any():
                edges.append(np.stack([x[near], y[near]]))
        for s, n in zip(start[length > 32], length[length > 32]):
            bit = (int(keys[s]) >> 32) % 64
            members = fps[s : s + n]
            # A pair equal in the whole segment shares all its variants; that of bit 0 links it.
            side = (members >> np.uint64(bit)) & np.uint64(1)
            if bit % 32 == 0 or (side.any() and not side.all()):
                _spread(members, edges)
        if edges:
            e = np.unique(np.concatenate(edges, axis=1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])

    keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.concatenate([keys, b.column(0).to_numpy()])
        fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if cut:
            yield from flush(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield from flush(keys, fps)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most three bits apart, enough of them to connect every chain.

    A fingerprint has two 32-bit segments, each indexed under its 32 one-wildcard variants; fingerprints that
    differ by three bits or fewer agree in a segment but for one bit, so they meet under an equal key, where the
    whole distance is verified."""
    variant = F.expr(
        "transform(sequence(0, 63), k -> shiftleft(cast(k as bigint), 32) | "
        "(if(k < 32, fp & 4294967295L, shiftrightunsigned(fp, 32)) & ~shiftleft(1L, k % 32)))")
    return (
        fps.select("fp").distinct().select(F.explode(variant).alias("key"), "fp")
        .repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(_linked, "a long, b long").distinct())


def classes(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that a chain of links reaches.

    Texts without words have fingerprint zero and link like any other; rows with a null doc_id keep it and take
    their class's smallest id; repeated rows come back repeated; other columns are not looked at."""
    d = common.written(fingerprints(docs, width, text), "fingerprints")
    least = d.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = connected_components(links(d)).select(F.col("node").alias("fp"), "component")
    of = least.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    root = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return d.join(of.join(root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
