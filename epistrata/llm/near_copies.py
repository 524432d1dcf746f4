"""Near-copies at a Jaccard similarity of 0.8 over five-word shingles, found by a wide SimHash's deletion variants.

At that similarity 64 bits differ in about ten places, too many for segments that differ by one bit at most. So the
fingerprint has 4096 bits in 170 segments. A document indexes the segments whose bits are the most certain, each as it is
and under a wildcard at each of its least certain bits: where two near-copies differ, both are uncertain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

WIDTH, LIKENESS = 5, 0.8
SIDE = 64
BITS = SIDE * SIDE
SEGMENT = 24
SEGMENTS = BITS // SEGMENT
#: Segments that a document indexes, and wildcards of each.
INDEXED, WILD = 48, 3
#: Bits that estimate a likeness (its standard error at 0.8 is 0.02), and how far below 0.8 an estimate still gets an exact check.
SKETCH, SLACK = 2048, 0.1
#: Low bits of an indexed key: a short fingerprint that spares most chance meetings the estimate.
SHORT, SHORT_BITS = 27, 10
#: Members up to which the pairs of a bucket are listed; larger ones are crowds, whose members are compared block against block.
CROWD, BLOCK = 8, 4096
#: Shingles that a block of texts holds on average, at most.
HELD = 2_000_000
WEIGHTS = (0.9, 0.7, 0.6, 0.4)
_order = np.random.default_rng(2024).permutation(BITS)
_walsh = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(SIDE)] for i in range(SIDE)], dtype=np.float32)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; fewer words: the whole; no words: none."""
    h = xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return np.array([h(b" ".join(words))] if words else [], dtype=np.uint64)
    return np.unique(np.array([h(b" ".join(t)) for t in zip(*(words[i:] for i in range(WIDTH)))], dtype=np.uint64))


def votes(sets: list[np.ndarray]) -> np.ndarray:
    """Sums of the shingles' votes for each bit. A shingle votes a weighted sum of four signed Walsh functions, so all are added up before one transform."""
    x = np.zeros((len(sets), BITS), dtype=np.float32)
    for i, s in enumerate(sets):
        parts = [s >> np.uint64(16 * r) for r in range(len(WEIGHTS))]
        at = np.concatenate([p & np.uint64(BITS - 1) for p in parts]).astype(np.int64)
        signed = np.concatenate([np.where(p & np.uint64(BITS), w, -w) for p, w in zip(parts, WEIGHTS)])
        x[i] = np.bincount(at, weights=signed, minlength=BITS)
    return (_walsh @ x.reshape(-1, SIDE, SIDE) @ _walsh).reshape(-1, BITS)[:, _order]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, keys) of sets of shingles: uint64 arrays of SKETCH // 64 and INDEXED * (WILD + 1) columns."""
    v = votes(sets)
    sketch = np.ascontiguousarray(np.packbits(v[:, :SKETCH] > 0, axis=1, bitorder="little")).view("<u8")
    s = v[:, : SEGMENTS * SEGMENT].reshape(-1, SEGMENTS, SEGMENT)
    value = ((s > 0).astype(np.float32) @ (2.0 ** np.arange(SEGMENT)).astype(np.float32)).astype(np.uint64)
    margin = np.abs(s) / np.sqrt(np.maximum(1, [len(x) for x in sets]), dtype=np.float32)[:, None, None]
    low = np.argpartition(margin, 6, axis=2)[:, :, :7]
    least = np.take_along_axis(margin, low, 2)
    order = np.argsort(least, axis=2)
    steady = np.log1p(np.take_along_axis(least, order[:, :, 1:], 2)).sum(axis=2)
    top = np.argpartition(-steady, INDEXED - 1, axis=1)[:, :INDEXED].astype(np.uint64)
    wild = np.take_along_axis(low, order[:, :, :WILD], 2)
    value = np.take_along_axis(value, top.astype(np.int64), 1)
    wild = np.take_along_axis(wild, top.astype(np.int64)[:, :, None], 1).astype(np.uint64)
    none = np.full_like(top, SEGMENT)[:, :, None]
    place = np.concatenate([none, wild], axis=2)
    kept = value[:, :, None] & ~(np.uint64(1) << place)
    key = ((top[:, :, None] << np.uint64(5) | place) << np.uint64(SEGMENT)) | kept
    key = key << np.uint64(SHORT) | (sketch[:, :1, None] & np.uint64((1 << SHORT) - 1))
    return sketch, key.reshape(len(sets), -1)


def estimated(differing, n_a, n_b):
    """Jaccard similarity that a number of differing sketch bits stands for, between sets of n_a and n_b shingles."""
    both = np.cos(np.pi * differing / SKETCH) * np.sqrt(n_a * n_b)
    return both / (n_a + n_b - both)


def _signed(batches):
    seen = set()
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            ids, ns, new, sets = [], [], [], []
            for t in part.column(2):
                words = (t.as_py() or "").encode().lower().split()
                i = xxhash.xxh3_64_intdigest(b" ".join(words)) if words else 0
                ids.append(i)
                fresh = bool(words) and i not in seen  # what this task has handed on needn't be sent again
                if fresh and len(seen) < 1_000_000:
                    seen.add(i)
                new.append(fresh)
                sets.append(shingles(words) if fresh else None)
                ns.append(len(sets[-1]) if fresh else None)
            fresh = [s for s in sets if s is not None]
            sketch, keys = signatures(fresh) if fresh else (np.zeros((0, 1), np.uint64),) * 2
            sketch, keys = iter([x.tobytes() for x in sketch]), iter(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(ns, pa.int64()),
                 pa.array([next(sketch) if f else None for f in new], pa.binary()), pa.array([next(keys) if f else None for f in new], pa.list_(pa.int64()))],
                names=["row", "doc_id", "id", "n", "sketch", "keys"])


def _met(batches):
    """Rows (key, id) sorted by bucket become (key, a, b): candidate pairs with a null key, members of crowds with a null b."""

    def flush(keys, ids):
        bucket = keys >> np.uint64(SHORT)
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        length = np.diff(np.r_[start, len(keys)])
        size = np.repeat(length, length)
        few = (size > 1) & (size <= CROWD)
        k, i, g, found = keys[few], ids[few], bucket[few], []
        for lag in range(1, min(CROWD, len(k))):
            same = np.flatnonzero(g[lag:] == g[:-lag])
            if not len(same):
                break
            apart = np.bitwise_count((k[same] ^ k[same + lag]) & np.uint64((1 << SHORT) - 1))
            same = same[apart <= SHORT_BITS]
            found.append(np.sort(np.stack([i[same], i[same + lag]]), axis=0))
        if found:
            e = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(e.shape[1], pa.int64()), pa.array(e[0]), pa.array(e[1])], names=["key", "a", "b"])
        many = size > CROWD
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(bucket[many].view(np.int64)), pa.array(ids[many]), pa.nulls(int(many.sum()), pa.int64())], names=["key", "a", "b"])

    keys, ids = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.concatenate([keys, b.column(0).to_numpy().view(np.uint64)])
        ids = np.concatenate([ids, b.column(1).to_numpy()])
        bucket = keys >> np.uint64(SHORT)
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
        if cut:
            yield from flush(keys[:cut], ids[:cut])
            keys, ids = keys[cut:], ids[cut:]
    if len(keys):
        yield from flush(keys, ids)


def _weighed(batches):
    """Candidate pairs with the estimate of their likeness, if it isn't too low."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u8").reshape(b.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            like = estimated(np.bitwise_count(x ^ y).sum(axis=1), b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(like)], names=["a", "b", "likeness"]).filter(pa.array(like >= LIKENESS - SLACK))


def _spread(ids, like) -> pa.Table:
    """Edges that connect what ``like(at, left)`` connects among the members: breadth first over those not reached yet."""
    left, edges = np.arange(len(ids)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = like(at, left)
            found, left = left[near], left[~near]
            edges += [(ids[at], ids[i]) for i in found]
            queue.extend(found)
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _members(table: pa.Table):
    """(table, ids, n, sketches) of a block pair's members, ascending by id."""
    table = table.sort_by("id")
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u8").reshape(table.num_rows, -1)
    return table, table.column("id").to_numpy(), table.column("n").to_numpy().astype(float), sketch


def _estimates(sketch, n, at, left):
    return estimated(np.bitwise_count(sketch[left] ^ sketch[at]).sum(axis=1), n[left], n[at])


def _crowd(table: pa.Table) -> pa.Table:
    """Edges that connect what may be alike among the members of a crowd's block pair: the estimate isn't too low."""
    _, ids, n, sketch = _members(table)
    return _spread(ids, lambda at, left: _estimates(sketch, n, at, left) >= LIKENESS - SLACK)


def _alike(table: pa.Table) -> pa.Table:
    """Edges that connect what is alike among the texts of a block pair. Where the estimate is in doubt, the exact likeness decides."""
    table, ids, n, sketch = _members(table)
    sets = [shingles(t.as_py().encode().lower().split()) for t in table.column("text")]
    ends = np.cumsum([len(s) for s in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(flat.astype(np.int32), ends[:-1])
    held = np.zeros(len(distinct), dtype=bool)

    def like(at, left):
        estimate = _estimates(sketch, n, at, left)
        near = estimate >= LIKENESS + SLACK
        doubtful = np.flatnonzero((estimate >= LIKENESS - SLACK) & ~near)
        if len(doubtful):
            some = [sets[i] for i in left[doubtful]]
            sizes = np.array([len(s) for s in some])
            held[sets[at]] = True
            both = np.add.reduceat(held[np.concatenate(some)].astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            held[sets[at]] = False
            near[doubtful] = 10 * both >= round(10 * LIKENESS) * (sizes + len(sets[at]) - both)
        return near

    return _spread(ids, like)


def _against(members: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """(key, x, y, id): the members of every pair of a key's blocks."""
    mine, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return members.join(blocks, key).select(key, "id", mine.alias("mine"), other.alias("other")).select(
        key, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "id")


def _exact(batches):
    """Pairs of texts whose sets of shingles are alike."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part, good = b.slice(k, 64), []
            for s, t in zip(part.column("text_a"), part.column("text_b")):
                s, t = (shingles(x.as_py().encode().lower().split()) for x in (s, t))
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(10 * both >= round(10 * LIKENESS) * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, doc_id, root): rows of one ``root`` are connected by near-copies. ``row`` is a hash of doc_id and text.

    Texts with the same words (A-Z lowered) are copies; those without words are copies of each other, nulls too. Pairs whose
    2048-bit estimate is within SLACK of LIKENESS are checked by their exact likeness. In buckets of more than CROWD distinct
    texts the estimate first gathers what may be alike, over all buckets; then the texts of each such gathering, each sent once
    for every block, are compared in pairs of blocks.
    Repeated rows come back repeated; null doc_ids are kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.xxhash64("doc_id", F.col(text)).alias("row"), "doc_id", F.col(text).alias("text"))
    d = common.written(given.mapInArrow(_signed, f"row long, doc_id {kind}, id long, n long, sketch binary, keys array<long>"), "signatures")
    new = d.where("n is not null")
    keys = new.dropDuplicates(["id"]).select(F.explode("keys").alias("key"), "id")
    met = common.written(
        keys.repartition(F.shiftrightunsigned("key", SHORT)).sortWithinPartitions(F.shiftrightunsigned("key", SHORT), "id").mapInArrow(_met, "key long, a long, b long"), "met")
    known = new.groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    crowds = met.where("b is null").select("key", F.col("a").alias("id"))
    blocks = crowds.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    maybe = connected_components(_against(crowds, "key", blocks).join(known, "id").groupBy("key", "x", "y").applyInArrow(_crowd, "a long, b long"))
    gathered = common.written(maybe.select(F.col("node").alias("id"), F.col("component").alias("of")).join(known, "id"), "gathered")
    blocks = gathered.groupBy("of").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HELD)).cast("int").alias("blocks"))
    row_of = new.join(gathered.select("id"), "id", "left_semi").groupBy("id").agg(F.min("row").alias("row"))
    crowd_texts = given.select("row", "text").join(row_of, "row").groupBy("id").agg(F.first("text").alias("text"))
    full = gathered.select("id", "n", "sketch").join(crowd_texts, "id")
    crowded = connected_components(_against(gathered.select("of", "id"), "of", blocks).join(full, "id").groupBy("of", "x", "y").applyInArrow(_alike, "a long, b long"))
    # pairs that a crowd has connected needn't be weighed
    at = lambda c: crowded.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    loose = met.where("b is not null").select("a", "b").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left").where("of_a is null or of_b is null or of_a <> of_b")
    side = lambda c: known.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    pairs = common.written(
        loose.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_weighed, "a long, b long, likeness double"), "weighed")
    sure = pairs.where(F.col("likeness") >= LIKENESS + SLACK).select("a", "b")
    doubtful = pairs.where(F.col("likeness") < LIKENESS + SLACK).select("a", "b")
    asked = doubtful.select(F.col("a").alias("id")).union(doubtful.select(F.col("b").alias("id"))).distinct()
    rows = new.join(asked, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row"))
    texts = common.written(given.select("row", "text").join(rows, "row").groupBy("id").agg(F.first("text").alias("text")), "texts")
    half = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    exact = doubtful.join(half("a"), "a").join(half("b"), "b").mapInArrow(_exact, "a long, b long")
    linked = connected_components(sure.union(exact).union(crowded.select(F.col("node").alias("a"), F.col("component").alias("b")))).select(F.col("node").alias("id"), "component")
    return d.select("row", "doc_id", "id").join(linked, "id", "left").select("row", "doc_id", F.coalesce("component", "id").alias("root"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``' own columns, one row of each class: that of its smallest doc_id (nulls last; of rows with one doc_id, one by its text's hash).

    Rows alike in doc_id and text are one document."""

    row, own = common.unused(docs.columns, "_row", "_own_id")

    def first():
        of_class = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
        return classes(docs, text).groupBy("root").agg(of_class).select(F.col("first.row").alias(row), F.col("first.doc_id").alias(own))

    d, f = docs.withColumn(row, F.xxhash64("doc_id", F.col(text))).alias("d"), common.settled(docs.sparkSession, "first", first).alias("f")
    kept = d.join(f, (F.col(f"d.{row}") == F.col(f"f.{row}")) & F.col("d.doc_id").eqNullSafe(F.col(f"f.{own}")), "left_semi")
    return kept.dropDuplicates([row, "doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
