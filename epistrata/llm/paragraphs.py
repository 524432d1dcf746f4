"""Paragraph near-duplicates: MinHash banding, exact Jaccard, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, passages
from .components import connected_components

WIDTH, LIKENESS = 5, 0.8
#: What repeats over fewer words than this isn't a duplicate, in a paragraph (line) as in a passage: headings, formulas, stock phrases.
MIN_WORDS = passages.RUN
#: Bands of two minima each: a pair of likeness 0.8 shares a band with probability 1 - (1 - 0.64)^8 = 0.9997.
BANDS, ROWS = 8, 2
#: Distinct paragraphs of a band compared in one task; larger bands are compared block against block.
BLOCK = 4096
_rng = np.random.default_rng(12345)
_A = (_rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(paragraphs: list[list[bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 32-bit hashes of each paragraph's word shingles in turn, ascending within; where each begins). Fewer words: the whole."""
    sizes = np.array([len(w) for w in paragraphs], dtype=np.int64)
    words = passages.word_hashes([w for p in paragraphs for w in p])
    of, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    keys = []
    for k in {min(width, int(n)) for n in sizes}:
        g = passages.hashes(words, k)
        at = np.flatnonzero((np.arange(len(g)) + k <= ends[of[: len(g)]]) & (np.minimum(width, sizes[of[: len(g)]]) == k))
        keys.append((of[at].astype(np.uint64) << np.uint64(32)) | (g[at] >> np.uint64(32)))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)
    return key.astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(len(sizes)))


def bands(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of signed 64-bit keys, one per band, for each of the sets that begin at ``starts``."""
    x = sets.astype(np.uint64)
    x ^= x << np.uint64(32)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    for band in range(BANDS):
        for r in range(band * ROWS, band * ROWS + ROWS):
            keys[:, band] = (keys[:, band] ^ np.minimum.reduceat((x * _A[r] + _B[r]) >> np.uint64(16), starts)) * np.uint64(0x9E3779B97F4A7C15)
            keys[:, band] ^= keys[:, band] >> np.uint64(31)
    return keys.view(np.int64)


def _paragraphs(min_words: int):
    """A paragraph's shingles and bands come where the task meets its words for the first time."""

    def run(batches):
        seen = set()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, out, new = b.slice(k, 256), [], []
                for at, t in enumerate(part.column(2)):
                    for i, line in enumerate((t.as_py() or "").encode().lower().split(b"\n")):
                        words = line.split()
                        if len(words) >= max(1, min_words):
                            pid = xxhash.xxh3_128_digest(b" ".join(words))
                            out.append((at, i, len(words), pid, pid not in seen))
                            if pid not in seen:
                                new.append(words)
                                if len(seen) < 1_000_000:
                                    seen.add(pid)
                sets, starts = shingle_sets(new)
                keys = iter(bands(sets, starts)) if new else None
                ends = [*starts[1:].tolist(), len(sets)] if new else []
                raw = sets.tobytes()
                first = iter([raw[4 * x : 4 * y] for x, y in zip(starts.tolist(), ends)])
                at, line, n, pid, fresh = (list(c) for c in zip(*out)) if out else ([], [], [], [], [])
                rows = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(pid, pa.binary()),
                     pa.array([next(first) if f else None for f in fresh], pa.binary()), pa.array([next(keys) if f else None for f in fresh], pa.list_(pa.int64()))],
                    names=["row", "doc_id", "paragraph", "n_words", "pid", "shingles", "bands"])

    return run


def _verified(table: pa.Table) -> pa.Table:
    """Edges between the paragraphs of one block pair of a band: breadth first, each found one against those not reached yet."""
    pid = table.column("pid").to_pylist()
    order = sorted(range(len(pid)), key=pid.__getitem__)
    sets = [np.frombuffer(x, dtype=np.uint32) for x in table.column("shingles").to_pylist()]
    pid, sets = [pid[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    left, edges = np.arange(len(pid)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            both = np.array([len(sets[at])])
            flat = np.concatenate([sets[i] for i in left])
            pos = np.minimum(np.searchsorted(sets[at], flat), both[0] - 1)
            hit = (sets[at][pos] == flat).astype(np.int64)
            common_ = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[left])[:-1]])
            near = 10 * common_ >= round(10 * LIKENESS) * (sizes[left] + both[0] - common_)
            found, left = left[near], left[~near]
            edges += [(pid[at], pid[i]) for i in found]
            queue.extend(found)
    return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """(row, doc_id, paragraph, n_words, cluster, copies, kept, first_doc_id): every paragraph that occurs again, in this document or another.

    Paragraphs are lines of at least ``min_words`` words, alike at Jaccard 0.8 or more over five-word shingles (A-Z
    lowered); clusters are connected by such pairs. ``paragraph`` counts lines from 0; ``kept`` marks the first of a cluster
    by (doc_id, row, paragraph), nulls first, the others are to go. ``row`` tells documents of one doc_id apart; rows alike in
    doc_id and text are one document, which comes out once, its ``copies`` counted.

    Exact copies share a digest, so bands compare distinct paragraphs. A band with more than BLOCK of them is cut into blocks, and
    pairs of blocks are compared in tasks of their own, so that no pair is left out. Null and empty texts have no
    paragraphs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.xxhash64("doc_id", F.col(text))
    p = common.written(
        docs.select(row.alias("row"), "doc_id", F.col(text).alias("text")).mapInArrow(
            _paragraphs(min_words), f"row long, doc_id {kind}, paragraph int, n_words int, pid binary, shingles binary, bands array<long>"), "paragraphs")
    in_band = p.select(F.explode("bands").alias("band"), "pid").distinct()
    # bands with more than one distinct paragraph, and how many blocks they take
    crowded = in_band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = common.written(in_band.join(crowded, "band"), "banded")
    sets = p.where("shingles is not null").join(members.select("pid").distinct(), "pid", "left_semi").groupBy("pid").agg(F.first("shingles").alias("shingles"))
    mine = F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = members.select("band", "pid", mine.alias("mine"), other.alias("other")).select("band", "pid", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    edges = pairs.join(sets, "pid").groupBy("band", "x", "y").applyInArrow(_verified, "a binary, b binary").distinct()
    linked = connected_components(edges).select(F.col("node").alias("pid"), F.col("component").alias("of"))
    narrow = p.groupBy("row", "doc_id", "paragraph", "n_words", "pid").agg(F.count("*").alias("times")).join(linked, "pid", "left").withColumn("of", F.coalesce("of", "pid"))
    first = F.struct(F.col("doc_id"), F.col("row"), F.col("paragraph"))
    clusters = narrow.groupBy("of").agg(F.sum("times").alias("copies"), F.min(first).alias("first")).where("copies > 1")
    return narrow.join(clusters, "of").select(
        "row", "doc_id", "paragraph", "n_words", F.lower(F.hex("of")).alias("cluster"), "copies", (first == F.col("first")).alias("kept"), F.col("first.doc_id").alias("first_doc_id"))


def _cleaned(column: int, flag: str):
    """Takes the lines and spans of the last two columns out of the texts; ``flag`` says whether something was."""

    def run(batches):
        for b in batches:
            lines, spans = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            less = pc.or_(lines.is_valid(), spans.is_valid())
            if pc.any(less).as_py():
                texts = [
                    passages.cut(t, set(x or []), [(s["start"], s["n_words"]) for s in y or []]) if x or y else t
                    for t, x, y in zip(*(b.column(c).to_pylist() for c in (column, b.num_columns - 2, b.num_columns - 1)))]
                b = b.set_column(column, b.schema.field(column), pa.array(texts, b.column(column).type))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], less], names=[*b.schema.names[:-2], flag])

    return run


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """``docs`` without the later occurrences of repeated paragraphs and of passages (``passages``). Both keep the first by one order, so
    something of every kind stays. A document of which nothing but white space is left goes, if something was removed from it.
    Rows alike in doc_id and text are one document and come out once, with the other columns of one of them."""
    row, own, less, gone_lines, gone_spans = common.unused(docs.columns, "_row", "_own_id", "_less", "_gone", "_cut")

    def later():
        spans = common.settled(docs.sparkSession, "passages", lambda: passages.repeated(docs, text).where("not kept").select("row", "doc_id", "start", "n_words"))
        lines = repeated(docs, min_words, text).where("not kept").groupBy("row", "doc_id").agg(F.collect_set("paragraph").alias(gone_lines))
        spans = spans.groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias(gone_spans))
        a, b = lines.alias("a"), spans.alias("b")
        both = a.join(b, (F.col("a.row") == F.col("b.row")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "full")
        return both.select(F.coalesce("a.row", "b.row").alias(row), F.coalesce("a.doc_id", "b.doc_id").alias(own), gone_lines, gone_spans)

    gone = common.settled(docs.sparkSession, "gone", later).alias("g")
    d = docs.withColumn(row, F.xxhash64("doc_id", F.col(text))).dropDuplicates([row, "doc_id"]).alias("d")
    joined = d.join(gone, (F.col(f"d.{row}") == F.col(f"g.{row}")) & F.col("d.doc_id").eqNullSafe(F.col(f"g.{own}")), "left")
    joined = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], gone_lines, gone_spans)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cleaned = joined.mapInArrow(_cleaned(docs.columns.index(text), less), f"{types}, {less} boolean")
    return cleaned.where(~F.col(less) | F.col(text).rlike(common.WORD)).select(*[F.col(f"`{c}`") for c in docs.columns])
