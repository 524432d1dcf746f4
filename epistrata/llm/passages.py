"""Repeated passages: runs of 51 words or more that stand in two places, whatever surrounds them and however lines break.

The paragraphs compared here are all windows of 51 words, at every place of a text. A window's band is one minimum, the least hash among
its 40 runs of 12 words (MinHash over them, as in winnowing), so equal windows have equal marks. Only windows whose mark stands in two places are hashed whole; equal hashes are equal windows. Neighbouring windows of one
mark travel as a stretch, and stretches alike as one; windows are compared one by one only where a mark has stretches that differ or that repeat a
window themselves, as in a text that says two words over and over, and then once for all stretches alike."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window, and of the runs that mark it: shorter runs make fewer marks, but more that windows unlike share by chance.
RUN, GRAM = 51, 12
WINDOW = RUN - GRAM + 1
#: Texts whose words are hashed in one array.
TEXTS = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))


def joined_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word hashes of all texts in turn, ends of the texts, their lowered bytes)."""
    raw = [(t or "").encode().lower() for t in texts]
    words = [t.split() for t in raw]
    return word_hashes([w for x in words for w in x]), np.cumsum([len(x) for x in words]), raw


def hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words, by doubling."""
    n = max(0, len(words) - k + 1)
    out, have, part, size = np.zeros(n, dtype=np.uint64), 0, words, 1
    while n:
        if k >> size.bit_length() - 1 & 1:
            out = out * np.uint64(pow(_BASE, size, 1 << 64)) + part[have : have + n]
            have += size
        if have == k:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def _sliding(x: np.ndarray, k: int, least) -> np.ndarray:
    size, n = 1, len(x) - k + 1
    while 2 * size <= k:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[:n], x[k - size : k - size + n])


def marks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark of the window at every word, whether a text holds that window whole, places of the runs that are such a window's mark)
    for the words of texts in turn that end at ``ends``."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < RUN:
        return none.astype(np.uint64), none.astype(bool), none
    g = hashes(words, GRAM)
    mark = _sliding(g, WINDOW, np.minimum)
    last = np.repeat(ends, np.diff(np.r_[0, ends]))[: len(mark)]
    whole = np.arange(len(mark)) + RUN <= last
    return mark, whole, np.flatnonzero(g <= _sliding(np.pad(np.where(whole, mark, 0), WINDOW - 1), WINDOW, np.maximum))


def _marked(batches):
    """A mark comes once per text, twice if it stands there more than once."""
    for b in batches:
        for k in range(0, b.num_rows, TEXTS):
            part = b.slice(k, TEXTS)
            words, ends, _ = joined_hashes(part.column(1).to_pylist())
            at = marks(words, ends)[2]
            of = np.searchsorted(ends, at, side="right")
            g = hashes(words, GRAM)[at] if len(at) else np.zeros(0, dtype=np.uint64)
            order = np.lexsort((g, of))
            of, g = of[order], g[order]
            if len(g):
                first = np.r_[True, (of[1:] != of[:-1]) | (g[1:] != g[:-1])]
                first[1:] |= first[:-1]  # the second one stays, too
                of, g = of[first], g[first]
            offsets = np.searchsorted(of, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(g.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["row", "marks"])


def stretches(mark: np.ndarray, at: np.ndarray, of: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, whether its windows aren't all different) of stretches among the windows at ``at``, as places in ``at``: at most RUN
    neighbours of one mark and text, so that the first and the last hold all words between."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (mark[at[1:]] != mark[at[:-1]]) | (of[1:] != of[:-1])]
    run = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % RUN == 0
    stretch = np.cumsum(new) - 1
    order = np.lexsort((hashed[at], stretch))
    h, s = hashed[at][order], stretch[order]
    first = np.flatnonzero(new)
    again = np.zeros(len(first), dtype=bool)
    again[s[1:][(h[1:] == h[:-1]) & (s[1:] == s[:-1])]] = True
    return first, np.diff(np.r_[first, len(at)]), again


def _stretches(batches):
    """A stretch's windows come where the task meets its words for the first time."""
    seen = set()
    for b in batches:
        for k in range(0, b.num_rows, TEXTS):
            part = b.slice(k, TEXTS)
            words, ends, raw = joined_hashes(part.column(2).to_pylist())
            mark, whole, _ = marks(words, ends)
            some = np.unique(part.column(3).flatten().to_numpy().view(np.uint64))
            at = np.flatnonzero(whole & np.isin(mark, some))  # a mark that stands in two places does so for every text
            hashed = hashes(words, RUN)
            of = np.searchsorted(ends, at, side="right")
            first, n, again = stretches(mark, at, of, hashed)
            start, of = at[first], of[first]
            begin = np.r_[0, ends][of]
            lines = np.cumsum([len(x.split()) for t in raw for x in t.split(b"\n")])  # where each line ends
            n_lines = np.cumsum([t.count(b"\n") + 1 for t in raw])
            before = np.r_[0, n_lines][of]
            line = np.minimum(np.maximum(np.searchsorted(lines, start, side="right"), before), n_lines[of] - 1)
            past = np.minimum(np.searchsorted(lines, start + n - 1, side="right"), n_lines[of] - 1)
            breaks = past - line
            ranges = lambda lo, size: np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, dtype=np.int64)
            cuts = lines[ranges(line, breaks)] - np.repeat(start, breaks) if len(start) else np.zeros(0, dtype=np.int64)
            span = (hashed[start] * np.uint64(_BASE) ^ hashed[start + n - 1]) * _MIX + n.astype(np.uint64) * np.uint64(_BASE)
            span ^= span >> np.uint64(31)
            fresh = []
            for x in span.tolist():
                new = x not in seen
                fresh.append(new)
                if new and len(seen) < 1_000_000:
                    seen.add(x)
            sent = np.where(np.array(fresh, dtype=bool), n, 0)
            flat = hashed[ranges(start, sent)] if len(start) else np.zeros(0, dtype=np.uint64)
            lists = lambda sizes, values, kind, mask=None: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind), mask=mask)
            rows = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(start - begin, pa.int32()), pa.array(n, pa.int32()), pa.array(line - before, pa.int32()),
                 lists(breaks, cuts, pa.int32()), pa.array(mark[start].view(np.int64)), pa.array(span.view(np.int64)), pa.array(again), lists(sent, flat.view(np.int64), pa.int64(), pa.array(sent == 0))],
                names=["row", "doc_id", "pos", "n", "line", "breaks", "mark", "span", "again", "windows"])


def _goes_on(back):
    """Whether a window's first occurrence, ``back`` words before where the first occurrence of the window before would go on, follows it or
    begins again less than RUN words before its place, as it does where a text's words recur within a window."""
    return (back >= 0) & (back <= RUN)


def _joined(batches):
    """Pieces of stretches sorted by (row, pos) become passages, by the rule that ``_goes_on`` has for windows."""

    def flush(t):
        row, pos, n, first_row, first_pos, past = (t.column(c).to_numpy() for c in ("row", "pos", "n", "first_row", "first_pos", "past"))
        kept = (row == first_row) & (pos == first_pos)
        new = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != (pos + n)[:-1]) | (kept[1:] != kept[:-1]) | (first_row[1:] != first_row[:-1])
                    | ~_goes_on(past[:-1].astype(np.int64) - first_pos[1:])]
        start = np.flatnonzero(new)
        return start, np.add.reduceat(n.astype(np.int64), start), t

    def passages(t, start, length):
        s = t.take(pa.array(start))
        copies = np.maximum.reduceat(t.column("copies").to_numpy(), np.r_[start])[: len(start)]
        kept = (s.column("row").to_numpy() == s.column("first_row").to_numpy()) & (s.column("pos").to_numpy() == s.column("first_pos").to_numpy())
        return pa.RecordBatch.from_arrays(
            [s.column(c).combine_chunks() for c in ("row", "doc_id", "line", "pos")] + [pa.array(length + RUN - 1, pa.int32()), s.column("cluster").combine_chunks(), pa.array(copies), pa.array(kept), s.column("first_doc_id").combine_chunks()],
            names=["row", "doc_id", "paragraph", "start", "n_words", "cluster", "copies", "kept", "first_doc_id"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        start, length, t = flush(pa.concat_tables([held, t]) if held is not None else t)
        if len(start) > 1:
            yield passages(t.slice(0, int(start[-1])), start[:-1], length[:-1])
        held = t.slice(int(start[-1]))  # the last passage may go on
    if held is not None:
        yield passages(held, *flush(held)[:2])


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, doc_id, paragraph, start, n_words, cluster, copies, kept, first_doc_id): all passages of RUN words or more that stand in two places.

    Words are as in ``paragraphs`` (A-Z lowered). ``start`` counts a text's words from 0, ``paragraph`` is the line of the first.
    A window's first occurrence by (doc_id, row, start), nulls first, is kept, the others are to go. A passage is a longest
    stretch of windows, all kept or none, whose first occurrences also follow one another or, in words that recur within a window, begin again;
    ``cluster`` is the hash of where the first one begins, ``copies`` the most occurrences that one of them has. Rows alike in doc_id and text are one document, which comes out once, its
    windows counted for each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.xxhash64("doc_id", F.col(text)).alias("row"), "doc_id", F.col(text).alias("text"))
    marked = common.written(given.select("row", "text").mapInArrow(_marked, "row long, marks array<long>"), "marks")
    each = marked.select("row", F.explode("marks").alias("mark"))
    twice = each.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    of = each.join(twice, "mark").groupBy("row").agg(F.collect_set("mark").alias("marks"))
    all_ = common.written(
        given.join(of, "row").select("row", "doc_id", "text", "marks").mapInArrow(
            _stretches, f"row long, doc_id {kind}, pos int, n int, line int, breaks array<int>, mark long, span long, again boolean, windows array<long>"), "stretches")
    place = F.struct("doc_id", "row", "pos")
    spans = common.written(all_.groupBy("span", "mark", "n", "again").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "spans")
    mixed = spans.groupBy("mark").agg(F.count("*").alias("k"), F.max("again").alias("again")).where("k > 1 or again").select("mark")
    whole = spans.where("copies > 1").join(mixed, "mark", "left_anti").select(
        "span", F.lit(0).alias("off"), F.col("n").alias("piece"), "copies", "first", (F.col("first.pos") + F.col("n")).alias("past"))
    # one text's stretch stands for all alike; its windows against those of the mark's other stretches
    unlike = spans.join(mixed, "mark", "left_semi").select("span", F.col("copies").alias("alike"), F.col("first").alias("at"))
    known = all_.where("windows is not null").select("mark", "span", "windows").join(mixed, "mark", "left_semi").dropDuplicates(["span"]).select("span", "windows")
    single = common.written(unlike.join(known, "span").select("span", "alike", "at", F.posexplode("windows").alias("off", "window")), "windows")
    here = F.struct(F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row"), (F.col("at.pos") + F.col("off")).alias("pos"))
    again = single.groupBy("window").agg(F.sum("alike").alias("copies"), F.min(here).alias("first")).where("copies > 1")
    one = single.join(again, "window").select("span", "off", "copies", "first", here.eqNullSafe(F.col("first")).alias("own"))
    # only where all stretches alike have it first may a window be kept: elsewhere it is never its own first occurrence
    turn = Window.partitionBy("span").orderBy("off")
    before = lambda c: F.lag(c).over(turn)
    goes_on = (F.col("off") == before("off") + 1) & (F.col("own") == before("own")) & (F.col("first.row") == before("first.row")) & _goes_on(before("first.pos") + 1 - F.col("first.pos"))
    islands = one.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(turn))
    pieces = islands.groupBy("span", "island").agg(
        F.min("off").alias("off"), F.count("*").cast("int").alias("piece"), F.max("copies").alias("copies"), F.min_by("first", "off").alias("first"),
        F.max_by(F.col("first.pos") + 1, "off").alias("past")).select("span", "off", "piece", "copies", "first", "past")
    found = all_.select("row", "doc_id", "pos", "line", "breaks", "span").join(whole.union(pieces), "span").select(
        "row", "doc_id", (F.col("pos") + F.col("off")).alias("pos"), F.col("piece").alias("n"),
        (F.col("line") + F.size(F.filter("breaks", lambda x: x <= F.col("off")))).cast("int").alias("line"), F.xxhash64("first.doc_id", "first.row", "first.pos").alias("cluster"),
        "copies", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"), "past")
    return found.dropDuplicates(["row", "doc_id", "pos"]).repartition("row").sortWithinPartitions("row", "pos").mapInArrow(
        _joined, f"row long, doc_id {kind}, paragraph int, start int, n_words int, cluster long, copies long, kept boolean, first_doc_id {kind}")


def cut(text: str, lines: set[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without the given lines and without the words start to start + n - 1 of each span; a line that loses all its words goes."""
    raw, out, at = text.encode().split(b"\n"), [], 0
    n = sum(len(x.split()) for x in raw)
    gone = np.zeros(n, dtype=bool)
    for start, length in spans:
        gone[start : start + length] = True
    for i, line in enumerate(raw):
        words = list(WORD.finditer(line))
        here = gone[at : at + len(words)]
        at += len(words)
        if i in lines or (len(here) and here.all()):
            continue
        if here.any():
            ends = [w.start() for w in words[1:]] + [len(line)]
            line = line[: words[0].start()] + b"".join(line[w.start() : e] for w, e, g in zip(words, ends, here) if not g).rstrip()
        out.append(line)
    return b"\n".join(out).decode()
