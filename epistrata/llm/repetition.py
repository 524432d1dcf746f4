"""Quality rules over words, with repetition measured on a suffix array."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a repeat, at least.
WINDOW = 8
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The method's own limits: share of the words that lie in repeats (percent), and words of the longest repeat as
#: a share of the text (percent), counted only from LONG words on.
MAX_COVERED_PERCENT, MAX_LONGEST_PERCENT, LONG = 25, 20, 50
SPACE = re.compile(r"[\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


def adjacent_lcp(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of an integer sequence by prefix doubling, and the longest common prefix of each suffix with the one before it.

    The ranks of every doubling are kept until all suffixes differ; the common prefix of two neighbours is then
    summed from the longest power of two down."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n > 1 and step < n and rank.max() < n - 1:
        second = np.full(n, -1, dtype=np.int64)
        second[:-step] = rank[step:]
        pair = rank * np.int64(n + 1) + second + 1
        order = np.argsort(pair, kind="stable")
        s = pair[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        levels.append(rank)
        step *= 2
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        x, y = order[:-1].copy(), order[1:].copy()
        got = np.zeros(n - 1, dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            size = 1 << k
            fits = (x + size <= n) & (y + size <= n)
            same = np.zeros(n - 1, dtype=bool)
            same[fits] = levels[k][x[fits]] == levels[k][y[fits]]
            got[same] += size
            x[same] += size
            y[same] += size
        lcp[1:] = got
    return order, lcp


def repeats(ids: np.ndarray, least: int = WINDOW) -> tuple[int, int]:
    """(covered, longest): items in the union of all repeated substrings of ``least`` items or more, and the items of the longest.

    A suffix's longest repeat is the longer of its common prefixes with its neighbours in the array; the union of these spans
    is that of the maximal repeats."""
    n = len(ids)
    if n < least + 1:
        return 0, 0
    order, lcp = adjacent_lcp(ids)
    best = np.maximum(lcp, np.r_[lcp[1:], 0])
    keep = best >= least
    if not keep.any():
        return 0, 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, order[keep], 1)
    np.add.at(edge, order[keep] + best[keep], -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), int(best.max())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat) of a whole text; null: no words."""
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            dup += line in seen
            seen.add(line)
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    covered, longest = repeats(ids)
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, covered, longest


def verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed, kept) per document.

    Base: too few words, or too many of them in repeats. The method's verdict on the rest: fails where repeats cover
    more than MAX_COVERED_PERCENT, or the longest repeat has LONG words and more than MAX_LONGEST_PERCENT of the text. Null or empty texts fail
    the base; repeated rows come back repeated; memory is that of one text's arrays."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                m = np.array([measure(t.as_py()) for t in part.column(1)], dtype=np.int64).reshape(-1, 6)
                n, rep, longest = m[:, 0], m[:, 4], m[:, 5]
                failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
                bad = (100 * rep > MAX_COVERED_PERCENT * n) | ((longest >= LONG) & (100 * longest > MAX_LONGEST_PERCENT * n))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m[:, i]) for i in range(6)], pa.array(failed), pa.array(~failed & ~bad)], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)
