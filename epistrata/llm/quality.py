"""A quality score learnt from pairwise preferences (Bradley-Terry)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what is learnt from: labelled rows, chosen by a hash of doc_id, and preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 200_000
STEPS, PENALTY = 400, 1e-3
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "log_words", "word_length", "word_length_spread", "distinct", "top_word", "top_three", "distinct_pairs", "twice_running", "upper",
    "digits", "spaces", "exclamations", "symbols", "marks", "non_ascii", "caps_words", "symbol_words", "repeated_lines",
    "log_line_words", "entropy", "longest_word",
)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(text: str | None) -> np.ndarray:
    """What a whole text looks like, in numbers of about one size; all zero for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, size = len(words), len(raw)
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = bytes_[bytes_ > 0] / size
    caps = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(1 for w in words if w[-1] in SYMBOLS)
    return np.array([
        np.log1p(n) / 4, min(lengths.mean() / 8, 3), min(lengths.std() / 4, 3), len(counts) / n, top[0] / n, sum(top) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1), sum(a == b for a, b in zip(words, words[1:])) / n,
        bytes_[65:91].sum() / size, bytes_[48:58].sum() / size, (bytes_[32] + bytes_[10]) / size, bytes_[33] * 5 / size,
        bytes_[list(SYMBOLS)].sum() * 5 / size, bytes_[_PUNCTUATION].sum() * 5 / size, bytes_[128:].sum() / size,
        caps / n, marked / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 4,
        -(share * np.log2(share)).sum() / 5, min(np.log1p(lengths.max()) / 3, 3),
    ])


def _arrow_features(batches):
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            part = b.slice(k, 1024)
            x = [features(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 1)], pa.array(x, pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "x"])


def _widened(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and how far each lies on either side of the middle: a score may punish both extremes."""
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate([z, np.abs(z), np.minimum(z * z, 16)], axis=1)


def bradley_terry(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights w under which preferred rows (y = 1) beat the others: logistic loss on w . (x_i - x_j), L2 penalty, Adam steps."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    d = x[rng.choice(good, PAIRS)] - x[rng.choice(bad, PAIRS)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        part = d[(t - 1) * 5000 % len(d) :][:5000]
        lost = 1 / (1 + np.exp(np.clip(part @ w, -30, 30)))
        g = -(lost[:, None] * part).mean(axis=0) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict:
    """The model: learnt from at most ``sample`` labelled rows (doc_id, quality), chosen by hash.

    The threshold is the quantile of the sample's scores at its share of label 0; without labels, scores are all one half."""
    ids = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")  # `sample` pairs of numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("doc_id", F.col("quality").cast("long"), "text").mapInArrow(_arrow_features, f"doc_id {kind}, quality long, x array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    y = rows.column("quality").to_numpy()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    if not len(y) or y.min() == y.max():
        z = np.zeros(len(FEATURES))
        return {"centre": z, "scale": z + 1, "w": np.zeros(3 * len(FEATURES)), "threshold": 0.0}
    centre, scale = np.median(x, axis=0), x.std(axis=0) + 1e-6
    wide = _widened(x, centre, scale)
    w = bradley_terry(wide, y)
    # halfway between the scores on either side of the quantile
    s = np.sort(wide @ w)
    k = int((y == 0).sum())
    return {"centre": centre, "scale": scale, "w": w, "threshold": float((s[k - 1] + s[min(k, len(s) - 1)]) / 2)}


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` (its columns may have any names) with ``score`` for doc_id, as (doc_id, score): 0 to 1, at least one half above the threshold.

    The score comes from the text alone. Null and empty texts score as texts without words do; repeated rows come back repeated."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in _arrow_features(batches):
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            raw = _widened(x, model["centre"], model["scale"]) @ model["w"] - model["threshold"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -50, 50))))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores one half or more, with their own columns."""
    names = docs.columns

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x = np.array([features(t.as_py()) for t in part.column(names.index(text))]).reshape(-1, len(FEATURES))
                raw = _widened(x, model["centre"], model["scale"]) @ model["w"] - model["threshold"]
                yield part.filter(pa.array(raw >= 0))

    return docs.mapInArrow(run, docs.schema)
