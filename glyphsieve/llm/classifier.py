"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every document come from one pass and are kept as a written table. The trees learn, on the driver,
from at most max_fit labelled documents (those of the smallest hashed ids, so the choice depends on nothing else); they
are flattened into arrays (feature, bin, children, value) and traversed for a whole batch at once.

Defined results: null and empty texts have all-zero statistics and get the score of those; without usable labels, or
with labels of one class, every score is the (smoothed) share of label 1, 0.5 without any; rows that repeat are scored
one by one; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, table
from .quality_rules import repeat_words

MAX_FIT = 20_000
BINS = 64
_CLASSES = np.full(256, 7, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".,;:'\"-()", b"!?")):
    _CLASSES[np.frombuffer(_chars, np.uint8)] = _k
_CLASSES[128:] = 8
_SENTENCE = np.frombuffer(b".!?", np.uint8)
FEATURES = (
    "log_words", "log_chars", "lower", "upper", "digit", "space", "line", "stop_marks", "bang_marks", "other_marks", "beyond_ascii",
    "word_length", "word_length_spread", "distinct_words", "top_word", "repeat_words", "dup_lines", "log_lines", "line_words", "entropy", "capital_words", "neighbour_words", "sentences", "top_mark",
)


def statistics(text: str | None) -> list[float]:
    """The document statistics of one text, in the order of FEATURES."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(b, np.uint8)
    bytes_of = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASSES, weights=bytes_of, minlength=9)
    n, size = len(words), len(raw)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    p = bytes_of[bytes_of > 0] / size
    marks = bytes_of[33:48].sum() + bytes_of[58:65].sum() + bytes_of[91:97].sum() + bytes_of[123:127].sum()
    top_mark = max(bytes_of[33:48].max(), bytes_of[58:65].max(), bytes_of[91:97].max(), bytes_of[123:127].max())
    return [
        np.log1p(n), np.log1p(size), *(kinds / size), lengths.mean(), lengths.std(), len(counts) / n, max(counts.values()) / n, repeat_words(words) / n,
        (len(lines) - len(set(lines))) / len(lines), np.log1p(len(lines)), n / len(lines), float(-(p * np.log2(p)).sum()), sum(w[:1].isupper() for w in words) / n,
        sum(a == c for a, c in zip(words, words[1:], strict=False)) / n, bytes_of[_SENTENCE].sum() / n, float(top_mark) / max(1.0, float(marks)) * min(1.0, float(marks) / n),
    ]


def _statistics_rows(batches):
    for b in batches:
        rows = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float32).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(rows), pa.list_(pa.float32()))], ["doc_id", "x"])


class Trees:
    """Boosted trees as flat arrays. Every tree is complete to its depth: node i has children 2i+1 and 2i+2."""

    def __init__(self, edges: np.ndarray, feature: np.ndarray, cut_bin: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.edges, self.feature, self.cut_bin, self.value, self.base, self.depth = edges, feature, cut_bin, value, base, depth

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x: all rows go down all trees, a level at a time."""
        z = np.full(len(x), self.base)
        if len(self.feature):
            binned, rows = self.bins(x), np.arange(len(x))
            for feature, cut_bin, value in zip(self.feature, self.cut_bin, self.value, strict=True):
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (binned[rows, feature[at]] > cut_bin[at])
                z += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 8) -> Trees:
    """Newton-boosted trees of histograms for the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base, none = float(np.log(share / (1 - share))), np.empty((0, 0), int)
    if not len(y) or y.min() == y.max():
        return Trees(np.empty((0, 0)), none, none, none, base, depth)
    d, inner = x.shape[1], 2**depth - 1
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(d)])
    model = Trees(edges, none, none, none, base, depth)
    binned = model.bins(x)
    flat = binned.astype(np.int64) + np.arange(d) * BINS
    z, features, cuts, values = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut_bin, at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (d * BINS) + flat).ravel()
            gs, hs, cs = (np.bincount(key, weights=np.repeat(v, d), minlength=nodes * d * BINS).reshape(nodes, d, BINS).cumsum(2) for v in (g, h, np.ones(len(y))))
            gt, ht, ct = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(cs < least) | (ct - cs < least)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            feature[first : first + nodes], cut_bin[first : first + nodes] = best // BINS, np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut_bin[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        z += value[leaf]
        features.append(feature), cuts.append(cut_bin), values.append(value)
    return Trees(edges, np.stack(features), np.stack(cuts), np.stack(values), base, depth)


def sample_of(rows: DataFrame, labels: DataFrame, label: str, max_fit: int) -> DataFrame:
    """rows with their label as _y: at most max_fit, those of the smallest hashed ids."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(label).cast("int").alias("_y"))
    return rows.join(marks, F.col("doc_id") == F.col("_label_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 3, held: int = 1, max_fit: int = MAX_FIT) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted. Rows of the held-out fold lend no label."""
    kind = docs.schema[id_col].dataType.simpleString()
    stats, _ = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics_rows, f"doc_id {kind}, x array<float>"), "statistics")
    stats = stats.withColumn("held_out", fold("doc_id", folds) == held)
    known = sample_of(stats.where(~F.col("held_out")), labels, label, max_fit).select("x", "_y").toPandas()
    model = fit(np.array(known["x"].tolist(), np.float64).reshape(len(known), len(FEATURES)), known["_y"].to_numpy(np.float64))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees * 2**(depth + 1) numbers

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, len(FEATURES))
            p = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "x", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
