"""Toxicity by maximum-scoring segments of token log-odds.

Words get log-odds of standing in a toxic rather than another document, under an informative Dirichlet prior that gives
each word a fixed share of its own corpus count, shrunk towards 0 by their own standard errors: each word counts by its
own value, less a gap that makes clean text lose on average; unknown words count as 0, less the gap. A linear scan finds
every maximal-scoring passage of a text. Passage scores are calibrated by extreme-value statistics: lambda solves
sum p exp(lambda s) = 1 over the word scores of clean documents, K is the maximum-likelihood fit to the clean documents'
best passages, a passage's E-value is K n exp(-lambda s), and the document's evidence is the sum of -log E over its
significant passages. A logistic curve maps evidence to a score.

The model learns from at most max_fit labelled documents (those of the smallest hashed ids), each distinct text once.

Defined results: null and empty texts hold no passage and get the score of no evidence; without usable labels every
score is 0.5 and, with labels of one class, the (smoothed) share of label 1; rows that repeat are scored one by one;
only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

MAX_FIT = 20_000
#: What each word loses, and the standard errors that its log-odds are shrunk by.
GAP = 0.5
ERRORS = 1.5
PRIOR_SHARE = 0.02
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(at: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (first, last, score) of a sequence that scores scores[i] at at[i] and -gap elsewhere, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # first, last, total before first, total after last
    # places in found of runs that a later one may still join, each beginning lower than the next; a run that begins no
    # lower than a later one never is the nearest lower one again, so each is taken off once
    lower: list[int] = []
    total, last = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total -= gap * (i - last - 1)
        left, right, first, last = total, total + s, i, i
        total = right
        if s <= 0:
            continue
        while True:
            while lower and found[lower[-1]][2] >= left:
                lower.pop()
            if not lower or found[lower[-1]][3] >= right:
                break
            k = lower.pop()
            first, left = found[k][0], found[k][2]
            del found[k:]
        lower.append(len(found))
        found.append((first, i, left, right))
    return [(a, b, r - q) for a, b, q, r in found]


@dataclass
class Model:
    """words: what each known word scores; all others score -gap."""

    words: dict = field(default_factory=dict)
    gap: float = GAP
    rate: float = 1.0
    size: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many words the text has, and its maximal-scoring passages."""
        w, known = tokens(text), self.words
        at = [i for i, x in enumerate(w) if x in known]
        return len(w), segments(at, [known[w[i]] for i in at], self.gap) if at else []

    def best(self, text: str | None) -> tuple[int, float]:
        """How many words the text has, and the score of its best passage."""
        n, found = self.passages(text)
        return n, max((s for *_, s in found), default=0.0)

    def evidence(self, n: int, found: list) -> tuple[float, list[tuple[int, int, float]]]:
        """The sum of -log E over the significant passages, and these with their -log E."""
        kept = [(a, b, self.rate * s - np.log(max(self.size * n, 1e-300))) for a, b, s in found]
        kept = [(a, b, float(x)) for a, b, x in kept if x > 0]
        return sum(x for *_, x in kept), kept

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -30, 30)))


def _root(p: np.ndarray, s: np.ndarray, gap: float) -> float:
    """The positive lambda with sum p exp(lambda s) + (1 - sum p) exp(-lambda gap) = 1."""
    rest = max(1 - p.sum(), 1e-12)
    value = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * np.exp(-x * gap) - 1)
    hi = 1e-6
    while value(hi) < 0 and hi < 1e3:
        hi *= 2
    lo = hi / 2 if hi > 1e-6 else 0.0
    if hi <= 1e-6:  # clean text gains on average: no positive root; a small rate keeps the order of scores
        return 1e-3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    a, b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(p - y).sum() + ridge * a, ((p - y) * x).sum() + ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def counts(sample: DataFrame) -> DataFrame:
    """Rows (word, toxic, clean, spots): in how many toxic and clean documents of sample (text, _y) a word stands, and how often in clean ones. Summed in each task first."""

    def run(batches):
        seen: dict = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0, 2))], ["word", "toxic", "clean", "spots"])

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(tokens(t)).items():
                    row = seen.setdefault(w, [0, 0, 0])
                    row[y] += 1
                    row[2] += 0 if y else k
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    return sample.select("text", "_y").mapInArrow(run, "word string, toxic bigint, clean bigint, spots bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "spots")))


def shrunken(counted: DataFrame, prior_share: float, errors: float = ERRORS) -> DataFrame:
    """Rows (word, spots, odds): the words' log-odds under the prior, moved towards 0 by so many of their standard errors, and no further."""
    total = counted.agg(F.sum("toxic").alias("nt"), F.sum("clean").alias("nc"))
    a = F.lit(prior_share) * (F.col("toxic") + F.col("clean"))
    a0 = F.lit(prior_share) * (F.col("nt") + F.col("nc"))
    side = lambda y, n: F.log((F.col(y) + a) / (F.col(n) + a0 - F.col(y) - a))
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    raw = side("toxic", "nt") - side("clean", "nc")
    odds = F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - errors * error)
    return counted.join(F.broadcast(total)).select("word", "spots", odds.alias("odds"))  # one row


def fit(sample: DataFrame, gap: float = GAP, prior_share: float = PRIOR_SHARE, errors: float = ERRORS) -> Model:
    """Learn from sample, rows (text, _y) of bounded number and distinct texts."""
    model = Model(gap=gap)
    sc = sample.sparkSession.sparkContext
    words = shrunken(counts(sample), prior_share, errors).where("odds <> 0").toPandas().sort_values("word")  # words of max_fit documents at most
    model.words = dict(zip(words["word"], words["odds"].astype(float) - gap, strict=True))

    def told(model: Model, of, schema: str):
        sent = sc.broadcast(model)

        def run(batches):
            for b in batches:
                rows = [of(sent.value, t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["y", "n", schema])

        # three numbers for each of max_fit documents at most
        return sample.select("text", "_y").mapInArrow(run, f"y int, n bigint, {schema} double").toPandas().sort_values(["y", "n", schema])

    seen = told(model, lambda m, t: m.best(t), "best")
    if not len(seen):
        return model
    y, n = seen["y"].to_numpy(float), seen["n"].to_numpy(float)
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.words, model.offset = {}, float(np.log(share / (1 - share)))
        return model
    if model.words:
        clean = y == 0
        p = words["spots"].to_numpy(float) / max(float(n[clean].sum()), 1.0)
        model.rate = _root(p, words["odds"].to_numpy(float) - gap, gap)
        held, best = clean & (n > 0), seen["best"].to_numpy(float)
        model.size = float(held.sum() / max((n[held] * np.exp(-model.rate * best[held])).sum(), 1e-12)) if held.any() else 1.0
    seen = told(model, lambda m, t: (0, m.evidence(*m.passages(t))[0]), "evidence")
    model.offset, model.slope = _logistic(np.log1p(seen["evidence"].to_numpy(float)), seen["y"].to_numpy(float))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep, max_fit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (text, _y): the distinct texts of at most max_fit labelled documents for which keep holds. Broadcasts max_fit ids at most."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(label).cast("int").alias("_y"))
    marks = marks.orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_fit)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marks), F.col("_id") == F.col("_label_id"))
    return own.groupBy("text").agg(F.max("_y").alias("_y"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, max_fit: int = MAX_FIT) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, and its significant passages (first and last word, -log E)."""
    from .common import cut

    sample, _ = cut(labelled(docs, labels, label, fold("doc_id", folds) != held, max_fit, id_col, text_col), "toxicity_sample")
    model = fit(sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        m = sent.value
        for b in batches:
            got = [m.evidence(*m.passages(t)) for t in b.column(1).to_pylist()]
            p = m.score(np.array([e for e, _ in got], float))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array([[{"first": a, "last": z, "evidence": x} for a, z, x in f] for _, f in got], shape)],
                ["doc_id", "held_out", "score", "predicted", "passages"],
            )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, folds) == held).alias("held_out"))
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<first: bigint, last: bigint, evidence: double>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")
