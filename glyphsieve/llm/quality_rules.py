"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure lies above a cutoff. All rules tighten together, along one fixed path of
steps, from the loosest cutoffs to the strictest; a document's level is the first step at which any rule rejects it. For
each stratum the steps are tested in turn on labelled documents (a holdout that no other part learns from): the exact
(Clopper-Pearson) upper bound on the share of good documents that the rules together reject at a step must stay within
max_false_rejection, at a confidence corrected (Bonferroni) for the strata; the first step that cannot be certified ends
the stratum's sequence. So, at confidence 1 - delta for all strata at once, no stratum loses more than
max_false_rejection of its good documents to the rules. Among the certified steps the one that rejects the most bad
documents net of good ones is taken; without a benefit the rules are off.

Strata are bands of length, as counted here. A band with too few good documents to certify even a step that rejects none
of them is merged with its neighbour that has fewer, until each has enough or one is left; only the numbers of good
documents decide that, never what a rule rejects, so the tests stay valid, and the guarantee holds for the merged band.

Defined results: null and empty texts have no words and fail the base rules; labels that are null or whose id is
unknown are not used; rows that repeat are judged one by one; an empty label table switches the certified rules off;
only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table

MIN_WORDS = 50
REPEAT_PERCENT = 50
MAX_FALSE_REJECTION = 0.01
DELTA = 0.05
#: Words from which the next stratum begins.
STRATA = (150, 500, 2000)
WHITE = b" \t\n\v\f\r"
#: Steps of the path, and each rule's cutoff at each of them, loosest first.
STEPS = 40
GRIDS = {
    "symbol": tuple(float(x) for x in np.round(np.geomspace(4.0, 0.02, STEPS), 6)),
    "dup_line": tuple(float(x) for x in np.round(np.linspace(0.95, 0.05, STEPS), 6)),
    "repeat": tuple(float(x) for x in np.round(np.linspace(0.50, 0.02, STEPS), 6)),
    "upper": tuple(float(x) for x in np.round(np.linspace(0.95, 0.05, STEPS), 6)),
    "punct": tuple(float(x) for x in np.round(np.geomspace(2.0, 0.02, STEPS), 6)),
    "digit": tuple(float(x) for x in np.round(np.geomspace(0.9, 0.01, STEPS), 6)),
    "long_word": tuple(float(x) for x in np.round(np.geomspace(40.0, 6.0, STEPS), 6)),
}
RULES = tuple(GRIDS)
_UP = bytes(range(65, 91))
_LETTERS = _UP + bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_PUNCT = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or c in _SYMBOLS))
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " + ", ".join(f"{r} double" for r in RULES)


def repeat_words(words: list) -> int:
    """Words in three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    key = (w[:-2] * v + w[1:-1]) * v + w[2:] if v < 2_000_000 else np.unique(w[:-2] * v + w[1:-1], return_inverse=True)[1] * v + w[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """The base counts and each rule's measure of one text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()  # on bytes: the six ASCII white spaces
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, *(0.0 for _ in RULES))
    count = lambda chars: len(b) - len(b.translate(None, chars))
    chars = len(text) - count(WHITE)
    lines = [x for x in b.split(b"\n") if not x.isspace() and x]
    dup = len(lines) - len(set(lines))
    repeats, symbols = repeat_words(words), count(_SYMBOLS)
    letters = count(_LETTERS)
    return (n, chars, symbols, dup, repeats, symbols / n, dup / len(lines), repeats / n, count(_UP) / max(letters, 1), count(_PUNCT) / n, count(_DIGITS) / chars, chars / n)


def _measure_rows(names: list):
    """rows (ids, text) -> rows of names: the ids, then the text's measures."""

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.float64()) for k in range(5 + len(RULES)))], names)

    return run


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    row, kind = ([F.col(row_col)], f"{row_col} bigint, ") if row_col else ([], "")
    names = [*([row_col] if row_col else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES]
    out = docs.select(*row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure_rows(names), f"{kind}doc_id {docs.schema[id_col].dataType.simpleString()}, {MEASURES}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def stratum() -> F.Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(F.col("n_words") >= least, k + 1).otherwise(out)
    return out


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact binomial upper bound: the largest p for which k or fewer of n has a probability of delta or more."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = max(k / n, 1e-300), 1.0 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > delta else (lo, mid)
    return hi


def merged_strata(good: list[int], max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> list[list[int]]:
    """Neighbouring strata in groups, each with good documents enough for its own test, as far as that goes."""
    groups = [[s] for s in range(len(good))]
    size = lambda g: sum(good[s] for s in g)
    while len(groups) > 1:
        need = math.log(delta / len(groups)) / math.log1p(-max_false_rejection)
        k = min(range(len(groups)), key=lambda i: (size(groups[i]), i))
        if size(groups[k]) >= need:
            break
        other = min((j for j in (k - 1, k + 1) if 0 <= j < len(groups)), key=lambda j: (size(groups[j]), j))
        a, z = sorted((k, other))
        groups[a : z + 1] = [groups[a] + groups[z]]
    return groups


def select_steps(levels: dict, strata: int, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> dict[int, int]:
    """stratum -> step. levels: (stratum, good) -> how many documents each step is the first to reject."""
    at = lambda s, good: np.array(levels.get((s, good), [0] * (STEPS + 1)), np.int64)
    groups = merged_strata([int(at(s, True).sum()) for s in range(strata)], max_false_rejection, delta)
    out = {}
    for g in groups:
        wrong, right = (np.cumsum(sum(at(s, good) for s in g)) for good in (True, False))
        good, best = int(wrong[-1]), 0
        for step in range(STEPS):
            if not good or wrong[step] > max_false_rejection * good or upper_bound(int(wrong[step]), good, delta / len(groups)) > max_false_rejection:
                break
            if right[step] - wrong[step] > best:
                best = int(right[step] - wrong[step])
                out |= dict.fromkeys(g, step)
    return out


def level() -> F.Column:
    """The first step at which a rule rejects the document; STEPS where none does."""
    return F.least(*(sum((F.when(F.col(r) > c, 0).otherwise(1) for c in GRIDS[r]), F.lit(0)) for r in RULES))


def holdout_levels(measured: DataFrame, labels: DataFrame) -> dict:
    """(stratum, good) -> the number of labelled documents of each level. Of a size that strata and steps fix."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("quality").alias("_quality"))
    held = measured.where(~F.col("base_failed")).join(marks, F.col("doc_id") == F.col("_label_id"))
    rows = held.groupBy(stratum().alias("stratum"), (F.col("_quality") > 0).alias("good"), level().alias("level")).count().collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["stratum"], r["good"]), [0] * (STEPS + 1))[r["level"]] += r["count"]
    return out


def verdict(steps: dict[int, int]) -> F.Column:
    """True where the rules at the stratum's certified step don't reject the document."""
    bad = F.lit(False)
    for s, step in sorted(steps.items()):
        over = F.lit(False)
        for r in RULES:
            over = over | (F.col(r) > GRIDS[r][step])
        bad = bad | ((stratum() == s) & over)
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, row_col: str | None = None) -> DataFrame:
    """A row per document: its counts, measures, base_failed and kept; and row_col, if docs number their rows."""
    measured, _ = cut(measures(docs, id_col, text_col, row_col), "measures")  # a few numbers a document; counted, then judged
    steps = select_steps(holdout_levels(measured, labels), len(STRATA) + 1, max_false_rejection, delta)
    return measured.withColumn("kept", ~F.col("base_failed") & verdict(steps))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, as they came: each row by its own verdict, whether its id is null or repeats."""
    placed, row = numbered(docs)
    kept = judge(placed, labels, id_col, text_col, row_col=row).where("kept").select(row)
    return placed.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
