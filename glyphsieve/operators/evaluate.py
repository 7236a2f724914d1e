"""Evaluation of verdicts against labels: confusion counts and the measures that follow, by any grouping."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from .detector import Detector, fresh, with_scores


def predictions(cases: DataFrame, names: list[str], text: str = "text", expected: str = "expected", threshold: float = 0.5, lexicon=None) -> DataFrame:
    """cases with a row for each scorer: strategy, score, predicted, correct."""
    own = [*cases.columns]
    columns = [fresh(own, f"__{n}") for n in names]
    scored = with_scores(cases, text, [(Detector(n, threshold, lexicon=lexicon), c, None) for n, c in zip(names, columns, strict=True)])
    stacked = scored.select(*(F.col(f"`{c}`") for c in own), F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {c}' for n, c in zip(names, columns, strict=True))}) AS (strategy, score)"))
    said = ~F.expr(Dialect(False).blank(f"`{text}`")) & (F.col("score") >= threshold)
    return stacked.withColumn("predicted", said).withColumn("correct", F.col("predicted") == F.col(expected))


def elapsed(cases: DataFrame, names: list[str], text: str = "text", lexicon=None) -> DataFrame:
    """(strategy, seconds): the wall-clock time that each scorer takes over all cases, one job each."""
    took = []
    for n in names:
        began = time.perf_counter()
        Detector(n, lexicon=lexicon).with_score(cases.select(text), text, "score").select("score").write.format("noop").mode("overwrite").save()
        took.append((n, time.perf_counter() - began))
    return cases.sparkSession.createDataFrame(took, "strategy string, seconds double")


def metrics(rows: DataFrame, by: list[list[str]], expected: str = "expected") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 for each grouping set, in one aggregation. Columns that a set leaves out are null; `level` numbers the set."""
    keys = list(dict.fromkeys(k for s in by for k in s))
    yes, said = F.col(expected), F.col("predicted")
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n)
    sums = rows.groupingSets([[F.col(k) for k in s] for s in by], *(F.col(k) for k in keys)).agg(
        count(yes & said, "tp"), count(~yes & said, "fp"), count(~yes & ~said, "tn"), count(yes & ~said, "fn"), F.count("*").cast("bigint").alias("total"), F.grouping_id().cast("bigint").alias("level")
    )
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumn("accuracy", part(F.col("tp") + F.col("tn"), F.col("total"))).withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranking(by_strategy: DataFrame) -> DataFrame:
    """Strategies by F1, best first; of equal ones by name."""
    return by_strategy.select("strategy", "f1", "precision", "recall").orderBy(F.desc("f1"), "strategy")


def source_gap(by_source: DataFrame, internal: str, top: int = 10) -> DataFrame:
    """F1 on the internal source less the mean F1 on the others, for the top strategies by the former."""
    inner = F.max(F.when(F.col("source") == internal, F.col("f1")))
    outer = F.avg(F.when(F.col("source") != internal, F.col("f1")))
    gaps = by_source.groupBy("strategy").agg(F.coalesce(inner, F.lit(0.0)).alias("f1_internal"), F.coalesce(outer, F.lit(0.0)).alias("f1_external"))
    gap = F.col("f1_internal") - F.col("f1_external")
    rated = gaps.withColumn("gap", gap).withColumn("rating", F.when(gap > 0.15, "overfit").when(gap < 0.05, "steady").otherwise("some gap"))
    return rated.orderBy(F.desc("f1_internal"), "strategy").limit(top)


def misclassified(rows: DataFrame, key: str, per: int = 5) -> DataFrame:
    """The first cases, by key, that each strategy got wrong."""
    w = Window.partitionBy("strategy").orderBy(key)
    wrong = rows.where(~F.col("correct")).select("strategy", key, "score", F.row_number().over(w).alias("rank"))
    return wrong.where(F.col("rank") <= per)
