"""Sources and sinks: labelled corpora, word counts, reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE = T.StructType([T.StructField("text", T.StringType()), T.StructField("expected_garbled", T.BooleanType())])
CORPUS = T.StructType([T.StructField("test_cases", T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("source", T.StringType()), T.StructField("cases", T.ArrayType(CASE))])))])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(category, source, text, expected) from nested JSON; a source left out is 'internal'."""
    groups = spark.read.schema(CORPUS).option("multiLine", True).json(path).select(F.explode("test_cases").alias("g"))
    cases = groups.select("g.category", F.coalesce("g.source", F.lit("internal")).alias("source"), F.explode("g.cases").alias("c"))
    return cases.select("category", "source", "c.text", F.col("c.expected_garbled").alias("expected"))


def texts_of(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """(at, text) of a list, with each text's place."""
    if not isinstance(texts, list):
        raise TypeError("texts must be a list")
    for i, t in enumerate(texts):
        if t is not None and not isinstance(t, str):
            raise TypeError(f"element {i} must be a string, not {type(t).__name__}")
    return spark.createDataFrame(list(enumerate(texts)), "at bigint, text string")


def write_report(metrics: DataFrame, path: str) -> None:
    """The measures as JSON lines, each with the time of writing."""
    metrics.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def report_text(metrics: DataFrame) -> str:
    """A table, to read, of measures by strategy: one line each, so of bounded size; best F1 first."""
    rows = metrics.orderBy(F.desc("f1"), "strategy").select("strategy", "total", "accuracy", "precision", "recall", "f1").collect()
    lines = [f"{datetime.now(timezone.utc):%Y-%m-%d %H:%M} UTC", f"{'strategy':<24}{'total':>10}{'accuracy':>10}{'precision':>10}{'recall':>10}{'f1':>10}"]
    return "\n".join([*lines, *(f"{r[0]:<24}{r[1]:>10}" + "".join(f"{x:>10.4f}" for x in r[2:]) for r in rows)])
