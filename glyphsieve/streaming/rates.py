"""Scoring of streams: the same expressions, and rates of flagged texts over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detector import Detector, Ensemble


def scored(stream: DataFrame, detector: Detector | Ensemble, column: str = "text") -> DataFrame:
    """A stream with score and flag. Stateless: batches and streams give the same rows."""
    return detector.transform(stream, column)


def flag_rate(stream: DataFrame, detector: Detector | Ensemble, time: str, column: str = "text", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window of event time: texts, flagged texts and their share. Rows later than `late` are left out once their window is closed."""
    rows = scored(stream, detector, column).withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("span")).agg(F.count(column).alias("n"), F.count_if("flag").alias("flagged")).select("span.start", "span.end", "n", "flagged", F.try_divide("flagged", "n").alias("rate"))
