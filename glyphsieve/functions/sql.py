"""Scorers as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.detector import DEFAULT_MEMBERS, Detector, inline
from ..operators.lexicon import Lexicon
from ..operators.scorers import REGISTRY
from .dialect import Dialect


def register(spark: SparkSession, names=None, prefix: str = "score_", lexicon: Lexicon | None = None) -> list[str]:
    """Temporary functions prefix || name (text STRING) RETURNS DOUBLE, native all through. Returns their names."""
    out = []
    for name in names or REGISTRY:
        body = inline(Detector(name, lexicon=lexicon).plan(), "t").score
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS DOUBLE RETURN {body}")
        out.append(prefix + name)
    return out


def register_explain(spark: SparkSession, names=DEFAULT_MEMBERS, name: str = "explain_text", lexicon: Lexicon | None = None) -> str:
    """A temporary table function name(text STRING) with a row for each scorer: strategy, applicable, score, flag. Returns its name."""
    rows = []
    for n in names:
        plan = inline(Detector(n, lexicon=lexicon).plan(), "t")
        rows.append(f"named_struct('strategy', '{n}', 'applicable', coalesce({plan.applicable or 'true'}, false), 'score', {plan.score})")
    blank = Dialect(False).blank("t")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE (strategy STRING, applicable BOOLEAN, score DOUBLE, flag BOOLEAN) "
        f"RETURN SELECT r.strategy, r.applicable, r.score, NOT ({blank}) AND r.score >= 0.5 FROM (SELECT explode(array({', '.join(rows)})) AS r)"
    )
    return name
