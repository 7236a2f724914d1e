"""Detectors: a scorer with a threshold, and ensembles that let several vote. All of it is native expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import Dialect
from .lexicon import Lexicon
from .scorers import REGISTRY, ColumnScorer, Plan, gates

VOTING = ("majority", "any", "all", "average", "weighted")
DEFAULT_MEMBERS = ("markov_chain", "log_likelihood_ratio", "word_anomaly")
_WORDS = re.compile(r"'(?:[^'\\]|\\.)*'|\b[A-Za-z_]\w*\b", re.S)


def rename(sql: str, names: dict[str, str]) -> str:
    """sql with identifiers replaced; string literals stay."""
    return _WORDS.sub(lambda m: names.get(m[0], m[0]), sql)


def inline(plan: Plan, text: str, name: str = "__t") -> Plan:
    """The plan as one expression over the SQL text, its steps put in place."""
    known = {name: f"({text})"}
    for step, sql in plan.steps:
        known[step] = f"({rename(sql, known)})"
    return Plan(rename(plan.score, known), [], plan.applicable and rename(plan.applicable, known))


def _text_check(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        raise TypeError(f"column {column} must be a string, not {kind.simpleString()}")


_VAR = re.compile(r"\bv\d+\b")


def _canonical(sql: str) -> str:
    """sql with its lambda variables numbered by first use, so that equal steps read alike."""
    seen: dict[str, str] = {}
    for v in _VAR.findall(sql):
        seen.setdefault(v, f"v{len(seen)}")
    return rename(sql, seen)


def fresh(columns, name: str) -> str:
    """A column name that none of columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_scores(df: DataFrame, column: str, wanted: list[tuple[Detector, str | None, str | None]]) -> DataFrame:
    """df with, for each detector, its score and whether it applies, under the names given.

    Steps are projections of their own, so none is computed twice, and detectors share the steps that they have in
    common; steps that don't depend on each other stand in one projection."""
    _text_check(df, column)
    own = [*df.columns]
    base = fresh(own, "__t")
    depth, levels, known, out = {base: 0}, {}, {}, []
    for detector, score, applicable in wanted:
        if detector.custom:
            out += [detector.column(base).alias(score)] if score else []
            out += [detector.applies(base).alias(applicable)] if applicable else []
            continue
        plan, names = detector.plan(), {"__t": base}
        for step, sql in plan.steps:
            full = _canonical(rename(sql, names))
            if full not in known:
                at = 1 + max((depth[x] for x in _WORDS.findall(full) if x in depth), default=0)
                known[full] = fresh(own, f"__x{len(known)}_")
                depth[known[full]] = at
                levels.setdefault(at, {})[known[full]] = F.expr(full)
            names[step] = known[full]
        if score:
            out.append(F.expr(rename(plan.score, names)).alias(score))
        if applicable:
            out.append((F.expr(rename(plan.applicable, names)) if plan.applicable else F.lit(True)).alias(applicable))
    df = df.withColumn(base, F.col(f"`{column}`"))
    for at in sorted(levels):
        df = df.withColumns(levels[at])
    return df.select(*(F.col(f"`{c}`") for c in own), *out)


@dataclass(frozen=True)
class Detector:
    """One scorer and the score from which a text counts as gibberish."""

    name: str
    threshold: float
    lexicon: Lexicon | None
    params: tuple

    def __init__(self, name: str, threshold: float = 0.5, threads: int | None = None, lexicon: Lexicon | None = None, **params):
        if not 0.0 <= threshold <= 1.0:
            raise ValueError("threshold must be between 0.0 and 1.0")
        if threads is not None and threads < 1:
            raise ValueError("threads must be at least 1")  # accepted for its callers; tasks are what runs in parallel
        if name not in REGISTRY:
            raise NotImplementedError(f"no scorer is named {name}")
        REGISTRY[name].params(params)
        for k, v in (("name", name), ("threshold", threshold), ("lexicon", lexicon), ("params", tuple(params.items()))):
            object.__setattr__(self, k, v)

    def plan(self, text: str = "__t", duck: bool = False) -> Plan:
        return REGISTRY[self.name].plan(Dialect(duck), text, self.lexicon, **dict(self.params))

    def with_score(self, df: DataFrame, column: str, score: str | None, applicable: str | None = None) -> DataFrame:
        """df with the score, and whether the scorer applies, under the names given."""
        return with_scores(df, column, [(self, score, applicable)])

    @property
    def custom(self) -> bool:
        return isinstance(REGISTRY[self.name], ColumnScorer)

    def column(self, column: str) -> Column:
        """The score of a scorer that is a function of a column, within the gates."""
        own, given = REGISTRY[self.name], dict(self.params)
        params = {k: v for k, v in own.params(given).items() if k in own.defaults}
        out = F
        for test, value in gates(Dialect(False), f"`{column}`", given.get("max_string_length", 1000)):
            out = out.when(F.expr(test), F.expr(value))
        return out.otherwise(own.build(F.col(f"`{column}`"), **params).cast("double"))

    def applies(self, column: str) -> Column:
        own = REGISTRY[self.name].applies
        return own(F.col(f"`{column}`")) if own else F.lit(True)

    def score(self, column: str) -> Column:
        """The score as one expression, for filters, SQL and streams."""
        return self.column(column) if self.custom else F.expr(inline(self.plan(), column).score)

    def applicable(self, column: str) -> Column:
        if self.custom:
            return self.applies(column)
        own = inline(self.plan(), column).applicable
        return F.expr(own) if own else F.lit(True)

    def flag(self, column: str) -> Column:
        """Whether a text reaches the threshold; blank texts don't, whatever it is."""
        q = Dialect(False)
        return ~F.expr(q.blank(column)) & (self.score(column) >= self.threshold)

    def transform(self, df: DataFrame, column: str = "text", score: str = "score", flag: str = "flag") -> DataFrame:
        q = Dialect(False)
        return self.with_score(df, column, score).withColumn(flag, ~F.expr(q.blank(f"`{column}`")) & (F.col(score) >= self.threshold))

    def clean(self, df: DataFrame, column: str = "text") -> DataFrame:
        """df without flagged texts; null texts stay."""
        score, flag = fresh(df.columns, "__score"), fresh(df.columns, "__flag")
        return self.transform(df, column, score, flag).where(~F.coalesce(flag, F.lit(False))).drop(score, flag)

    def validate(self, df: DataFrame, column: str = "text", verdict: str = "verdict") -> DataFrame:
        """df with 'missing', 'blank', 'garbled' or 'ok' for each text: what a form or an intake would answer."""
        flag = fresh(df.columns, "__flag")
        rows = self.transform(df, column, fresh(df.columns, "__score"), flag)
        text, blank = F.col(f"`{column}`"), F.expr(Dialect(False).blank(f"`{column}`"))
        said = F.when(text.isNull(), "missing").when(blank, "blank").when(F.col(flag), "garbled").otherwise("ok")
        return rows.select(*(F.col(f"`{c}`") for c in df.columns), said.alias(verdict))


class Ensemble:
    """Several detectors that vote; those that don't apply to a text abstain."""

    def __init__(self, members=None, voting: str | None = None, threshold: float = 0.5, weights=None, threads: int | None = None, lexicon: Lexicon | None = None, **params):
        if members is not None and not members:
            raise ValueError("strategies must not be empty")
        voting = voting or ("any" if members is None else "majority")
        if voting not in VOTING:
            raise ValueError(f"voting must be one of {', '.join(VOTING)}")
        self.members = [Detector(m, threshold, threads, lexicon, **params) for m in members or DEFAULT_MEMBERS]
        if voting == "weighted" and weights is None:
            raise ValueError("weights are required for weighted voting")
        if weights is not None:
            if len(weights) != len(self.members):
                raise ValueError("weights must match the number of strategies")
            if any(w < 0 for w in weights):
                raise ValueError("weights must be non-negative")
            if not any(weights):
                raise ValueError("weights must not be all zero")
        self.voting, self.threshold, self.weights = voting, threshold, list(weights or [1.0] * len(self.members))

    def combine(self, scores: list[str], dialect_duck: bool = False) -> tuple[str, str]:
        """SQL of score and flag over the members' scores, null where a member abstains."""
        q = Dialect(dialect_duck)
        n = " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE 1 END" for s in scores)
        votes = " + ".join(f"CASE WHEN {s} >= {q.num(self.threshold)} THEN 1 ELSE 0 END" for s in scores)
        weights = self.weights if self.voting == "weighted" else [1.0] * len(scores)
        total = " + ".join(f"coalesce({q.num(float(w))} * {s}, CAST(0 AS DOUBLE))" for w, s in zip(weights, scores, strict=True))
        weight = " + ".join(f"CASE WHEN {s} IS NULL THEN CAST(0 AS DOUBLE) ELSE {q.num(float(w))} END" for w, s in zip(weights, scores, strict=True))
        mean = f"(CASE WHEN ({weight}) = 0 THEN CAST(0 AS DOUBLE) ELSE ({total}) / ({weight}) END)"
        most = lambda f: f"coalesce({f}({', '.join(scores)}), CAST(0 AS DOUBLE))" if len(scores) > 1 else f"coalesce({scores[0]}, CAST(0 AS DOUBLE))"
        score = {"any": most("greatest"), "all": most("least")}.get(self.voting, mean)
        flag = {"majority": f"2 * ({votes}) > ({n})", "any": f"({votes}) > 0", "all": f"({n}) > 0 AND ({votes}) = ({n})"}.get(self.voting, f"({n}) > 0 AND {mean} >= {q.num(self.threshold)}")
        return score, flag

    def transform(self, df: DataFrame, column: str = "text", score: str = "score", flag: str = "flag") -> DataFrame:
        own = [*df.columns]
        names = [(fresh(own, f"__s{i}"), fresh(own, f"__a{i}")) for i in range(len(self.members))]
        df = with_scores(df, column, [(m, s, a) for m, (s, a) in zip(self.members, names, strict=True)])
        df = df.withColumns({s: F.when(F.col(a), F.col(s)) for s, a in names})
        total, voted = self.combine([s for s, _ in names])
        text, blank = F.col(f"`{column}`"), F.expr(Dialect(False).blank(f"`{column}`"))
        return df.select(*(F.col(f"`{c}`") for c in own), F.when(text.isNotNull(), F.expr(total)).alias(score), F.when(text.isNotNull(), ~blank & F.expr(voted)).alias(flag))


def all_scores(df: DataFrame, column: str = "text", names=None, lexicon: Lexicon | None = None) -> DataFrame:
    """df with a column for each scorer."""
    return with_scores(df, column, [(Detector(n, lexicon=lexicon), n, None) for n in names or REGISTRY])
