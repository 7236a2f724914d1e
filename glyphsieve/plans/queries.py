"""The queries of the scoring engine and their DuckDB equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from ..operators import evaluate, lexicon, wordgrain
from ..operators.detector import Detector, Ensemble
from ..operators.scorers import REGISTRY

EVALUATED = tuple(REGISTRY)
#: A table of fewer bytes than this for each core is dealt out anew before it is scored: its files may have one row group.
BYTES_A_CORE = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its table is small. A row group is read by one task, and scoring costs far more than dealing rows out; large tables have row groups enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * BYTES_A_CORE else df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of texts in each language that the default ensemble flags."""
    rows = Ensemble().transform(spread(table(spark, sf_dir, "documents").select("lang", "text")))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), _six(F.avg("score")).alias("mean_score"))


def _six(x) -> Column:
    """A score or measure to six digits, as DuckDB's side does it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1_000_000.0 + 0.500001).cast("double") / 1_000_000.0


# DuckDB's side: the same plans in its dialect, step upon step.


def duck_steps(plan, source: str, keep: str, score: str, applicable: str | None = None) -> str:
    """SELECT of keep, score (and applicable) over source, which has keep and __t."""
    sql = source
    for name, step in plan.steps:
        sql = f"SELECT *, {step} AS {name} FROM ({sql})"
    also = f", {plan.applicable or 'true'} AS {applicable}" if applicable else ""
    return f"SELECT {keep}, {plan.score} AS {score}{also} FROM ({sql})"


_D = Dialect(True)


def duck_score(name: str, table_: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, {_D.rounded('s')} AS score FROM ({duck_steps(Detector(name).plan(duck=True), f'SELECT {key}, text AS __t FROM {table_}', key, 's')})"


def duck_ensemble(e: Ensemble, table_: str = "documents", keep: str = "doc_id") -> str:
    """keep, score and flag of every row, members side by side."""
    sql = f"SELECT {keep}, text AS __t FROM {table_}"
    for i, m in enumerate(e.members):
        had = ", ".join(["__t", *(f"s{j}" for j in range(i))])
        sql = f"SELECT * EXCLUDE (a, s), CASE WHEN a THEN s END AS s{i} FROM ({duck_steps(m.plan(duck=True), sql, f'{keep}, {had}', 's', 'a')})"
    score, flag = e.combine([f"s{i}" for i in range(len(e.members))], True)
    blank = Dialect(True).blank("__t")
    return f"SELECT {keep}, CASE WHEN __t IS NOT NULL THEN {score} END AS score, CASE WHEN __t IS NOT NULL THEN NOT ({blank}) AND ({flag}) END AS flag FROM ({sql})"


ENSEMBLES = {
    "any": Ensemble(),
    "all": Ensemble(["entropy_based", "word_anomaly", "letter_position"], "all"),
    "majority": Ensemble(["markov_chain", "ngram_frequency", "word_lookup", "log_likelihood_ratio", "word_anomaly"], "majority"),
    "average": Ensemble(["entropy_based", "zipf_conformity", "function_word_density"], "average"),
    "weighted": Ensemble(["vowel_ratio", "affix_detection", "word_collocation"], "weighted", weights=[1.0, 2.0, 0.5]),
}


def _scores(name: str, table_: str = "documents", key: str = "doc_id"):
    return lambda spark, d: Detector(name).with_score(spread(table(spark, d, table_).select(key, "text")), "text", "s").select(key, _six("s").alias("score"))


def _ensemble(mode: str):
    return lambda spark, d: ENSEMBLES[mode].transform(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", _six("score").alias("score"), "flag")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_frequencies(table(spark, d, "documents"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: low quality stands for gibberish, a weak label of this repository's choosing."""
    marks = table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("expected"))
    cases = spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source")).join(marks, "doc_id")
    return evaluate.predictions(cases, list(EVALUATED))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_six(c).alias(c) if c in ("accuracy", "precision", "recall", "f1", "f1_internal", "f1_external", "gap") else F.col(c) for c in df.columns))


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return Detector("word_anomaly").clean(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.length("text").cast("bigint").alias("n"))


def flag_rate_by_lang_source(spark: SparkSession, d: str) -> DataFrame:
    rows = Ensemble().transform(spread(table(spark, d, "documents").select("lang", "source", "text")))
    out = rows.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source"))
    return out.agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), F.grouping_id().cast("bigint").alias("level"))


def turn_garble_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = Ensemble().transform(spread(table(spark, d, "conversations").select("role", "text")))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), _six(F.avg("score")).alias("mean_score"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    q = Dialect(False)
    return table(spark, d, "documents").select("doc_id", *(F.expr(sql).alias(n) for n, sql in _token_sql(q).items()))


def _token_sql(q: Dialect) -> dict[str, str]:
    """Sizes of what each tokeniser makes of a text."""
    return {
        "white": q.size(q.tokens("text")),
        "folded": q.size(q.find(f"lower({q.fold('text')})", "[a-z]+")),
        "unfolded": q.size(q.find("lower(text)", "[a-z]+")),
        "cased": q.size(q.find(q.fold("text"), "[a-zA-Z]+")),
        "apostrophes": q.size(q.find("lower(text)", "[a-z']+")),
        "letters": q.size(q.find("text", r"\p{L}+")),
        "alphanumeric": q.size(q.find("lower(text)", "[a-z0-9]+")),
    }


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair of letters stands in the benchmark's words."""
    q = Dialect(False)
    words = table(spark, d, "benchmark").select(F.explode(F.expr(q.find("lower(text)", "[a-z]+"))).alias("w"))
    return words.select(F.explode(F.expr(q.grams("w", 2))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def word_grain_anomaly(spark: SparkSession, d: str) -> DataFrame:
    rows = wordgrain.anomaly(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")
    return rows.select("doc_id", "words", "unknown", _six("score").alias("score"))


def lexicon_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct words of two letters or more the documents and the shipped lexicon share, and each has alone."""
    known = spark.createDataFrame([(w,) for w in lexicon.seed().words], "word string")
    sets = wordgrain.vocabularies(_frequencies(spark, d), known)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in sets.items()]
    return reduce(DataFrame.union, parts)


def intake_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What an intake that rejects missing, blank and garbled texts answers to each turn, by role."""
    rows = Detector("log_likelihood_ratio").validate(spread(table(spark, d, "conversations").select("role", "text")))
    return rows.groupBy("role", "verdict").agg(F.count("*").alias("n"))


QUERIES = {
    **{f"score_{n}": _scores(n) for n in REGISTRY},
    "score_benchmark_items": _scores("log_likelihood_ratio", "benchmark", "item_id"),
    **{f"ensemble_{m}": _ensemble(m) for m in ENSEMBLES},
    "train_words": lambda s, d: lexicon.vocabulary(_frequencies(s, d)),
    "train_bigrams": lambda s, d: lexicon.bigram_model(_frequencies(s, d)),
    "train_trigrams": lambda s, d: lexicon.trigram_top(_frequencies(s, d)),
    "tokenize_documents": token_counts,
    "ngrams_benchmark": bigram_counts,
    "clean_documents": clean_documents,
    "flag_rate_by_lang": flagship,
    "flag_rate_by_lang_source": flag_rate_by_lang_source,
    "eval_confusion": lambda s, d: _rounded(evaluate.metrics(_cases(s, d), [["strategy"]])).drop("level"),
    "eval_by_lang": lambda s, d: _rounded(evaluate.metrics(_cases(s, d), [["strategy", "lang"], ["strategy", "source"], ["strategy"]])),
    "eval_ranking": lambda s, d: _rounded(evaluate.ranking(evaluate.metrics(_cases(s, d), [["strategy"]]))),
    "eval_source_gap": lambda s, d: _rounded(evaluate.source_gap(evaluate.metrics(_cases(s, d), [["strategy", "source"]]), "src0")),
    "misclassified_topk": lambda s, d: evaluate.misclassified(_cases(s, d), "doc_id").select("strategy", "doc_id", _six("score").alias("score"), F.col("rank").cast("bigint").alias("rank")),
    "turn_garble_rate": turn_garble_rate,
    "word_grain_anomaly": word_grain_anomaly,
    "lexicon_overlap": lexicon_overlap,
    "intake_verdicts": intake_verdicts,
}

_EN = "SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 2 GROUP BY word"
_CASES = " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, c.doc_id, lang, source, expected, s AS score, NOT ({_D.blank('text')}) AND s >= 0.5 AS predicted FROM ({duck_steps(Detector(n).plan(duck=True), 'SELECT d.doc_id, text AS __t FROM documents d SEMI JOIN labels USING (doc_id)', 'doc_id', 's')}) c JOIN documents USING (doc_id) JOIN (SELECT doc_id, quality = 0 AS expected FROM labels) l USING (doc_id)"
    for n in EVALUATED
)
_COUNTS = "CAST(count(*) FILTER (expected AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT expected AND predicted) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT expected AND NOT predicted) AS BIGINT) AS tn, CAST(count(*) FILTER (expected AND NOT predicted) AS BIGINT) AS fn, count(*) AS total"


def _duck_metrics(sets: str, keys: str, level: str) -> str:
    sums = f"SELECT {keys}, {_COUNTS}{level} FROM ({_CASES}) GROUP BY {sets}"
    part = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"
    one = f"SELECT *, {part('tp + tn', 'total')} AS accuracy, {part('tp', '(tp + fp)')} AS precision, {part('tp', '(tp + fn)')} AS recall FROM ({sums})"
    return f"SELECT *, {part('2 * precision * recall', '(precision + recall)')} AS f1 FROM ({one})"


def _duck_rounded(sql: str, names=("accuracy", "precision", "recall", "f1")) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{_D.rounded(n)} AS {n}' for n in names)}) FROM ({sql})"


SQL = {
    **{f"score_{n}": duck_score(n) for n in REGISTRY},
    "score_benchmark_items": duck_score("log_likelihood_ratio", "benchmark", "item_id"),
    **{f"ensemble_{m}": f"SELECT doc_id, {_D.rounded('score')} AS score, flag FROM ({duck_ensemble(e)})" for m, e in ENSEMBLES.items()},
    "train_words": f"{_EN} ORDER BY cnt DESC, word LIMIT 50000",
    "train_bigrams": f"""
WITH freq AS ({_EN}), pads AS (SELECT ' ' || word || ' ' AS w, cnt FROM freq),
g AS (SELECT substr(w, i, 2) AS g, sum(cnt) AS cnt FROM (SELECT w, cnt, unnest(range(1, length(w))) AS i FROM pads) GROUP BY 1),
c AS (SELECT unnest(string_split(' abcdefghijklmnopqrstuvwxyz', '')) AS c),
grid AS (SELECT a.c || b.c AS bigram FROM c a CROSS JOIN c b),
n AS (SELECT bigram, coalesce(cnt, 0) + 1 AS n FROM grid LEFT JOIN g ON g = bigram)
SELECT bigram, CAST(round(ln(n::DOUBLE / sum(n) OVER (PARTITION BY substr(bigram, 1, 1))::DOUBLE) * 1000000) AS BIGINT) AS micro FROM n""",
    "train_trigrams": f"SELECT trigram, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT substr(word, i, 3) AS trigram, cnt FROM (SELECT word, cnt, unnest(range(1, length(word) - 1)) AS i FROM ({_EN}))) GROUP BY 1 ORDER BY cnt DESC, trigram LIMIT 2000",
    "tokenize_documents": f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _token_sql(_D).items())} FROM documents",
    "ngrams_benchmark": f"SELECT gram, count(*) AS n FROM (SELECT unnest({_D.grams('w', 2)}) AS gram FROM (SELECT unnest({_D.find('lower(text)', '[a-z]+')}) AS w FROM benchmark)) GROUP BY gram",
    "clean_documents": f"SELECT doc_id, CAST(length(__t) AS BIGINT) AS n FROM ({duck_steps(Detector('word_anomaly').plan(duck=True), 'SELECT doc_id, text AS __t FROM documents', 'doc_id, __t', 's')}) WHERE NOT coalesce(NOT ({_D.blank('__t')}) AND s >= 0.5, false)",
    "flag_rate_by_lang": f"SELECT lang, count(*) AS n, CAST(count(*) FILTER (flag) AS BIGINT) AS flagged, {_D.rounded('avg(score)')} AS mean_score FROM ({duck_ensemble(Ensemble(), 'documents', 'doc_id, lang')}) GROUP BY lang",
    "flag_rate_by_lang_source": f"SELECT lang, source, count(*) AS n, CAST(count(*) FILTER (flag) AS BIGINT) AS flagged, CAST(grouping(lang, source) AS BIGINT) AS level FROM ({duck_ensemble(Ensemble(), 'documents', 'doc_id, lang, source')}) GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())",
    "eval_confusion": _duck_rounded(_duck_metrics("strategy", "strategy", "")),
    "eval_by_lang": _duck_rounded(_duck_metrics("GROUPING SETS ((strategy, lang), (strategy, source), (strategy))", "strategy, lang, source", ", CAST(grouping(strategy, lang, source) AS BIGINT) AS level")),
    "eval_ranking": f"SELECT strategy, {_D.rounded('f1')} AS f1, {_D.rounded('precision')} AS precision, {_D.rounded('recall')} AS recall FROM ({_duck_metrics('strategy', 'strategy', '')})",
    "eval_source_gap": f"SELECT strategy, {_D.rounded('a')} AS f1_internal, {_D.rounded('b')} AS f1_external, {_D.rounded('a - b')} AS gap, CASE WHEN a - b > 0.15 THEN 'overfit' WHEN a - b < 0.05 THEN 'steady' ELSE 'some gap' END AS rating FROM (SELECT strategy, coalesce(max(f1) FILTER (source = 'src0'), 0.0) AS a, coalesce(avg(f1) FILTER (source <> 'src0'), 0.0) AS b FROM ({_duck_metrics('strategy, source', 'strategy, source', '')}) GROUP BY strategy) ORDER BY a DESC, strategy LIMIT 10",
    "misclassified_topk": f"SELECT strategy, doc_id, {_D.rounded('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY doc_id) AS rank FROM ({_CASES}) WHERE predicted <> expected) WHERE rank <= 5",
    "turn_garble_rate": f"SELECT role, count(*) AS n, CAST(count(*) FILTER (flag) AS BIGINT) AS flagged, {_D.rounded('avg(score)')} AS mean_score FROM ({duck_ensemble(Ensemble(), 'conversations', 'conv_id, turn, role')}) GROUP BY role",
    "word_grain_anomaly": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(w) - len(list_filter(w, lambda x: list_contains(dict, x))) AS BIGINT) AS unknown, {_D.rounded('s')} AS score FROM (SELECT *, {_D.known_steps('w', 'dict', lexicon.seed().words)[0][1]} AS dict FROM ({duck_steps(Detector('word_anomaly').plan(duck=True), 'SELECT doc_id, text AS __t FROM documents', 'doc_id, w', 's')}))",
    "lexicon_overlap": f"WITH a AS (SELECT word FROM ({_EN})), b AS (SELECT unnest([{', '.join(map(_D.lit, lexicon.seed().words))}]) AS word) SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'new', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'unused', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b)",
    "intake_verdicts": f"SELECT role, verdict, count(*) AS n FROM (SELECT role, CASE WHEN __t IS NULL THEN 'missing' WHEN {_D.blank('__t')} THEN 'blank' WHEN s >= 0.5 THEN 'garbled' ELSE 'ok' END AS verdict FROM ({duck_steps(Detector('log_likelihood_ratio').plan(duck=True), 'SELECT role, text AS __t FROM conversations', 'role, __t', 's')})) GROUP BY ALL",
}
