"""The relational path: words as rows, each distinct word scored once, lexicons as tables.

Scorers that work within a row need no shuffle and are the default. Where texts are many and their words few, or where a
lexicon is too large for an expression, the same scores come from joins: texts become (key, word, times), distinct words
meet the lexicon and the pair model, and their features go back by the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from .lexicon import Lexicon, seed
from .scorers import pair_total, plain


def words_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, times): the lower-case words a-z of each folded text."""
    return df.select(F.col(key), F.explode(F.expr(plain(Dialect(False), f"`{text}`"))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))


def features(words: DataFrame, lexicon: Lexicon | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, mean, known) of distinct words: the mean log-probability of a padded word's pairs, and whether vocabulary (word) has it."""
    q, lex = Dialect(False), lexicon or seed()
    if vocabulary is None:
        vocabulary = words.sparkSession.createDataFrame([(w,) for w in lex.words], "word string")
    scored = words.select("word").distinct().withColumn("mean", F.expr(f"CAST({pair_total(q, lex, "concat(' ', word, ' ')")} AS DOUBLE) / 1000000 / (length(word) + 1)"))
    return scored.join(vocabulary.select("word", F.lit(True).alias("_known")).distinct(), "word", "left").select("word", "mean", F.coalesce("_known", F.lit(False)).alias("known"))


def anomaly(df: DataFrame, key: str, text: str = "text", lexicon: Lexicon | None = None, threshold: float = -4.6, least: int = 4, weight: float = 2.0) -> DataFrame:
    """(key, words, unknown, score) of rows whose key is unique: how many words of `least` letters or more, how many of them no lexicon knows, and the word-anomaly score. Texts without such words have 0 of each; null texts a null score."""
    words = words_of(df, key, text).where(F.length("word") >= least)
    told = words.join(features(words, lexicon), "word").groupBy(key).agg(
        F.sum("times").alias("words"), F.sum(F.when(~F.col("known"), F.col("times")).otherwise(0)).alias("unknown"), F.sum(F.when(F.col("mean") < threshold, F.col("times")).otherwise(0)).alias("odd")
    )
    score = F.least(F.lit(1.0), weight * F.coalesce(F.try_divide("odd", "words"), F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return df.select(key, F.col(f"`{text}`").alias("_text")).join(told, key, "left").select(key, zero("words"), zero("unknown"), F.when(F.col("_text").isNotNull(), score).alias("score"))


def vocabularies(corpus: DataFrame, known: DataFrame, word: str = "word") -> dict[str, DataFrame]:
    """The words that both have, that only the corpus has, that only the lexicon has, and those of either."""
    a, b = corpus.select(word), known.select(word)
    return {"both": a.intersect(b), "new": a.subtract(b), "unused": b.subtract(a), "either": a.union(b).distinct()}
