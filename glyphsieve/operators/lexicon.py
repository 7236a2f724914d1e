"""Lexicons: the words, letter-pair model and common trigrams that scorers consult, and their training from a corpus."""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import COLLOCATION_RULES, FUNCTION_WORDS

LETTERS = " abcdefghijklmnopqrstuvwxyz"
UNSEEN = -10_000_000


@dataclass(frozen=True)
class Lexicon:
    """words: known words. pairs: log-probabilities of the 27 * 27 pairs of LETTERS, in millionths. trigrams: common ones."""

    words: tuple[str, ...]
    pairs: tuple[int, ...]
    trigrams: tuple[str, ...]
    name: str = field(default="custom", compare=False)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(w,) for w in self.words], "word string").write.mode("overwrite").parquet(f"{path}/words")
        rows = [(LETTERS[i // 27] + LETTERS[i % 27], v) for i, v in enumerate(self.pairs)]
        spark.createDataFrame(rows, "bigram string, micro bigint").write.mode("overwrite").parquet(f"{path}/bigrams")
        spark.createDataFrame([(t,) for t in self.trigrams], "trigram string").write.mode("overwrite").parquet(f"{path}/trigrams")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        return cls.of(*(spark.read.parquet(f"{path}/{x}") for x in ("words", "bigrams", "trigrams")))

    @classmethod
    def of(cls, words: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> Lexicon:
        """From tables of bounded size: a vocabulary, 729 letter pairs, a list of trigrams."""
        micro = {r["bigram"]: r["micro"] for r in bigrams.select("bigram", "micro").collect()}
        pairs = tuple(micro.get(a + b, UNSEEN) for a in LETTERS for b in LETTERS)
        return cls(tuple(sorted(r["word"] for r in words.select("word").collect())), pairs, tuple(sorted(r["trigram"] for r in trigrams.select("trigram").collect())))

    @classmethod
    def train(cls, corpus: DataFrame, text_col: str = "text", top_words: int = 50_000, top_trigrams: int = 2_000) -> Lexicon:
        freq = word_frequencies(corpus, text_col)
        return cls.of(vocabulary(freq, top_words), bigram_model(freq), trigram_top(freq, top_trigrams))


def word_frequencies(corpus: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, cnt): lower-case ASCII words of at least `least` letters."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]+"), F.lit(0))).alias("word")
    return corpus.select(words).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("cnt"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, cnt) from a file of tab-separated words and counts; of repeated words the last line's count, taken as the largest position."""
    raw = spark.read.option("sep", "\t").schema("word string, cnt bigint").csv(path)
    good = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("word", F.lower("word")).where(F.col("word").rlike("^[a-z]{2,}$") & F.col("cnt").isNotNull())
    return good.groupBy("word").agg(F.max_by("cnt", "at").alias("cnt"))


def vocabulary(freq: DataFrame, top: int = 50_000) -> DataFrame:
    return freq.orderBy(F.desc("cnt"), "word").limit(top)


def _grams(freq: DataFrame, n: int, padded: bool) -> DataFrame:
    w = F.concat(F.lit(" "), "word", F.lit(" ")) if padded else F.col("word")
    at = F.expr(f"if(length(w) >= {n}, sequence(1, length(w) - {n - 1}), cast(array() as array<int>))")
    return freq.select(w.alias("w"), "cnt").select("cnt", "w", F.explode(at).alias("i")).select(F.expr(f"substring(w, i, {n})").alias("g"), "cnt").groupBy("g").agg(F.sum("cnt").alias("cnt"))


def bigram_model(freq: DataFrame) -> DataFrame:
    """(bigram, micro): Laplace-smoothed transitions over the 27 symbols, as whole millionths of the natural log."""
    grid = freq.sparkSession.createDataFrame([(a + b,) for a in LETTERS for b in LETTERS], "bigram string")  # 729 rows
    counts = grid.join(_grams(freq, 2, True), F.col("g") == F.col("bigram"), "left").select("bigram", (F.coalesce("cnt", F.lit(0)) + 1).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.substring("bigram", 1, 1)))
    return counts.select("bigram", F.round(F.log(share) * 1_000_000).cast("bigint").alias("micro"))


def trigram_top(freq: DataFrame, top: int = 2_000) -> DataFrame:
    return _grams(freq, 3, False).select(F.col("g").alias("trigram"), "cnt").orderBy(F.desc("cnt"), "trigram").limit(top)


CONSONANTS = "bcdfghjklmnpqrstvwxyz"
#: Where the shipped lexicon's words come from: a file of byte-pair ranks whose name `public_tokenizers.path` knows, or a path.
VOCABULARY = os.environ.get("GLYPHSIEVE_VOCABULARY", "byte_bpe_50k.tiktoken")


@cache
def ranked(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """The whole words, in their own case, of a byte-pair vocabulary, with their ranks: its tokens of a blank and two or more ASCII letters. Empty where the file isn't there."""
    if not os.path.exists(vocabulary):
        try:
            import public_tokenizers
        except ModuleNotFoundError:
            return {}
        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, "rb") as f:
        pairs = (line.split() for line in f)
        tokens = ((base64.b64decode(a), int(b)) for a, b in pairs)
        return {t[1:].decode(): r for t, r in tokens if re.fullmatch(rb" [A-Za-z]{2,}", t)}


def of_frequencies(words: dict[str, int], top_trigrams: int = 2_000, name: str = "custom") -> Lexicon:
    """The lexicon that train() gives for these words and counts, computed here: for word lists, not for corpora."""
    pair, tri = Counter(), Counter()
    for w, n in words.items():
        s = f" {w} "
        for i in range(len(s) - 1):
            pair[s[i : i + 2]] += n
        for i in range(len(w) - 2):
            tri[w[i : i + 3]] += n
    row = {a: sum(pair[a + b] + 1 for b in LETTERS) for a in LETTERS}
    pairs = tuple(round(math.log((pair[a + b] + 1) / row[a]) * 1_000_000) for a in LETTERS for b in LETTERS)
    common = sorted(tri.items(), key=lambda x: (-x[1], x[0]))[:top_trigrams]
    return Lexicon(tuple(sorted(words)), pairs, tuple(sorted(t for t, _ in common)), name)


@cache
def seed() -> Lexicon:
    """The lexicon that ships: the lower-case words of VOCABULARY, weighted by rank, and the words of the rules. Train one from a corpus for its language."""
    words: dict[str, int] = {}
    for w, r in ranked().items():
        if w == w.lower():
            words[w] = 30_000_000 // (r + 2_000)
    for w in [*FUNCTION_WORDS, *(w for sides in COLLOCATION_RULES for side in sides for w in side)]:
        if len(w) >= 2:
            words.setdefault(w, 1_000)
    return of_frequencies(words, name="seed")


@cache
def never_start() -> list[str]:
    """Pairs of letters that no word of the shipped lexicon starts with, in any case: two consonants, or q and a vowel."""
    seen = {w[:2].lower() for w in ranked()} | {w[:2] for w in seed().words}
    pairs = [a + b for a in CONSONANTS for b in CONSONANTS] + ["qa", "qe", "qi", "qo"]
    return sorted(p for p in pairs if p not in seen and p[0] != p[1])


@cache
def forbidden() -> list[str]:
    """Pairs of consonants, without y, that no word of the shipped lexicon holds, and q before any other vowel than u."""
    seen = {w[i : i + 2] for w in seed().words for i in range(len(w) - 1)}
    letters = CONSONANTS.replace("y", "")
    return sorted(p for p in [a + b for a in letters for b in letters] + ["qe", "qi", "qo", "qy"] if p not in seen)
