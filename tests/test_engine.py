"""Detectors, ensembles, lexicons, evaluation, SQL, streams, sources."""

import json

import pytest
from pyspark.sql import functions as F

from glyphsieve.functions.sql import register, register_explain
from glyphsieve.operators import evaluate, lexicon, scorers, wordgrain
from glyphsieve.operators.detector import Detector, Ensemble
from glyphsieve.sources.readers import read_corpus, report_text, texts_of, write_report
from glyphsieve.streaming.rates import flag_rate, scored


def flags(spark, detector, texts):
    rows = detector.transform(texts_of(spark, texts)).orderBy("at").collect()
    return [r["flag"] for r in rows], [r["score"] for r in rows]


@pytest.mark.parametrize("bad", [dict(threshold=-0.1), dict(threshold=1.5), dict(threads=0)])
def test_detector_rejects(bad):
    with pytest.raises(ValueError):
        Detector("entropy_based", **bad)


@pytest.mark.parametrize(
    ("name", "bad"),
    [("markov_chain", dict(threshold_per_char=1)), ("markov_chain", dict(min_length=0)), ("ngram_frequency", dict(common_ratio_threshold=2)), ("symbol_ratio", dict(min_length=-1)), ("zipf_conformity", dict(min_words=4)), ("hex_string", dict(hex_ratio_threshold=-1)), ("mojibake", dict(pattern_threshold=0))],
)
def test_parameters_rejected(name, bad):
    with pytest.raises(ValueError):
        Detector(name, **bad)


def test_unknown_scorer():
    with pytest.raises(NotImplementedError):
        Detector("nothing")


def test_column_must_be_text(spark):
    with pytest.raises(TypeError):
        Detector("entropy_based").transform(spark.range(3), "id")
    with pytest.raises(TypeError):
        texts_of(spark, ("a",))
    with pytest.raises(TypeError):
        texts_of(spark, ["a", 123])


def test_thresholds(spark):
    assert flags(spark, Detector("hex_string", 0.0), ["   ", "plain words here", None])[0] == [False, True, None]
    assert flags(spark, Detector("vowel_pattern", 0.7), ["aaaaaaa"])[0] == [True]


def test_column_and_frame_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d = Detector("word_anomaly")
    a = d.transform(docs).select("doc_id", "score", "flag")
    b = docs.select("doc_id", d.score("text").alias("score"), d.flag("text").alias("flag"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert d.clean(docs).count() == docs.where(~d.flag("text")).count()


def test_extra_columns_survive(spark):
    df = spark.createDataFrame([("bcdfghjklmn", 1, "x")], "text string, w int, n string")
    row = Detector("consonant_sequence").transform(df).first()
    assert (row["w"], row["n"], row["score"], row["flag"]) == (1, "x", 1.0, True)


@pytest.mark.parametrize("bad", [dict(voting="most"), dict(members=[]), dict(members=["mojibake"], voting="weighted"), dict(members=["mojibake"], weights=[1, 2]), dict(members=["mojibake"], weights=[-1]), dict(members=["mojibake"], weights=[0])])
def test_ensemble_rejects(bad):
    with pytest.raises(ValueError):
        Ensemble(**bad)


def test_ensemble_modes(spark):
    text = "qxjjxz bxcxdx"  # impossible pairs: 1; no hex: 0
    pair = ["bigram_probability", "hex_string"]
    for voting, score, flag in (("any", 1.0, True), ("all", 0.0, False), ("average", 0.5, True), ("majority", 0.5, False)):
        f, s = flags(spark, Ensemble(pair, voting), [text])
        assert (f[0], s[0]) == (flag, score), voting
    f, s = flags(spark, Ensemble(pair, "weighted", weights=[3.0, 1.0]), [text])
    assert (f[0], s[0]) == (True, 0.75)
    assert flags(spark, Ensemble(["bigram_probability"]), [text])[0] == [True]


def test_abstention(spark):
    f, s = flags(spark, Ensemble(["word_anomaly", "log_likelihood_ratio"]), ["a", None, "  "])
    assert f == [False, None, False] and s == [0.0, None, 0.0]
    assert flags(spark, Ensemble(["zipf_conformity", "bigram_probability"], "all"), ["qxjjxz"])[0] == [True]


def test_lexicon(spark, sf, tmp_path):
    corpus = spark.createDataFrame([("the cat the dog",), ("The end a",), (None,)], "text string")
    freq = {r["word"]: r["cnt"] for r in lexicon.word_frequencies(corpus).collect()}
    assert freq == {"the": 3, "cat": 1, "dog": 1, "end": 1}
    lex = lexicon.Lexicon.train(corpus, top_words=2, top_trigrams=1)
    assert lex.words == ("cat", "the") and lex.trigrams == ("the",) and len(lex.pairs) == 729
    lex.save(spark, str(tmp_path / "lex"))
    assert lexicon.Lexicon.load(spark, str(tmp_path / "lex")) == lex
    (tmp_path / "counts.tsv").write_text("The\t5\ncat\t2\nx1\t9\na\t7\n")
    assert sorted((r["word"], r["cnt"]) for r in lexicon.read_frequencies(spark, str(tmp_path / "counts.tsv")).collect()) == [("cat", 2), ("the", 5)]
    assert flags(spark, Detector("word_lookup", lexicon=lex), ["the cat", "dog"])[1] == [0.0, 1.0]


def test_evaluation(spark, tmp_path):
    corpus = {"test_cases": [{"category": "a", "cases": [{"text": "qxjjxz", "expected_garbled": True}, {"text": "plain text", "expected_garbled": False}]}, {"category": "b", "source": "ext", "cases": [{"text": "fine words", "expected_garbled": True}]}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    cases = read_corpus(spark, str(tmp_path / "c.json")).withColumn("case_id", F.monotonically_increasing_id())
    rows = evaluate.predictions(cases, ["bigram_probability", "hex_string"])
    m = {r["strategy"]: r for r in evaluate.metrics(rows, [["strategy"]]).collect()}
    assert (m["bigram_probability"]["tp"], m["bigram_probability"]["fn"], m["bigram_probability"]["tn"], m["bigram_probability"]["fp"]) == (1, 1, 1, 0)
    assert m["bigram_probability"]["f1"] == pytest.approx(2 / 3) and m["hex_string"]["f1"] == 0.0
    assert [r["strategy"] for r in evaluate.ranking(evaluate.metrics(rows, [["strategy"]])).collect()] == ["bigram_probability", "hex_string"]
    gap = evaluate.source_gap(evaluate.metrics(rows, [["strategy", "source"]]), "internal").first()
    assert gap["rating"] == "overfit"
    assert evaluate.misclassified(rows, "case_id", 1).count() == 2


def test_sql_functions(spark):
    names = register(spark, ["hex_string", "letter_position"])
    assert names == ["score_hex_string", "score_letter_position"]
    assert spark.sql("SELECT score_letter_position('wordj endq') AS s, score_hex_string(NULL) AS n").first().asDict() == {"s": 0.75, "n": None}


def test_streams_match_batches(spark, sf, tmp_path):
    source = f"{sf}/conversations.parquet"
    (tmp_path / "in").mkdir()
    batch = spark.read.parquet(source)
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    d = Detector("entropy_based")
    q = scored(stream, d).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    a, b = spark.table("scored").select("conv_id", "turn", "score"), d.transform(batch).select("conv_id", "turn", "score")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    timed = batch.withColumn("at", F.timestamp_seconds(F.col("turn") * 3600))
    rates = flag_rate(timed, d, "at").collect()
    assert sum(r["n"] for r in rates) == batch.where("text is not null").count()


def test_default_ensemble(spark):
    good = ["Hello world", "the quick brown fox", "The committee approved the annual budget yesterday"]
    assert flags(spark, Ensemble(), [*good, "xkqzv wpfjg mzxcv"])[0] == [False, False, False, True]
    three = Ensemble(["log_likelihood_ratio", "word_anomaly", "markov_chain"])
    assert flags(spark, three, ["xkqzv wpfjg mzxcv", "the quick brown fox"])[0] == [True, False]


def test_clashing_names(spark):
    """Columns that are named as the steps and helpers are come through as they were."""
    df = spark.createDataFrame([("xkqzv wpfjg mzxcv", 1, 2, 3, 4, 5, 6)], "text string, __t int, __x0_ int, __s0 int, __a0 int, __score int, __flag int")
    for out in (Ensemble().transform(df), Detector("word_anomaly").transform(df), Detector("hex_string").clean(df), Detector("hex_string").validate(df)):
        assert [out.first()[c] for c in df.columns] == list(df.first())


def test_shared_steps(spark):
    plan = Ensemble(["log_likelihood_ratio", "word_anomaly"]).transform(spark.createDataFrame([("a b",)], "text string"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_own_scorers(spark):
    import pandas as pd

    @scorers.column_scorer("test_shouting", share=0.5)
    def shouting(text, share):
        return F.when(F.regexp_count(text, F.lit("[A-Z]")) >= share * F.length(text), 1.0).otherwise(0.0)

    @F.pandas_udf("double")
    def length(texts: pd.Series) -> pd.Series:
        return (texts.str.len() / 10).clip(0, 1)

    scorers.column_scorer("test_length", applies=lambda t: F.length(t) > 3)(lambda text: length(text))
    try:
        texts = ["HELLO", "hello there", "", None, "A" * 1001]
        assert flags(spark, Detector("test_shouting"), texts)[1] == [1.0, 0.0, 0.0, None, 1.0]
        assert flags(spark, Detector("test_length"), ["hello", None])[1] == [0.5, None]
        assert flags(spark, Ensemble(["test_shouting", "test_length", "hex_string"], "average"), ["HELLO", "abc"])[1] == [0.5, 0.0]
        with pytest.raises(ValueError):
            scorers.column_scorer("test_shouting")(shouting)
    finally:
        del scorers.REGISTRY["test_shouting"], scorers.REGISTRY["test_length"]


def test_validate(spark):
    rows = Detector("log_likelihood_ratio").validate(texts_of(spark, ["fine words here", "xkqzv wpfjg mzxcv", "  ", None])).orderBy("at").collect()
    assert [r["verdict"] for r in rows] == ["ok", "garbled", "blank", "missing"]


def test_explain_text(spark):
    name = register_explain(spark, ["hex_string", "zipf_conformity", "letter_position"])
    rows = {r["strategy"]: (r["applicable"], r["score"], r["flag"]) for r in spark.sql(f"SELECT * FROM {name}('wordj endq')").collect()}
    assert rows == {"hex_string": (True, 0.0, False), "zipf_conformity": (False, 0.0, False), "letter_position": (True, 0.75, True)}
    texts_of(spark, ["wordj endq", "plain"]).createOrReplaceTempView("some_texts")
    assert spark.sql(f"SELECT at, e.* FROM some_texts, LATERAL {name}(text) e WHERE flag").count() == 1


def test_reports(spark, tmp_path):
    cases = spark.createDataFrame([("qxjjxz", True), ("plain text", False)], "text string, expected boolean")
    m = evaluate.metrics(evaluate.predictions(cases, ["bigram_probability", "hex_string"]), [["strategy"]])
    write_report(m, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).where("generated_at IS NOT NULL").count() == 2
    lines = report_text(m).splitlines()
    assert lines[0].endswith("UTC") and lines[2].startswith("bigram_probability") and len(lines) == 4
    took = {r["strategy"]: r["seconds"] for r in evaluate.elapsed(cases, ["hex_string"]).collect()}
    assert took["hex_string"] > 0


def test_word_grain(spark, sf):
    """Joins give what the expressions give."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a bc")], "doc_id bigint, text string"))
    a = {r["doc_id"]: r["score"] for r in wordgrain.anomaly(docs, "doc_id").collect()}
    b = {r["doc_id"]: r["score"] for r in Detector("word_anomaly").with_score(docs, "text", "score").collect()}
    assert a == b
    one, two = (spark.createDataFrame([(w,) for w in x], "word string") for x in ("ab", "bcc"))
    assert {k: sorted(r[0] for r in v.collect()) for k, v in wordgrain.vocabularies(one, two).items()} == {"both": ["b"], "new": ["a"], "unused": ["c"], "either": ["a", "b", "c"]}


def test_small_tables_are_spread(spark, sf):
    from glyphsieve.plans import queries

    docs = queries.table(spark, sf, "documents")
    assert queries.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    held, queries.BYTES_A_CORE = queries.BYTES_A_CORE, 1
    try:
        assert queries.spread(docs) is docs
    finally:
        queries.BYTES_A_CORE = held
