"""Scorers on examples: which texts they flag, hand-worked values, gates."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphsieve.functions import tables
from glyphsieve.operators.detector import Detector, all_scores
from glyphsieve.operators.lexicon import forbidden, never_start, seed
from glyphsieve.operators.scorers import REGISTRY, mojibake_patterns, scripts

FLAGGED = {
    "bigram_probability": ["qxjjxz", "bxcxdx", "qxjjxz zzqp xjq"],
    "rare_trigram": ["jjjqqq", "xqzjxq", "qxzqxz jqxwv"],
    "letter_position": ["wordj endq", "xjword bwtext", "zxqwj vbnmk"],
    "consonant_sequence": ["bcdfghjklmn", "xyzpqrstv", "XKCDQRTZPLM BLAH"],
    "vowel_pattern": ["aaaaaaa", "xy aeiouaeiou", "xy uuuuuaie"],
    "function_word_density": ["xkrf plmq bvzt nwsd jghc trbn mkpl wqzd lpnr fvxt"],
    "vowel_ratio": ["QWRTPZXCV KLMNBVCX", "zxcvbnm qwrtp", "aeiouaeiou"],
    "pattern_matching": ["asdfghjkl", "AAAAAAA"],
    "symbol_ratio": ["@#$%^&*!@#$"],
    "repetition": ["aaaaaaa", "test test test", "foo bar foo bar foo bar", "aaaaabbbbbaaaaabbbbb"],
    "hex_string": ["5d41402abc4b2a76b9719d911017c592", "aGVsbG8gd29ybGQgdGhpcyBpcw==", "4f8a9b2c1d3e5f6a7b8c9d0e"],
    "mojibake": ["cafÃ©", "donâ€™t worry itâ€™s fine", "Hello � world"],
    "unicode_script": ["pаypal", "hellο", "Hello WАrld"],
    "keyboard_adjacency": ["asdfgh jklqwe", "qwertyuiop"],
    "keyboard_pattern": ["asdfghjkl", "qwertyuiop zxcvbnm"],
    "pronounceability": ["xkcd qwfp zxcv", "bcdfghjklmnp qrstvwxyz"],
    "markov_chain": ["xzqkjhf", "bvnmxzq", "asdfghjkl", "qwertyuiop", "zxcvbnm", "aaaaaaaaa"],
    "ngram_frequency": ["xzqkjhf", "bvnmxzq", "asdfghjkl"],
    "log_likelihood_ratio": ["xkqzv wpfjg mzxcv", "wqpzjx mvnbtr"],
    "word_anomaly": ["xkqzv wpfjg mzxcv", "wqpzjx mvnbtr"],
    "word_lookup": ["xyzzy plugh", "asdfgh qwerty"],
}
PASSED = {
    "markov_chain": ["hello world", "the quick brown fox", "natural language processing"],
    "ngram_frequency": ["hello world", "the quick brown fox", "programming language", "hi"],
    "log_likelihood_ratio": ["the quick brown fox", "Hello there.", "Meeting at 3pm tomorrow.", "rhythms", "strength", "myths", "café résumé naïve"],
    "word_anomaly": ["the quick brown fox", "The committee approved the annual budget yesterday"],
    "entropy_based": ["the quick brown fox jumps over the lazy dog"],
    "word_lookup": ["hello world", "the quick brown fox", "computer science"],
    "bigram_probability": ["lynx", "50 sq ft", "radio jazz"],
    "letter_position": ["Nguyen", "FBI", "Mrs Nguyen met Mr McDonald in Iraq"],
    "consonant_sequence": ["strengths", "NASA FBI HTTP"],
    "vowel_pattern": ["queueing sequoia", "Hawaii oasis"],
    "function_word_density": ["The cat sat on the mat", "HTTP API REST"],
    "vowel_ratio": ["sky fly try dry", "the NHS and HTML docs", "123456789"],
    "pattern_matching": ["hello world"],
    "symbol_ratio": ["Call 555 867 5309", "Price: $19.99"],
    "repetition": ["name          value", "Section ----------", "it is what it is"],
    "hex_string": ["internationalization", "4111111111111111", "deed dad added a bad decade face"],
    "mojibake": ["café", "über schön"],
    "unicode_script": ["Привет hello", "これは日本語のテキストです", "Hello, World! 123"],
    "affix_detection": ["The programming language is incredibly powerful and usable"],
    "word_collocation": ["It is going to be a long day for the team"],
}
GOLDEN = [
    ("consonant_sequence", "bcdfghjklmn", 1.0),
    ("vowel_pattern", "aaaaaaa", 0.7),
    ("vowel_ratio", "aeiouaeiou", 1.0),
    ("bigram_probability", "qxjjxz", 1.0),
    ("rare_trigram", "jjjqqq", 1.0),
    ("letter_position", "wordj endq", 0.75),
    ("letter_position", "wordj", 0.4),
    ("pattern_matching", "asdfghjkl", 0.73),
    ("pattern_matching", "AAAAA", 0.73),
    ("pattern_matching", "AAAAAAA", 0.81),
    ("symbol_ratio", "!!!@@@###", 1.0),
    ("repetition", "aaaaaaaaaa", 1.0),
    ("hex_string", "5d41402abc4b2a76b9719d911017c592", 1.0),
    ("mojibake", "CafÃ©", 1.0),
    ("mojibake", "Hello � world", 0.85),
    ("unicode_script", "pаypal", 0.85),
    ("keyboard_adjacency", "asdfgh jklqwe", 0.8),
    ("function_word_density", "xkrf plmq bvzt nwsd jghc trbn mkpl wqzd lpnr fvxt", 0.8),
    ("word_collocation", "xkrf plmq bvzt nwsd jghc trbn mkpl wqzd lpnr fvxt qzml hkrp", 0.6),
    ("word_lookup", "xyzzy plugh", 1.0),
    ("zipf_conformity", " ".join(a + b + "zq" for a in "bcdfghj" for b in "klmnp"), 0.9),
]


def scores(spark, cases):
    """{(name, text): score} in one job for each scorer."""
    out = {}
    for name in {n for n, _ in cases}:
        texts = [t for n, t in cases if n == name]
        rows = Detector(name).with_score(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s").collect()
        out |= {(name, r["text"]): r["s"] for r in rows}
    return out


def test_all_there():
    assert len(REGISTRY) == 26
    assert {"xj", "zx", "vb"} <= set(never_start()) and not {"ng", "mr", "mc", "st"} & set(never_start())
    assert {"qz", "xj", "vk"} <= set(forbidden()) and not {"ct", "ng", "ck"} & set(forbidden())
    assert len(set(tables.FUNCTION_WORDS)) == 143 and len(set(tables.IMPOSSIBLE_BIGRAMS)) == 71
    assert len(mojibake_patterns()) == 24 and len(tables.HOMOGLYPHS) == 46 and len(scripts()) == 6
    assert len(seed().pairs) == 729 and len(seed().trigrams) == 2000 and len(seed().words) > 15_000


def test_examples(spark):
    cases = [(n, t) for n, ts in [*FLAGGED.items(), *PASSED.items()] for t in ts]
    got = scores(spark, cases)
    assert not [(n, t, got[n, t]) for n, ts in FLAGGED.items() for t in ts if got[n, t] < 0.5]
    assert not [(n, t, got[n, t]) for n, ts in PASSED.items() for t in ts if got[n, t] >= 0.5]


def test_golden(spark):
    got = scores(spark, [(n, t) for n, t, _ in GOLDEN])
    assert not [(n, t, got[n, t], v) for n, t, v in GOLDEN if abs(got[n, t] - v) > 1e-6]


def test_gates(spark):
    rows = [(0, None), (1, ""), (2, " \t  \n"), (3, "a" * 1001), (4, "a" * 1000), (5, "https://example.com/" + "a" * 1000), (6, "word\t" * 250)]
    got = {r["id"]: r for r in all_scores(spark.createDataFrame(rows, "id int, text string")).collect()}
    for name in REGISTRY:
        assert got[0][name] is None
        assert got[1][name] == got[2][name] == 0.0
        assert got[3][name] == 1.0
    assert got[5]["entropy_based"] < 1.0 and got[6]["symbol_ratio"] == 0.0
    short = Detector("entropy_based", max_string_length=500).with_score(spark.createDataFrame([("a" * 501,)], "text string"), "text", "s").first()["s"]
    assert short == 1.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=12))
def test_range_and_independence(spark, texts):
    """Scores lie in [0, 1] and depend on the row alone."""
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = ["entropy_based", "hex_string", "mojibake", "letter_position", "repetition", "symbol_ratio"]
    one = {r["id"]: r for r in all_scores(df, names=names).collect()}
    two = {r["id"]: r for r in all_scores(df.repartition(3), names=names).collect()}
    assert one == two
    assert all(0.0 <= r[n] <= 1.0 for r in one.values() for n in names)


@pytest.mark.parametrize("name", ["markov_chain", "zipf_conformity", "repetition", "unicode_script"])
def test_plans_stay_native(spark, sf, name):
    df = Detector(name).with_score(spark.read.parquet(f"{sf}/documents.parquet"), "text", "s").select("doc_id", "s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan  # only the columns that are used are read
