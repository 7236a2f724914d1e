import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid int, score string, n_words string, row string, contaminated string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and long texts, ties, repeats, and columns with clashing names."""
    rng = random.Random(7)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "x"), (8, "ab " * 4_000), (9, sentence(rng, 80) + " " + passage + " " + sentence(rng, 80)), (10, passage + "\n" + sentence(rng, 100)),
        (None, base), (11, "a" * 5_000), (11, "a" * 5_000), (12, "é" * 99 + " " + "é" * 300), (13, sentence(rng, 3_000)), (14, base.upper()), (15, "line one\nline two\nline one\n" * 20), (None, None), (16, "don't I'll 12345 　 ... \U0001f600 ok"),
    ]
    rows = [(i, t, "en" if k % 3 else None, "s", None, 5, "z", "w", "r", "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(1).sortWithinPartitions("doc_id")


@pytest.fixture(scope="session")
def awkward_table(awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    awkward.write.parquet(path)
    return awkward.sparkSession.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "x") for i in range(1, 17)] + [(None, 1, 1, "x"), (2, None, None, "x"), (99, 0, 0, "x"), (1, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
