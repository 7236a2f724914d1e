"""Rows keep their identity however scans are split."""

import pytest
from pyspark.sql import functions as F

from glyphsieve.llm import common, minhash, passages

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def moving(spark, monkeypatch):
    """From each cut to the next the session splits tables otherwise, as it does when executors come and go."""
    before, sizes = spark.conf.get(SPLIT), ["4000", "64m", "9000", "30000"]

    def cut(df, name):
        out = common.cut(df, name)
        sizes.append(sizes.pop(0))
        spark.conf.set(SPLIT, sizes[0])
        return out

    monkeypatch.setattr(minhash, "cut", cut)
    monkeypatch.setattr(passages, "cut", cut)
    yield
    spark.conf.set(SPLIT, before)


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "documents.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbers_hold(spark, files):
    before, got = spark.conf.get(SPLIT), []
    for docs in (files, files.select("text", "doc_id").where("doc_id > 3"), files.limit(50)):
        placed, row = common.numbered(docs)
        assert placed.columns == [*docs.columns, row] and row == "_row"
        for size in ("4000", "64m"):
            spark.conf.set(SPLIT, size)
            got.append(sorted((r["_row"], r["doc_id"]) for r in placed.collect()))
        spark.conf.set(SPLIT, before)
        assert got[-1] == got[-2] and len({r for r, _ in got[-1]}) == len(got[-1]) > 0


def test_near_duplicates_while_splits_change(files, moving, brute_near):
    got = minhash.classes(files).collect()
    assert len(got) == files.count() and {r["doc_id"]: r["class_id"] for r in got} == brute_near
    assert {r["doc_id"] for r in minhash.keep_first(files).collect()} == set(brute_near.values())


@pytest.fixture(scope="module")
def brute_near(files):
    """doc_id -> the least doc_id of its class, by comparing all pairs."""
    hashes, docs = minhash.WordHashes(), sorted((r["doc_id"], r["text"] or "") for r in files.select("doc_id", "text").collect())
    bags = [minhash.bag_of(t.lower().split(), hashes) for _, t in docs]
    top = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if top[i] != top[j] and min(len(bags[i][0]), len(bags[j][0])) and minhash.overlap(bags[i], bags[j]) >= minhash.SIMILARITY:
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    return {d: docs[t][0] for (d, _), t in zip(docs, top, strict=True)}


def test_passages_while_splits_change(spark, sf, files, moving):
    want = rows(passages.deduped(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars").coalesce(1)))
    assert rows(passages.deduped(files.select("doc_id", "text", "n_chars"))) == want
    docs = sorted((r["doc_id"], r["text"]) for r in files.where(F.col("text").isNotNull()).select("doc_id", "text").collect())
    seen, gone = set(), {}
    for i, t in docs:
        b = t.encode()
        hit = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                hit[j : j + 100] = b"\1" * 100
            seen.add(w)
        gone[i] = bytes(c for c, h in zip(b, hit, strict=True) if not h).decode("utf-8", "ignore")
    assert {r[0]: r[1] for r in want if r[0] in gone} == gone
