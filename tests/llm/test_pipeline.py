"""The pipeline's stages, and the queries as registered."""

import hashlib
import re

import numpy as np

from glyphsieve.llm import bpe, quality_rules
from glyphsieve.llm.queries import QUERIES, SQL


def test_stages(spark, awkward_table, tmp_path, labels):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        if k + 1 < len(cp.STAGES):
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= n
        n = docs.count()
    assert cp.run(spark, d).count() == n


def brute_clean(text, items):
    """The text without its words in windows of one item; None where two items have windows in it."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    low, met, hit = lower(text), set(), set()
    spans = [m.span() for m in word.finditer(low)]
    own = [low[a:z] for a, z in spans]
    for item, other in items:
        w = word.findall(lower(other or ""))
        n = min(8, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(own) - n + 1):
            if tuple(own[k : k + n]) in windows:
                met.add(item)
                hit |= set(range(k, k + n))
    if len(met) >= 2:
        return None
    if not hit:
        return text
    ends = [0, *(z for _, z in spans)]
    return "".join(text[ends[k] : ends[k + 1]] for k in range(len(spans)) if k not in hit) + text[ends[-1] :]


def test_against_brute_force(spark):
    """All stages, each by a plain version, on one small table."""
    import corpus_pipeline as cp

    from .test_exact import brute_levels
    from .test_learned import brute_classes

    d = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet").collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in read("documents")), key=lambda r: r[0])
    levels: dict = {}
    for (s, good, k), n in brute_levels(read("documents"), read("labels")).items():
        levels.setdefault((s, good), [0] * (quality_rules.STEPS + 1))[k] += n
    steps = quality_rules.select_steps(levels, 4)

    def good(text):
        m = quality_rules.measure(text)
        s = sum(m[0] >= x for x in quality_rules.STRATA)
        values = dict(zip(quality_rules.RULES, m[5:], strict=True))
        return m[0] >= 50 and 100 * m[4] <= 50 * m[0] and not (s in steps and any(values[x] > quality_rules.GRIDS[x][steps[s]] for x in values))

    docs = [r for r in docs if good(r[1])]
    top = brute_classes([t for _, t in docs])
    docs = [r for k, r in enumerate(docs) if top[k] == k]
    seen, kept = set(), []
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept.append((i, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    items = [(r["item_id"], r["text"]) for r in read("benchmark")]
    left = [(i, c) for i, t in kept if (c := brute_clean(t, items)) is not None]
    vocabulary, pattern = bpe.public_vocabulary()
    enc, want = bpe._encoding(vocabulary, pattern), {}
    for i, t in left:
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in cp.run(spark, d).collect()} == want
    assert 0 < len(want) <= len(docs) < 200


def test_stages_on_awkward_rows(spark, awkward_table, tmp_path, labels):
    import corpus_pipeline as cp

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", None), ("b", "x y z")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in cp.STAGES:
        assert stage(spark, awkward_table, str(tmp_path)).count() > 0, name
        assert stage(spark, awkward_table.limit(0), str(tmp_path)).count() == 0, name


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(SQL) == {"op8_decontaminate", "op10_warc"}
