"""Operators whose results are exact, against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphsieve.llm import bpe, decontaminate, passages, quality_rules, suffixes, warc


def order_of(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def brute_passages(texts, width=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            w = b[j : j + width]
            if w in seen:
                gone[j : j + width] = b"\1" * width
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(spark, awkward_table):
    rows = order_of(awkward_table.select("doc_id", "text").collect())
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_passages([r["text"] for r in rows]), strict=True))
    own, cleaned = passages.dedup(awkward_table)
    got = own.join(cleaned, "uid").select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert Counter((r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in got) == want


def test_hot_passages(spark, tmp_path):
    """A passage, and a line that repeats, in many texts: dealt out by second keys, with the same result."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage, tail = " ".join(word() for _ in range(60)), "x" * 150
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 40))), passage if k % 3 else tail * 2, *(word() for _ in range(rng.randint(0, 40)))]) for k in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    want = Counter((k, *x) for k, x in enumerate(brute_passages(texts)))
    for gram, hot in ((32, 8), (16, 2), (32, 512)):
        own, cleaned = passages.dedup(spark.read.parquet(str(tmp_path / "d")), gram=gram, hot=hot)
        got = own.join(cleaned, "uid").select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
        assert Counter((r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in got) == want
    data = passage.encode()
    keys, at = passages._window_keys(np.frombuffer(data, np.uint8), 100, 32)
    n = int((keys == keys[0]).cumprod().sum())
    cut_up = list(passages._cut_up(5, 0, n, data[: n + 99], 100, 32))
    assert sum(w for _, _, w, _ in cut_up) == n and all(data[a : a + w + 99] == piece for _, a, w, piece in cut_up)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "abc", "b", "qqqq", "xyzzy"]), max_size=40).map("".join), min_size=1, max_size=6))
def test_windows_of_small_width(texts):
    """The bin's work alone: every segment in one bin, windows of 16 bytes keyed by 8-grams."""
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    which, key, first, size, twice = passages.segments(data, ends, 16, 8)
    gone = [bytearray(len(x)) for x in raw]
    if len(which):
        parts = [raw[w][f : f + n + 15] for w, f, n in zip(which, first, size, strict=True)]
        at = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
        seg, a, z = passages.repeated(which, which, key.view(np.int64), first, np.where(twice, -size, size), np.frombuffer(b"".join(parts), np.uint8), at, 16)
        for s, i, j in zip(seg, a, z, strict=True):
            lo, hi = first[s] + i, first[s] + j + 15
            gone[which[s]][lo:hi] = b"\1" * int(hi - lo)
    assert [sum(g) for g in gone] == [x[1] for x in brute_passages(texts, 16)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=30))
def test_mergesort(strings):
    raw = [s.encode() for s in strings]
    buf = suffixes.Buffer(np.frombuffer(b"".join(raw) + b"\0", np.uint8))
    size = np.array([len(x) for x in raw], np.int64)
    start, group = np.cumsum(size) - size, np.arange(len(raw)) % 2
    order = suffixes.mergesort(buf, group, start, size)
    assert [(group[i], raw[i]) for i in order] == sorted((int(g), x) for g, x in zip(group, raw, strict=True))
    runs = suffixes.equal_runs(buf, group, start, size)
    assert all((runs[i] == runs[j]) == ((group[i], raw[i]) == (group[j], raw[j])) for i in range(len(raw)) for j in range(i))


def test_lying_hashes_are_caught(monkeypatch):
    raw = b"abcdabcexxxx"
    buf = suffixes.Buffer(np.frombuffer(raw, np.uint8))
    monkeypatch.setattr(suffixes.Buffer, "same", lambda self, a, b, n: np.ones(len(a), bool))
    got = suffixes.equal_runs(buf, np.zeros(2, int), np.array([0, 4]), np.array([4, 4]))
    assert got[0] != got[1]


def test_passages_of_nothing(none):
    own, cleaned = passages.dedup(none)
    assert own.count() == cleaned.count() == 0
    assert passages.deduped(none).columns == none.columns


def test_deduped_keeps_columns(awkward_table):
    out = passages.deduped(awkward_table)
    assert out.columns == awkward_table.columns and out.count() == awkward_table.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    cov = {k + j for k in range(len(w) - 2) if g[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(text or ""))) if w else 0, len(lines) - len(set(lines)), len(cov)


def test_quality_counts(awkward_table, labels):
    for r in quality_rules.judge(awkward_table, labels).collect():
        matching = [brute_counts(x["text"]) for x in awkward_table.where(awkward_table["doc_id"].eqNullSafe(r["doc_id"])).collect()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) in matching
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def brute_levels(docs, labels):
    """(stratum, good) -> documents of each level, from the measures of each text alone."""
    marks = {}
    for r in labels:
        if r["doc_id"] is not None and r["quality"] is not None:
            marks[r["doc_id"]] = max(r["quality"], marks.get(r["doc_id"], 0))
    out = Counter()
    for r in docs:
        m = quality_rules.measure(r["text"])
        if r["doc_id"] not in marks or m[0] < 50 or 100 * m[4] > 50 * m[0]:
            continue
        values = dict(zip(quality_rules.RULES, m[5:], strict=True))
        first = next((k for k in range(quality_rules.STEPS) if any(values[x] > quality_rules.GRIDS[x][k] for x in values)), quality_rules.STEPS)
        out[sum(m[0] >= x for x in quality_rules.STRATA), marks[r["doc_id"]] > 0, first] += 1
    return out


def test_levels_and_verdicts(spark, awkward_table, labels):
    sf = "/root/testdata/sf0.01"
    tables = [(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), (awkward_table, labels)]
    for docs, marks in tables:
        got = quality_rules.holdout_levels(quality_rules.measures(docs), marks)
        want = brute_levels(docs.collect(), marks.collect())
        assert {(s, g, k): n for (s, g), row in got.items() for k, n in enumerate(row) if n} == dict(want)
        steps = quality_rules.select_steps(got, 4)
        judged = quality_rules.judge(docs, marks).collect()
        for r in judged:
            s = sum(r["n_words"] >= x for x in quality_rules.STRATA)
            over = s in steps and any(r[x] > quality_rules.GRIDS[x][steps[s]] for x in quality_rules.RULES)
            assert r["kept"] == (not r["base_failed"] and not over)
    assert set(quality_rules.select_steps(quality_rules.holdout_levels(quality_rules.measures(tables[0][0]), tables[0][1]), 4)) == {0, 1, 2, 3}


def test_risk_control():
    bound, steps = quality_rules.upper_bound, quality_rules.STEPS
    assert bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9) and bound(5, 5, 0.05) == 1.0
    row = lambda **at: [at.get(f"s{k}", 0) for k in range(steps)] + [at["none"]]
    assert not quality_rules.select_steps({(0, True): row(none=50), (0, False): row(s0=9, none=0)}, 1)  # too few good ones to certify anything
    many = {(0, True): row(s1=3, s2=50_000, none=50_000), (0, False): row(s0=9, s1=40, s2=90, none=0)}
    assert quality_rules.select_steps(many, 1) == {0: 1}
    assert not quality_rules.select_steps({(0, True): row(s0=1, none=99_999), (0, False): row(s0=1, none=0)}, 1)  # no benefit
    assert quality_rules.merged_strata([10, 1000, 20, 700]) == [[0, 1], [2, 3]] and quality_rules.merged_strata([5, 5]) == [[0, 1]] and quality_rules.merged_strata([900, 900]) == [[0], [1]]
    small = {(0, True): row(none=200), (0, False): row(s3=8, none=0), (1, True): row(none=200), (1, False): row(s4=5, none=0)}
    assert quality_rules.select_steps(small, 2) == {0: 4, 1: 4}


def test_risk_holds():
    """Over many holdouts, the chosen steps reject more good documents than allowed in a share of at most delta."""
    rng, risk, delta, broken = np.random.default_rng(4), 0.02, 0.2, 0
    share = np.r_[np.linspace(0, 0.004, quality_rules.STEPS), 0]
    share[-1] = 1 - share.sum()
    for _ in range(400):
        levels = {(s, True): rng.multinomial(600, share).tolist() for s in range(2)} | {(s, False): [5] * (quality_rules.STEPS + 1) for s in range(2)}
        chosen = quality_rules.select_steps(levels, 2, risk, delta)
        broken += any(share[: k + 1].sum() > risk for k in chosen.values())
    assert broken / 400 <= delta


def test_quality_of_nothing(none, labels, awkward_table):
    assert quality_rules.judge(none, labels).count() == 0
    kept = quality_rules.keep(awkward_table, labels.limit(0))
    assert kept.columns == awkward_table.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 9, 13}


def test_bpe(awkward_table):
    vocabulary, pattern = bpe.public_vocabulary()
    enc = bpe._encoding(vocabulary, pattern)

    def want(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    expected = Counter((r["doc_id"], *want(r["text"])) for r in awkward_table.collect())
    for chunk, overlap, task in ((4_096, 256, 262_144), (700, 40, 262_144), (64, 16, 262_144), (4_096, 256, 5_000), (200, 30, 0)):
        got = bpe.digests(awkward_table, vocabulary, pattern, chunk_chars=chunk, overlap=overlap, task_chars=task).collect()
        assert Counter(tuple(r) for r in got) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab  \n\t'1.é\u3000\U0001f600Z"), max_size=200), st.integers(2, 20))
def test_pieces_encode_as_their_text(text, chunk):
    import regex

    vocabulary, pattern = bpe.public_vocabulary()
    enc = bpe._encoding(vocabulary, pattern)
    parts = bpe.text_pieces(regex.compile(pattern), text, chunk, max(1, chunk // 2))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_of_nothing(none):
    assert bpe.digests(none, *bpe.public_vocabulary()).count() == 0


def duck(spark_frames, sql):
    con = duckdb.connect()
    for name, df in spark_frames.items():
        con.register(name, df.toPandas())
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("limit", [64 << 20, 4_000])
def test_decontaminate(spark, awkward_table, limit):
    rows = awkward_table.select("doc_id", "text").collect()
    w = (rows[[r["doc_id"] for r in rows].index(9)]["text"]).split()
    bench = spark.createDataFrame([("a", " ".join(w[5:30])), ("b", " ".join(w[40:47])), ("b", " ".join(w[40:47])), ("c", None), ("d", "--"), (None, " ".join(w[:20])), ("e", "x"), ("f", " ".join(w[12:21]).upper())], "item_id string, text string")
    got = decontaminate.report(decontaminate.hits(awkward_table, bench, max_broadcast_bytes=limit)).drop("uid", "spans").collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(k, r["text"]) for k, r in enumerate(rows)])
    con.execute("create table benchmark (item_id varchar, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", [tuple(r) for r in bench.collect()])
    want = con.sql(decontaminate.OP8_SQL).fetchall()
    assert Counter(tuple(r) for r in got) == Counter((rows[x[0]]["doc_id"], *x[1:]) for x in want)
    assert any(r["contaminated"] for r in got)


def test_scrub(spark):
    docs = spark.createDataFrame([(1, "Aa b, c d! E f g h. i j", "x", 3), (2, None, "y", 0), (3, "q  aa B c; d e f g h z", "z", 9), (4, "left alone", "u", 10)], "doc_id bigint, text string, contaminated string, n_chars int")
    bench = spark.createDataFrame([("k", "AA b c d e f g h")], "item_id string, text string")
    got = {r["doc_id"]: (r["text"], r["contaminated"], r["n_chars"]) for r in decontaminate.clean(docs, bench).collect()}
    assert got == {1: (". i j", "x", 5), 2: (None, "y", 0), 3: ("q z", "z", 3), 4: ("left alone", "u", 10)}
    both = bench.union(spark.createDataFrame([("m", "left alone"), ("n", "alone")], bench.schema))
    assert 4 not in {r["doc_id"] for r in decontaminate.clean(docs, both).collect()}
    assert decontaminate.clean(docs, bench.limit(0)).count() == 4


def test_scrub_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Aa b, c d! E f g h. i j", "r", "u", "c", "s", "h", "k")], "doc_id bigint, text string, _row string, _uid string, _contaminated string, _spans string, _held string, _kept string")
    bench = spark.createDataFrame([("k", "AA b c d e f g h")], "item_id string, text string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and tuple(out.first()) == (1, ". i j", "r", "u", "c", "s", "h", "k")


def test_decontaminate_nothing(none, spark):
    empty = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.report(decontaminate.hits(none, empty)).count() == 0


def test_warc(spark):
    big = "<p>" + "long page " * 200 + "</p>"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "u", None), (5, "u", None), (6, "x y\r\n", "small"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40), (None, "n", big), (8, "é", "ü" * 5000), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnRenamed("x", "x")
    got = Counter(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and h == big and i != 3
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    back = {r["page_id"]: r["payload"] for r in warc.round_trip(pages).where("page_id in (7, 8)").collect()}
    assert back[7].decode() == rows[6][2] and back[8].decode() == rows[8][2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_stream_of_members(tmp_path):
    import gzip
    import io

    raw = [warc.record(i, "u", b"x" * (i * 1000), None, False) for i in range(5)]
    for data in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        assert list(warc.records(io.BytesIO(data))) == raw
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"".join(raw)[:-10]))))
