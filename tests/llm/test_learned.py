"""Operators that learn or estimate: held-out accuracy, estimators, links against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphsieve.llm import classifier, html, language, minhash, toxicity

SF = "/root/testdata/sf0.01"


def test_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)
    model = classifier.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9
    assert classifier.fit(x[:5], np.ones(5)).score(x[:3]) == pytest.approx([11 / 12] * 3)
    assert classifier.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def held_accuracy(rows, labels, label):
    marks = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    return np.mean([r["predicted"] == marks[r["doc_id"]] for r in held])


def test_quality(spark):
    rows = classifier.op2_quality(spark, SF).collect()
    assert held_accuracy(rows, spark.read.parquet(f"{SF}/labels.parquet"), "quality") > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity(spark):
    rows = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert held_accuracy(rows, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "toxic") > 0.98


def test_language(spark):
    rows = {r["doc_id"]: r for r in language.op9_language(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert len(held) > 100 and np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97


def test_learners_on_awkward_rows(awkward_table, none, labels):
    n = awkward_table.count()
    for out in (classifier.score(awkward_table, labels), classifier.score(awkward_table, labels.limit(0)), toxicity.score(awkward_table, labels), toxicity.score(awkward_table, labels.limit(0))):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.score(awkward_table, labels.limit(0)).collect()} == {0.5}
    from pyspark.sql import functions as F

    rows = language.predict(awkward_table, F.lit(True), F.lit(False)).collect()
    assert len(rows) == n and {r["lang_pred"] for r in rows} == {"und", "en"}
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {None, 4, 5, 6}
    assert language.predict(none, F.lit(True), F.lit(False)).count() == 0
    assert classifier.score(none, labels).count() == toxicity.score(none, labels).count() == 0


def all_segments(values):
    """Maximal-scoring runs by their definition: the best run (the shortest of equals), then both sides of it."""
    best = max(((sum(values[i:j]), i - j, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return all_segments(values[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in all_segments(values[j:])]


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        values = [float(rng.integers(1, 50)) / 7 + rng.random() * 1e-3 if rng.random() < 0.5 else -1.0 for _ in range(n)]
        at = [i for i, v in enumerate(values) if v > 0]
        got = [(a, b) for a, b, _ in toxicity.segments(at, [values[i] for i in at], 1.0)]
        assert got == all_segments(values)


def test_segments_with_own_scores():
    """Words that score below 0 by more or less than the gap; and time that follows length."""
    import time

    rng = np.random.default_rng(6)
    for _ in range(60):
        values = [float(rng.integers(-40, 50)) / 7 + rng.random() * 1e-3 if rng.random() < 0.7 else -1.0 for _ in range(int(rng.integers(1, 14)))]
        at = [i for i, v in enumerate(values) if v != -1.0]
        assert [(a, b) for a, b, _ in toxicity.segments(at, [values[i] for i in at], 1.0)] == all_segments(values)
    for scores in ([1.0 - k * 1e-6 for k in range(16_000)], [1.0] * 16_000, [(-1.2, 1.0)[k % 2] for k in range(16_000)]):
        began = time.perf_counter()
        toxicity.segments(list(range(0, 48_000, 3)), scores, 0.6)
        assert time.perf_counter() - began < 0.3


def test_calibration(spark):
    """The rate solves its equation over the words of clean documents; the fitted size gives clean documents E-values that hold."""
    import random

    rng = random.Random(3)
    usual, bad = [f"w{chr(97 + k)}" for k in range(26)], ["vile", "nasty", "foul"]
    rows = [(" ".join(rng.choices(usual, k=60) + (rng.choices(bad, k=6) if k % 4 == 0 else rng.choices(bad, k=1) if k % 9 == 0 else [])) + f" u{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", int(k % 4 == 0)) for k in range(600)]
    sample = spark.createDataFrame(rows, "text string, _y int").cache()
    model = toxicity.fit(sample)
    assert {"vile", "nasty", "foul"} <= {w for w, s in model.words.items() if s > 0}
    clean = [t for t, y in rows if not y]
    words = [w for t in clean for w in toxicity.tokens(t)]
    mean = np.mean([np.exp(model.rate * model.words.get(w, -model.gap)) for w in words])
    assert mean == pytest.approx(1.0, abs=0.02)
    best = [model.best(t) for t in clean]
    assert model.size == pytest.approx(len(best) / sum(n * np.exp(-model.rate * s) for n, s in best), rel=1e-9)
    got = model.score(np.array([model.evidence(*model.passages(t))[0] for t, _ in rows]))
    assert np.mean((got >= 0.5) == np.array([y for _, y in rows])) > 0.95


def test_flat_trees_against_recursion():
    """Scores by levels over flat arrays are those of walking each tree from its root; the first cut is the best of all cuts."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] + 0.3 * rng.normal(size=400) > 0.2).astype(float)
    model = classifier.fit(x, y, trees=12)
    binned = model.bins(x[:50])

    def walk(t, row, node=0):
        if node >= 2**model.depth - 1:
            return model.value[t][node - (2**model.depth - 1)]
        return walk(t, row, 2 * node + 1 + int(row[model.feature[t][node]] > model.cut_bin[t][node]))

    want = [1 / (1 + np.exp(-(model.base + sum(walk(t, r) for t in range(12))))) for r in binned]
    assert model.score(x[:50]) == pytest.approx(want)
    whole, p = model.bins(x), 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(400, p * (1 - p))

    def gain(j, c):
        left = whole[:, j] <= c
        if left.sum() < 8 or (~left).sum() < 8:
            return -1.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1.0)

    best = max(((gain(j, c), j, c) for j in range(5) for c in range(classifier.BINS)), key=lambda v: v[0])
    assert (model.feature[0][0], gain(model.feature[0][0], model.cut_bin[0][0])) == (best[1], pytest.approx(best[0]))


def test_kernel_ridge_against_the_full_solution():
    """With every text a landmark, scores are those of kernel ridge regression solved outright."""
    rng = np.random.default_rng(9)
    words = {"aa": ["uno", "dos", "tres", "gato"], "bb": ["one", "two", "three", "cat"], "cc": ["eins", "zwei", "drei", "katze"]}
    texts = [(name, " ".join(rng.choice(own, 6))) for name, own in words.items() for _ in range(8)]
    bits = np.stack([language.presence(t) for _, t in texts]).astype(float)
    x = np.stack([np.packbits(b.astype(np.uint8)) for b in bits])
    y = np.array([n for n, _ in texts])
    names, matrix = language.fit(x, y, landmarks=len(texts), ridge=1e-2)
    unit = bits / np.sqrt(bits.sum(1, keepdims=True))
    kernel, target = unit @ unit.T, np.where(y[:, None] == np.array(names)[None, :], 1.0, -1.0)
    want = kernel @ np.linalg.lstsq(kernel @ kernel + 1e-2 * len(y) * kernel, kernel @ target, rcond=1e-9)[0]
    assert unit @ matrix == pytest.approx(want, abs=2e-2)


def test_languages_are_bounded(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"word{chr(97 + k % 7)} here {k}", f"l{k % 5}") for k in range(400)] + [(7, "the same", "l0")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, _ = language.learn(docs, F.lit(True), max_languages=3)
    assert names == ["l0", "l1", "l2"]


def test_estimator_is_unbiased():
    rng = np.random.default_rng(1)
    for _ in range(3):
        a = rng.integers(0, 9, 150)
        b = np.maximum(0, a + rng.integers(-3, 4, 150))
        names = minhash.mix(np.arange(150, dtype=np.uint64))
        s = minhash.signatures(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[names[a > 0], names[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 8192)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def brute_classes(texts):
    hashes = minhash.WordHashes()
    bags = [Counter(minhash.shingle_hashes(hashes.of((t or "").lower().split()), 5).tolist()) for t in texts]
    where, top = defaultdict(list), list(range(len(bags)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, bag in enumerate(bags):
        common = Counter()
        for g, c in bag.items():
            for j in where[g]:
                common[j] += min(c, bags[j][g])
            where[g].append(i)
        for j, o in common.items():
            if o >= 0.8 * (sum(bag.values()) + sum(bags[j].values()) - o):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bags))]


def partition(keys):
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[k].append(i)
    return sorted(groups.values())


def test_near_duplicates(spark, awkward_table):
    near = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (awkward_table, near):
        rows = sorted(minhash.classes(docs).collect(), key=lambda r: r["uid"])
        from pyspark.sql import functions as F

        texts = [r["text"] for r in sorted(docs.select(F.monotonically_increasing_id().alias("u"), "text").collect(), key=lambda r: r["u"])]
        ids = {}
        for r in rows:
            ids.setdefault((r["class_id"], r["n_class"], r["class_id"] is None and r["uid"]), []).append(r)
        want = partition(brute_classes(texts))
        names = {u: k for k, group in enumerate(want) for u in group}
        got = defaultdict(set)
        for i, r in enumerate(rows):
            got[names[i]].add((r["class_id"], r["n_class"]))
        assert all(len(v) == 1 for v in got.values())
        assert all(next(iter(got[k]))[1] == len(group) for k, group in enumerate(want))
        assert sum(r["first"] for r in rows) == len(want)


def test_chains_of_near_copies(spark):
    """A group whose ends differ, held together by neighbours; and a hot group of copies."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, texts = [word() for _ in range(200)], []
    for _ in range(40):
        texts.append(" ".join(base))
        base[rng.randrange(200)] = word()
        base[rng.randrange(200)] = word()
    texts += [" ".join(word() for _ in range(50))] * 60 + [" ".join(word() for _ in range(50)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(minhash.classes(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["class_id"] for r in rows] == brute_classes(texts)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_classes(texts)))


def test_near_duplicates_of_nothing(none):
    assert minhash.classes(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A link</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and that is it</div>
<article><h1>A  title &amp; more</h1><p>The first paragraph of the text is <b>here</b>,<br>with a break.</p><div class="ad">Buy this now from the best of shops</div><p>Second&nbsp;one &lt;b&gt; is as <a href="#">linked</a> as it is.
<p>Unclosed third<form><input name=q><button>Go</button></form></article><!-- <p>no</p> --><aside>See the other things that are also here</aside><section id="comments"><p>I like this a lot, it is the best of them all</p></section><footer>&copy; all of it</footer></body></html>"""


def test_html():
    assert html.extract(PAGE) == "A title & more\nThe first paragraph of the text is here, with a break.\nSecond one <b> is as linked as it is.\nUnclosed third"
    assert html.extract(None) == html.extract("") == html.extract("<script>only</script>") == ""
    assert html.extract("just words in no markup at all") == "just words in no markup at all"
    assert html.extract("<p>a < b & c</p>") == "a < b & c"
    long = "It was the time of the year when all that is and was of them is in the way, as they had to be there with us. " * 3
    plain = f"<div><a href=x>One</a> <a href=y>Two</a></div><h2>Head</h2><div>{long}</div><p>Short one.</p><div>{long}</div><div><a href=z>More of this</a></div>"
    assert html.extract(plain).split("\n") == ["Head", long.strip(), "Short one.", long.strip()]


@pytest.mark.parametrize("mark", ['title="hidden gems"', 'alt="the hidden role"', 'data-id="ad-1"', 'data-role="banner"', 'class="share-price"', 'id="notice-board"', 'id="related-work"', "class='x' data-x='>'"])
def test_html_keeps_paragraphs(mark):
    assert html.extract(f"<article><p {mark}>Some words of it.</p></article>") == "Some words of it."


@pytest.mark.parametrize("mark", ['class="ad"', 'class="site-footer"', "id=ad-1", 'class="cookieNotice"', 'class="col related-posts"', 'role="banner"', "hidden", 'aria-hidden="true"', 'style="display: none"'])
def test_html_drops_marked_blocks(mark):
    assert html.extract(f"<article><p>First.</p><div {mark}>Some words of it.</div><p>Last.</p></article>") == "First.\nLast."


def test_html_layouts():
    inner = "<article><p>Some words of it.</p></article>"
    for mark in ('class="layout has-sidebar"', 'id="content-with-sidebar"', 'class="post social"'):
        assert html.extract(f"<div {mark}>{inner}</div>") == "Some words of it."
    assert html.extract(f'<section id="comments">{inner}</section><main><p>The text.</p></main>') == "The text."
    assert html.extract("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><noscript>shown</noscript></article><noscript>not</noscript>").startswith("let x=2 be")
    prose = "<p>It was the time of the year when all that is and was of them is in the way, as they had to be there with us.</p>"
    assert html.extract(prose * 2 + "<p><a href=x>More of these</a></p>").count("\n") == 1
    assert html.extract("one <two three <b>four</b> five <six") == "one four five <six"


@pytest.mark.parametrize("page", ["<p \"" * 64_000, "<b>" * 64_000 + "</i>" * 64_000, "<p a=\"" * 64_000, "<p x=\">" * 64_000, "<b>" * 64_000 + "<p></p>" * 64_000, "<span class=ad>" * 30_000 + "<div>" * 30_000, "<p " * 64_000 + "x=\">\"", "<!--" * 64_000])
def test_html_time_follows_length(page):
    import time

    began = time.perf_counter()
    html.extract(page)
    assert time.perf_counter() - began < 3


def test_second_pass():
    assert html.second_pass(["short", "good", "short", "good", "short", "bad", "near", "bad"]) == [True, True, True, True, True, False, False, False]
    assert html.second_pass([]) == [] and html.second_pass(["short", "near"]) == [True, True]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (2, None, None, 9), (None, "x", "<p" * 1000, 9)], "page_id bigint, url string, html string, n_chars int")
    rows = html.extract_pages(pages).collect()
    assert len(rows) == 4 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html.extract_pages(pages.limit(0)).count() == 0
