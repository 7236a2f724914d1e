"""Near-duplicates by BagMinHash signatures of word shingles.

A document is a bag of five-word shingles, weighted by how often they stand in it. Weights are discretised at the
integers; each shingle owns a Poisson process of points (time, register) on every interval of weight, the intervals
above 2 being halved as far down as a weight asks. A register keeps the earliest point of all that lie below the bag's
weights, so two bags agree in a register with the probability of their weighted Jaccard similarity. Points are drawn
for all shingles of a batch at once, only while they can still lower a register.

Runs of registers make bands; documents that share a band meet in a bucket. Buckets are not expanded into pairs. In
rounds, all members of a bucket are held against its leader, the one that meets the most other documents, and those that
do not join the leader's class choose the next. Where classes still meet in a bucket, members that can have a link to
another class, by the exact weight that their bags share with it, are joined by prefixes of their rarest shared shingles.
Every link is verified on the bags themselves. Classes are the connected components.

Words are runs of characters other than white space, lower-cased. Texts with the same words count as one bag, whatever
their number. Defined results: a text of one to four words is one shingle; a text without words is in a class of its
own; rows that repeat their doc_id share a class if their texts do; a class is named by its least doc_id (null ids
last); only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHashes, cut, mix, numbered, remove, shingle_hashes, table

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
BANDS = 25
ROWS = 5
#: Sketches of 128 bits: at similarity 0.8 a mean of 12.8 bits differ, with a deviation of 3.4; more than this many mean less than 0.8.
MAX_BITS = 29
#: Row numbers of texts that meet others are broadcast up to this many (8 bytes each); beyond, they are joined by shuffling.
MAX_BROADCAST_ROWS = 2_000_000
#: Rounds of leaders before what is left of a bucket is held against what can have a link there.
ROUNDS = 2


def _intervals(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each weight the intervals that it fills: (index of the weight, node, rate). Node 2**k is the interval (2**(k-1), 2**k] and 1 the first unit."""
    index, node, rate = [np.arange(len(counts))], [np.zeros(len(counts), np.int64)], [np.ones(len(counts))]
    level = 0
    while True:
        full = np.flatnonzero(counts >= 2 << level)
        if not len(full):
            break
        index.append(full)
        node.append(np.full(len(full), level + 1))
        rate.append(np.full(len(full), float(1 << level)))
        level += 1
    return np.concatenate(index), np.concatenate(node), np.concatenate(rate)


def _partial(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights that end within an interval: (index, node, the width filled of the interval's)."""
    top = np.frexp(counts.astype(np.float64))[1] - 1  # floor of log2
    rest = counts - (1 << top)
    index = np.flatnonzero(rest > 0)
    return index, top[index] + 1, rest[index]


def signatures(bag: np.ndarray, shingle: np.ndarray, count: np.ndarray, bags: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers' earliest times, a row a bag; rows of bags without shingles are infinite."""
    least = np.full(bags * registers, np.inf)
    f_index, f_node, f_rate = _intervals(count)
    p_index, p_node, p_fill = _partial(count)
    index = np.r_[f_index, p_index]
    node = np.r_[f_node, p_node]
    rate = np.r_[f_rate, np.ldexp(1.0, p_node - 1)]
    fill = np.r_[np.full(len(f_index), -1), p_fill]  # -1: all of the interval
    seed = mix(shingle[index] ^ (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    own = bag[index]
    time = np.zeros(len(index))
    step = 0
    while len(index):
        step += 1
        draw = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        place = own * registers + (draw & np.uint64(registers - 1)).astype(np.int64)
        inside = _inside(draw, node, fill)
        np.minimum.at(least, place[inside], time[inside])
        worst = least.reshape(bags, registers).max(1)
        live = time < worst[own]
        seed, own, time, rate, node, fill, index = (x[live] for x in (seed, own, time, rate, node, fill, index))
    return least.reshape(bags, registers)


def _inside(draw: np.ndarray, node: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Whether points fall in the filled part of their interval: down the halves, a coin for each, until a half is filled or empty."""
    ok = fill < 0
    open_ = np.flatnonzero(~ok)
    if len(open_):
        width, left = np.int64(1) << (node[open_] - 1), fill[open_].astype(np.int64)
        coins, level = mix(draw[open_] ^ np.uint64(0xA0761D6478BD642F)), 0
        while len(open_):
            half = width >> 1
            low = (coins >> np.uint64(level)) & np.uint64(1) == 0
            full = low & (left >= half)
            gone = ~low & (left <= half)
            ok[open_[full]] = True
            left = np.where(low, left, left - half)
            stay = ~(full | gone)
            open_, width, left, coins, level = open_[stay], half[stay], left[stay], coins[stay], level + 1
    return ok


def bag_of(words: list[str], hashes: WordHashes, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, in order, and how often each stands in it."""
    return np.unique(shingle_hashes(hashes.of(words), width), return_counts=True)


def _signature_rows(bands: int, rows: int, registers: int, kind):
    """rows (uid, doc_id, text) -> rows (uid, doc_id, sum, n, bands, s1, s2)."""
    kind = to_arrow_type(kind)

    def emit(ids, names, sums, bags):
        sizes = np.array([len(s) for s, _ in bags])
        shingle = np.concatenate([s for s, _ in bags]) if bags else np.empty(0, np.uint64)
        count = np.concatenate([c for _, c in bags]).astype(np.int64) if bags else np.empty(0, np.int64)
        times = signatures(np.repeat(np.arange(len(bags)), sizes), shingle, count, len(bags), registers)
        marks = mix(times.view(np.uint64))
        out = np.empty((len(bags), bands), np.uint64)
        for k in range(bands):
            h = np.full(len(bags), k + 1, np.uint64)
            for j in range(k * rows, (k + 1) * rows):
                h = mix(h ^ marks[:, j])
            out[:, k] = h
        bits = np.packbits((marks & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        n = np.array([int(c.sum()) for _, c in bags], np.int64)
        has = n > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(names, kind), pa.array(sums, pa.string()), pa.array(n), pa.array([x if h else [] for x, h in zip(out.view(np.int64), has, strict=True)], pa.list_(pa.int64())), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
            ["uid", "doc_id", "sum", "n", "bands", "s1", "s2"],
        )

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            ids, names, sums, bags, weight = [], [], [], [], 0
            for uid, name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = (t.as_py() or "").lower().split()
                ids.append(uid)
                names.append(name)
                # without words, a sum of its own
                sums.append(xxhash.xxh3_128_hexdigest(" ".join(words)) if words else f"-{uid}")
                bags.append(bag_of(words, hashes))
                weight += len(words)
                if weight > 100_000 or len(bags) >= 500:
                    yield emit(ids, names, sums, bags)
                    ids, names, sums, bags, weight = [], [], [], [], 0
            if ids:
                yield emit(ids, names, sums, bags)

    return run


def overlap(a: tuple, b: tuple) -> float:
    """The weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum()) + int(b[1].sum()) - common)


def _verify_rows(similarity: float):
    """rows (a, b, text_a, text_b) -> rows (a, b) of those pairs that are similar enough."""

    def run(batches):
        hashes, kept = WordHashes(), {}

        def bag(i, t):
            if i not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[i] = bag_of(t.as_py().lower().split(), hashes)
            return kept[i]

        for rows in batches:
            good = []
            for a, b, s, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), rows.column(3), strict=True):
                if overlap(bag(a, s), bag(b, t)) >= similarity:
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose texts (uid, text) are similar enough."""
    one = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify_rows(similarity), "a bigint, b bigint")


def _shingle_rows(batches):
    """rows (uid, text) -> rows (uid, g, c): the distinct shingles of each text and how often each stands in it."""
    hashes = WordHashes()
    for rows in batches:
        for uid, t in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            g, c = bag_of(t.as_py().lower().split(), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), uid)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["uid", "g", "c"])


def components(links: DataFrame) -> DataFrame:
    """(uid, top): for each node of links (a, b), the least node that it is connected to. Alternates large-star and small-star steps until nothing changes; no node's links gather in one task."""
    edges, at = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_at = cut(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        small, small_at = cut(small, "edges")
        # a forest of stars: every node has one link, and no centre has one
        loose = small.groupBy("u").count().where("count > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        remove(links.sparkSession, at, large_at)
        edges, at = small, small_at
        if not loose:
            return edges.select(F.col("u").alias("uid"), F.col("v").alias("top"))


def merged(tops: DataFrame | None, links: DataFrame) -> DataFrame:
    """(uid, top) after more links (a, b): only the centres that they touch are worked on again."""
    if tops is None:
        return components(links)
    own = lambda x: tops.select(F.col("uid").alias(x), F.col("top").alias(f"top_{x}"))
    centres = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b")).where("a <> b").distinct()
    centres, centres_at = cut(centres, "centres")
    moved = components(centres)
    remove(links.sparkSession, centres_at)
    again = tops.join(moved.select(F.col("uid").alias("top"), F.col("top").alias("to")), "top", "left").select("uid", F.coalesce("to", "top").alias("top"))
    return cut(again.union(moved), "tops")[0]


def with_top(rows: DataFrame, tops: DataFrame | None, uid: str = "uid", top: str = "top") -> DataFrame:
    """rows with the class that uid belongs to, its own where no link touches it."""
    if tops is None:
        return rows.withColumn(top, F.col(uid))
    return rows.join(tops.select(F.col("uid").alias(uid), F.col("top").alias("_top")), uid, "left").withColumn(top, F.coalesce("_top", uid)).drop("_top")


def leader_round(members: DataFrame, texts: DataFrame, tops: DataFrame | None, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Hold all members (bucket, uid, weight) of a bucket against its leader, the heaviest of them. Returns the members that aren't of their leader's class after that, and the classes. Rows follow members, whatever a bucket's size."""
    leads = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("uid")).alias("order"))).alias("lead"), F.count("*").alias("size")).where("size > 1").select("bucket", (-F.col("lead.order")).alias("lead"))
    met = members.join(leads, "bucket").where("uid <> lead")
    met, met_at = cut(with_top(with_top(met, tops), tops, "lead", "lead_top"), "met")
    links, links_at = cut(verified(met.where("top <> lead_top").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct(), texts, similarity), "links")
    if not links.isEmpty():
        tops = merged(tops, links)
    rest = with_top(with_top(met.select("bucket", "uid", "weight", "lead"), tops), tops, "lead", "lead_top").where("top <> lead_top").select("bucket", "uid", "weight")
    rest, _ = cut(rest, "rest")
    remove(members.sparkSession, met_at, links_at)
    return rest, tops


def _prefix_rows(similarity: float):
    """rows (uid, top, n, least_n, s1, s2, items) -> rows (uid, top, n, s1, s2, g, longer). items: the shingles (k, g, c) that other classes have, k texts have it, c times it stands here."""

    def run(batches):
        for b in batches:
            out = []
            for uid, top, n, least, s1, s2, items in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                items.sort(key=lambda x: (x["k"], x["g"]))
                total = sum(x["c"] for x in items)
                # the overlap that a partner as long or longer, and one that is shorter, must have at least
                for longer, other in ((False, n), (True, max(similarity * n, least))):
                    spare, seen = total - similarity * (n + other) / (1 + similarity) + 1e-6, 0
                    for x in items:
                        if seen > spare:
                            break
                        out.append((uid, top, n, s1, s2, x["g"], longer))
                        seen += x["c"]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["uid", "top", "n", "s1", "s2", "g", "longer"])

    return run


def closing_pairs(members: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (bucket, uid, n, top, least_n) of different classes among which are all that are similar enough.

    Two bags share at most what each shares with any text of another class: members that share too little with all of
    them go, first by the shingles that no other member has, then by those that only the own class has. The rest are
    joined by prefixes: of the shingles that other classes have, rarest first, those that two bags of these lengths
    cannot both miss. Lengths and one-bit sketches thin the pairs out.
    """
    spark = members.sparkSession
    one, one_at = cut(members.groupBy("uid").agg(F.first("top").alias("top"), F.first("n").alias("n"), F.min("least_n").alias("least_n")), "one")
    shingles = lambda of: texts.join(of.select("uid"), "uid", "left_semi").select("uid", "text").mapInArrow(_shingle_rows, "uid bigint, g bigint, c bigint")
    alone = shingles(one).groupBy("g").agg(F.count("*").alias("k"), F.min("uid").alias("uid"), F.min("c").alias("c")).where("k = 1").groupBy("uid").agg(F.sum("c").alias("alone"))
    can = lambda m: (1 + similarity) * m >= similarity * (F.col("n") + F.greatest(F.lit(similarity) * F.col("n"), F.col("least_n"))) - 1e-6
    first = one.join(alone, "uid", "left").where(can(F.col("n") - F.coalesce("alone", F.lit(0)))).drop("alone")
    first, first_at = cut(first, "first")
    left, left_at = cut(shingles(first).join(first, "uid"), "left")
    other = left.groupBy("g").agg(F.min("top").alias("x"), F.max("top").alias("y"), F.count("*").alias("k")).where("x <> y").select("g", "k")
    bags = left.join(other, "g").groupBy("uid").agg(F.first("top").alias("top"), F.first("n").alias("n"), F.first("least_n").alias("least_n"), F.sum("c").alias("shared"), F.collect_list(F.struct("k", "g", "c")).alias("items"))
    bags = bags.where(can(F.col("shared"))).join(sketches, "uid").select("uid", "top", "n", "least_n", "s1", "s2", "items")
    prefixes, prefixes_at = cut(bags.mapInArrow(_prefix_rows(similarity), "uid bigint, top bigint, n bigint, s1 bigint, s2 bigint, g bigint, longer boolean"), "prefixes")
    x, y = prefixes.where("NOT longer").drop("longer"), prefixes.select("g", "longer", *(F.col(c).alias(c + "_y") for c in ("uid", "top", "n", "s1", "s2")))
    near = (F.col("top") != F.col("top_y")) & F.expr(f"bit_count(s1 ^ s1_y) + bit_count(s2 ^ s2_y) <= {MAX_BITS}")
    pair = (F.col("uid").alias("a"), F.col("uid_y").alias("b"))
    same = x.join(y.where("NOT longer").withColumnRenamed("n_y", "n"), ["g", "n"]).where(near & (F.col("uid") < F.col("uid_y"))).select(*pair)
    shorter = x.join(y.where("longer"), "g").where(near & (F.col("n") < F.col("n_y")) & (F.col("n") >= similarity * F.col("n_y") - 1e-6)).select(*pair)
    out, _ = cut(same.union(shorter).distinct(), "closing")
    remove(spark, one_at, first_at, left_at, prefixes_at)
    return out


def linked(single: DataFrame, base: DataFrame, similarity: float) -> DataFrame | None:
    """(uid, top) of the texts in single (uid, n, bands, s1, s2) that a link joins to another, by rounds of leaders in each bucket; None without a link."""
    spark = single.sparkSession
    bands, bands_at = cut(single.select("uid", "n", F.explode("bands").alias("bucket")), "bands")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared, shared_at = cut(bands.join(sizes, "bucket"), "shared")
    remove(spark, bands_at)
    # the text that meets the most others leads: of a text and its edited copies, the text
    weights = shared.groupBy("uid").agg(F.sum("size").alias("weight"))
    members, members_at = cut(shared.drop("size").join(weights, "uid").select("bucket", "uid", "n", "weight"), "weighed")
    met, met_at = cut(members.select("uid").distinct(), "met")
    texts, texts_at = cut(base.select("uid", "text").join(F.broadcast(met) if met.count() <= MAX_BROADCAST_ROWS else met, "uid", "left_semi"), "texts")
    remove(spark, shared_at, met_at)
    rest, tops = members.drop("n"), None
    for _ in range(ROUNDS):
        rest, tops = leader_round(rest, texts, tops, similarity)
        if rest.isEmpty():
            break
    # buckets in which classes meet whose members were not all held against each other
    known, known_at = cut(with_top(members.drop("weight"), tops), "known")
    split = known.groupBy("bucket").agg(F.min("top").alias("x"), F.max("top").alias("y"), F.count("*").alias("size"), F.min("n").alias("least_n")).where("x <> y AND size > 2").select("bucket", "least_n")
    closing = closing_pairs(known.join(split, "bucket"), single.select("uid", "s1", "s2"), texts, similarity)
    links, links_at = cut(verified(closing, texts, similarity), "links")
    if not links.isEmpty():
        tops = merged(tops, links)
    remove(spark, members_at, texts_at, known_at, links_at)
    return tops


def hot_join(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with facts, which have each key once and how many rows have it. Keys of a thousandth of all rows or more, a thousand keys at most, are broadcast, so that no task gets all rows of one."""
    most = max(1_000, total // 1_000)
    hot = F.broadcast(facts.where(F.col(size) >= most))
    marked = rows.join(hot.select(key, F.lit(True).alias("_hot")), key, "left")
    few = marked.where("_hot").drop("_hot").join(hot, key)
    return few.unionByName(marked.where("_hot IS NULL").drop("_hot").join(facts.where(F.col(size) < most), key))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> DataFrame:
    """A row per document: uid, doc_id, class_id (the least doc_id of its class), n_class, and first: whether it is the class's first."""
    placed, row = numbered(docs)
    return _classes(placed, row, id_col, text_col, similarity, bands, rows, registers)


def _classes(docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> DataFrame:
    """classes() of documents whose rows the column `row` numbers."""
    spark = docs.sparkSession
    base = docs.select(F.col(row).alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signed = base.mapInArrow(_signature_rows(bands, rows, registers, docs.schema[id_col].dataType), f"uid bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, sum string, n bigint, bands array<bigint>, s1 bigint, s2 bigint")
    signed, signed_at = cut(signed, "signed")
    total = signed.count()
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    single = signed.groupBy("sum").agg(F.min("uid").alias("uid"), F.min(order).alias("least"), F.count("*").alias("n_sum"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    single, single_at = cut(single, "single")
    tops = linked(single.select("uid", "n", "bands", "s1", "s2"), base, similarity)
    # classes of texts, then of documents
    by_text, by_text_at = cut(with_top(single.select("sum", "uid", "least", "n_sum"), tops).drop("uid"), "by_text")
    names = by_text.groupBy("top").agg(F.min("least").alias("least"), F.sum("n_sum").alias("n_class"), F.count("*").alias("texts"))
    names, names_at = cut(names, "names")
    named, named_at = cut(hot_join(by_text.select("sum", "top", "n_sum"), names, "top", "texts", total).select("sum", "n_sum", "n_class", F.col("least.doc_id").alias("class_id"), F.col("least.uid").alias("first_uid")), "named")
    out = hot_join(signed.select("uid", "doc_id", "sum"), named, "sum", "n_sum", total)
    out, _ = cut(out.select("uid", "doc_id", "class_id", "n_class", (F.col("uid") == F.col("first_uid")).alias("first")), "classes")
    remove(spark, signed_at, single_at, by_text_at, names_at, named_at)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, the first by id."""
    placed, row = numbered(docs)
    spots = _classes(placed, row, id_col, text_col).where("first").select(F.col("uid").alias(row))
    return placed.join(spots, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class", F.col("first").alias("kept"))
