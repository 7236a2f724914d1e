"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, in DataFrame operations only.

Every window of a document's words is hashed; the hashes meet the broadcast hashes of the benchmark's windows, hits are
verified word for word, and what each document shares with which items comes out of one aggregation. The size of the
hash set is measured first: beyond max_broadcast_bytes it is dealt into slices of that size, each broadcast in a pass of
its own, so no broadcast grows with the benchmark.

Defined results: null and empty texts have no words; an item of fewer than width words is one window, one without
words none; rows of an item id count as one item, items with a null id are left out; document rows that repeat are
judged one by one; other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before the windows of each document, so that documents without a hit stay. No hit is claimed by it: its gram is null.
MARK = -7046029254386353131


def words(text: Column) -> Column:
    """Runs of characters other than ASCII ones that are no letter or digit, with A-Z lower-cased; of null, none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _hashes(width: int) -> Column:
    parts = ", ".join(f"get(w, i + {k})" for k in range(width))
    return F.expr(f"if(size(w) >= {width}, transform(sequence(0, size(w) - {width}), i -> xxhash64({parts})), cast(array() as array<bigint>))")


def benchmark_grams(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (size, gram, h, items): each distinct window of the items, its hash as a document's window has it, and the items that hold it."""
    own = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("size", F.least(F.size("w"), F.lit(width)))
    own = own.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("g"))
    hashed = F.lit(None).cast("bigint")
    for n in range(1, width + 1):
        hashed = F.when(F.col("size") == n, F.xxhash64(*(F.col("g")[k] for k in range(n)))).otherwise(hashed)
    own = own.select("size", F.concat_ws(" ", "g").alias("gram"), hashed.alias("h"), "item")
    return own.groupBy("size", "gram", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 8, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = 64 << 20, row_col: str | None = None) -> DataFrame:
    """Rows (uid, doc_id, n_words, pos, size, items): each verified window of a document, from word pos, and a row with null pos for each document. row_col numbers docs' rows, if they are to be told apart outside."""
    grams = benchmark_grams(benchmark, width)
    at = grams.groupBy("size").agg(F.sum(F.length("gram") + F.size("items") * 24 + 64).alias("bytes")).collect()  # at most width rows
    sizes, slices = sorted(r["size"] for r in at), max(1, -(-sum(r["bytes"] for r in at) // max_broadcast_bytes))
    base = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("uid"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    mark = F.lit(MARK).cast("bigint")
    parts = []
    for n in sizes or [width]:
        for k in range(slices):
            first = not parts
            known = grams.where((F.col("size") == n) & (F.pmod("h", F.lit(slices)) == k)).select("h", "gram", "items")
            if first:
                known = known.unionByName(docs.sparkSession.range(1).select(mark.alias("h"), F.lit(None).cast("string").alias("gram"), F.array().cast("array<string>").alias("items")))
            windows = base.select("uid", "doc_id", "w", F.posexplode(F.concat(F.array(mark), _hashes(n)) if first else _hashes(n)).alias("pos", "h"))
            pos = F.col("pos") if first else F.col("pos") + 1
            gram = F.concat_ws(" ", F.slice("w", F.greatest(pos, F.lit(1)), n))
            met = windows.join(F.broadcast(known), "h").where(F.when(F.col("gram").isNull(), F.col("pos") == 0).otherwise(F.col("gram") == gram) if first else F.col("gram") == gram)
            parts.append(met.select("uid", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.when(F.col("gram").isNotNull(), pos).alias("pos"), F.lit(n).alias("size"), "items"))
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame, limit_items: int = 2) -> DataFrame:
    """One row per document: how many words lie in shared windows, which items share one, and whether they are limit_items or more."""
    span = F.struct("pos", "size")
    per = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_set(F.when(F.col("pos").isNotNull(), span))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("aggregate(spans, struct(0L as n, 0L as upto), (a, s) -> struct(a.n + greatest(0L, s.pos + s.size - greatest(a.upto, s.pos)) as n, greatest(a.upto, s.pos + s.size) as upto), a -> a.n)")
    return per.select("uid", "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= limit_items).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 8, limit_items: int = 2, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """docs without contaminated documents; others lose the words that lie in shared windows, each with the gap before it. Null texts stay."""
    placed, row = numbered(docs)
    found = hits(placed, benchmark, width, id_col, text_col, row_col=row)
    held = fresh([*docs.columns, row], "_held")
    spans = report(found, limit_items).where(F.size("spans") > 0).select(F.col("uid").alias(row), F.struct("contaminated", "spans").alias(held))
    joined = placed.join(spans, row, "left").where(~F.coalesce(F.col(held)["contaminated"], F.lit(False)))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]".replace("\\x60", "\\x40\\x5B-\\x60")  # before A-Z are lower-cased
    old = F.col(f"`{text_col}`")
    pieces = F.regexp_extract_all(old, F.lit(f"({word.replace('[^', '[')}*{word}+)"), F.lit(1))
    tail = F.regexp_extract(old, f"({word.replace('[^', '[')}*)$", 1)
    stay = F.filter(pieces, lambda _, i: ~F.exists(F.col(held)["spans"], lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["size"])))
    text = F.when(F.col(held).isNull(), old).otherwise(F.concat(F.array_join(stay, ""), tail))
    new = {text_col: text}
    if n_col in docs.columns:
        new[n_col] = F.when(F.col(held).isNull(), F.col(f"`{n_col}`")).otherwise(F.length(text).cast(docs.schema[n_col].dataType))
    return joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("uid", "spans")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
g0 AS (SELECT item, least(len(w), 8) AS n, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM g0),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT d.doc_id, s.n, d.w, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, sizes s WHERE len(d.w) >= s.n),
hit AS (SELECT p.doc_id, p.i, p.n, g.item FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
