"""Suffix-array dedup of passages: bytes covered by a string of `width` bytes that also starts earlier.

Which strings can recur is found without moving texts. Each window of width bytes has a key, the smallest hash among
its k-grams; equal windows have equal keys, and a run of neighbouring windows with one key is a segment. Only segments
whose key occurs twice send their bytes on, to the bin of the key. There their suffixes are sorted with hash-compared
mergesort: first one suffix a segment, which settles segments that recur whole, then one suffix a window of the
segments that differ. Of equal windows the earliest stays, the others' bytes are removed. The segments of a key that very
many hold are cut up and dealt out by a second key, the smallest of other hashes of the window's k-grams: equal windows
have equal second keys, while windows that reach out of what the texts share mostly have one of their own.

Whole texts that recur are found by digest before that: later copies of width bytes or more lose all bytes, and a group
of copies of any size enters the search once.

Order is by doc_id, nulls first, then by row; positions within a text come after that. Defined results: a null or empty
text has no bytes; texts below width bytes stay whole; rows that repeat their doc_id are separate texts, the first read
counting as earlier; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, mix, numbered, remove, table
from .suffixes import Buffer, equal_runs

WIDTH = 100
GRAM = 32
LOW_BITS = 17
#: From so many segments on, a key's segments are dealt out by a second key of their windows.
HOT = 512
SLICE = 1 << 16
SECOND = 0x5A17
#: Copies' row numbers are broadcast up to this many (8 bytes each); beyond, texts and copies are joined by shuffling.
MAX_BROADCAST_ROWS = 2_000_000


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of gram bytes, by joining runs of doubled length; gram is a power of two."""
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    while have < gram:
        right = h[have:]
        h = h[:-have] * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        have *= 2
    return h


def _window_keys(data: np.ndarray, width: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each window of width bytes: the smallest k-gram hash in it, and where the first such k-gram stands. salt: of another order of hashes."""
    span, low = width - gram + 1, np.uint64((1 << LOW_BITS) - 1)
    keys, at = [], []
    for s in range(0, len(data) - width + 1, SLICE):
        part = data[s : s + SLICE + width - 1]
        h = _gram_hashes(part, gram)
        if salt:
            h = mix(h ^ np.uint64(salt))
        n = len(h)
        packed = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
        packed[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        rows = packed.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
        keys.append(least >> np.uint64(LOW_BITS))
        at.append((least & low).astype(np.int64) + s)
    return np.concatenate(keys), np.concatenate(at)


def segments(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The segments of texts laid end to end: text number, key, first window (in the text), windows, and whether its key occurs in it twice."""
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    keys, at = _window_keys(data, width, gram)
    n, sizes = len(keys), np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)[:n]
    own = np.arange(n) + width <= ends[text]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (own[1:] != own[:-1])]
    moved = np.cumsum(np.r_[False, (at[1:] != at[:-1]) & ~fresh[1:]])
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], n] - 1
    keep = own[first]
    first, last = first[keep], last[keep]
    which = text[first].astype(np.int64)
    begin = np.r_[0, ends[:-1]][which] if len(ends) else none
    return which, keys[first], first - begin, last - first + 1, moved[last] > moved[first]


def _portions(batch, most: int = 1 << 20):
    """Slices of a batch (uid, text) of some MB of text at most, or of one text: what is worked on at once takes thirty times its bytes."""
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _laid(texts) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64)


def _blob(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), codec="zstd", asbytes=True)


def _thrifty() -> None:
    """Let Arrow's freed buffers go back to the system: blobs come and go, and a worker that keeps them grows by all of them."""
    pa.set_memory_pool(pa.system_memory_pool())


def _unblob(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    size = sum(np.dtype(t).itemsize for t in types) * n
    raw, out, at = pa.decompress(data, size, codec="zstd", asbytes=True), [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += np.dtype(t).itemsize * n
    return out


def _bins(key: np.ndarray, bins: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(bins)).astype(np.int64)


def _by_bin(where: np.ndarray):
    """(bin, indexes) for each bin that occurs."""
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]]) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(where[order[a]]), order[a:b]


def _key_rows(bins: int, width: int, gram: int):
    """rows (uid, text) -> rows (bin, n, blob of key, uid, first, windows with the sign for twice)."""

    def out(held):
        uid, key, first, size = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = [(b, len(i), _blob(key[i], uid[i], first[i], size[i])) for b, i in _by_bin(_bins(key, bins))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bin", "n", "blob"])

    def run(batches):
        _thrifty()
        held, n = [], 0
        for b in batches:
            for part in _portions(b):
                uid = part.column(0).to_numpy()
                which, key, first, size, twice = segments(*_laid(part.column(1)), width, gram)
                held.append((uid[which].astype(np.int64), key, first.astype(np.uint32), np.where(twice, -size, size).astype(np.int32)))
                n += len(which)
                if n > 200_000:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return run


def _recurring_rows(most: int):
    """rows (bin, n, blob) of whole bins -> rows (uid, key, first, windows, hot) of the segments whose key occurs twice; hot: in `most` segments or more."""

    def run(batches):
        _thrifty()
        parts = [_unblob(x.as_py(), n.as_py(), "u8", "i8", "u4", "i4") for b in batches for n, x in zip(b.column(1), b.column(2), strict=True)]
        if not parts:
            return
        key, uid, first, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.r_[False, k[1:] == k[:-1]]
        kept = same | np.r_[same[1:], False] | (size[order] < 0) if len(k) else same
        group = np.cumsum(~same) - 1
        hot = (np.bincount(group) >= most)[group] if len(k) else same
        keep, hot = order[kept], hot[kept]
        for at in range(0, len(keep), 50_000):
            i = keep[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(key[i].astype(np.int64)), pa.array(first[i].astype(np.int64)), pa.array(size[i].astype(np.int64)), pa.array(hot[at : at + 50_000])], ["uid", "key", "first", "windows", "hot"])

    return run


def _cut_up(key: int, first: int, windows: int, piece: bytes, width: int, gram: int):
    """A hot segment by the second keys of its windows: (key of both, first, windows, bytes)."""
    second = _window_keys(np.frombuffer(piece, np.uint8), width, gram, SECOND)[0]
    starts = np.flatnonzero(np.r_[True, second[1:] != second[:-1]])
    both = mix(np.uint64(key % 2**64) ^ mix(second[starts])).view(np.int64).tolist()
    for k, a, z in zip(both, starts.tolist(), [*starts[1:].tolist(), len(second)], strict=True):
        yield k, first + a, z - a if windows > 0 else a - z, piece[a : z + width - 1]


def _context_rows(bins: int, width: int, gram: int):
    """rows (uid, rank, text, found) -> rows (bin, n, sizes and bytes): the segments with the bytes of their windows."""

    def out(held):
        rank, uid, key, first, size = (np.array([h[k] for h in held], t) for k, t in enumerate(("i8", "i8", "i8", "u4", "i4")))
        rows = []
        for b, i in _by_bin(_bins(key, bins)):
            rows.append((b, len(i), _blob(rank[i], uid[i], key[i], first[i], size[i]), pa.compress(b"".join(held[j][5] for j in i), codec="zstd", asbytes=True)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["bin", "n", "blob", "bytes"])

    def run(batches):
        _thrifty()
        held, weight = [], 0
        for b in batches:
            for uid, rank, text, found in zip(*(b.column(k) for k in range(4)), strict=True):
                uid, rank, raw = uid.as_py(), rank.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")
                for f in found.as_py():
                    piece = raw[f["first"] : f["first"] + abs(f["windows"]) + width - 1]
                    parts = _cut_up(f["key"], f["first"], f["windows"], piece, width, gram) if f["hot"] else [(f["key"], f["first"], f["windows"], piece)]
                    for part in parts:
                        held.append((rank, uid, *part))
                        weight += len(part[3]) + 64
                if weight > 6 << 20:
                    yield out(held)
                    held, weight = [], 0
        if held:
            yield out(held)

    return run


def repeated(rank: np.ndarray, uid: np.ndarray, key: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(segment, from, to): the runs of windows that recur. Segments of a key must all be here."""
    buf, size, twice = Buffer(data), np.abs(size).astype(np.int64), size < 0
    first = first.astype(np.int64)
    _, group = np.unique(key, return_inverse=True)
    # whole segments: the earliest of each kind stands for it, the others recur from end to end
    kind = equal_runs(buf, group, begin, size + width - 1)
    order = np.lexsort((first, uid, rank, kind))
    lead = np.r_[True, kind[order][1:] != kind[order][:-1]] if len(order) else np.empty(0, bool)
    later, chosen = order[~lead], order[lead]
    found = [(later, np.zeros(len(later), np.int64), size[later])]
    # windows of the kinds that share a key with another, or in which a key stands twice
    many = np.bincount(group[chosen], minlength=int(group.max(initial=0)) + 1)
    chosen = chosen[(many[group[chosen]] > 1) | twice[chosen]]
    # one group of keys at a time, up to some number of windows
    chosen = chosen[np.argsort(group[chosen], kind="stable")]
    edge = np.flatnonzero(np.r_[True, group[chosen][1:] != group[chosen][:-1]]) if len(chosen) else np.empty(0, int)
    total, upto = np.cumsum(size[chosen]), 0
    stops, seen = [], 0
    for a in edge[1:]:
        if total[a - 1] - seen > 150_000:
            stops.append(a)
            seen = total[a - 1]
    for stop in [*stops, len(chosen)] if len(chosen) else []:
        part = chosen[upto:stop]
        upto = stop
        seg = np.repeat(part, size[part])
        off = np.arange(len(seg)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        at = begin[seg] + off
        same = equal_runs(buf, group[seg], at, np.full(len(seg), width))
        o = np.lexsort((first[seg] + off, uid[seg], rank[seg], same))
        hit = np.zeros(len(seg), bool)
        hit[o[np.r_[False, same[o][1:] == same[o][:-1]]]] = True
        idx = np.flatnonzero(hit)
        if len(idx):
            new = np.r_[True, (np.diff(idx) > 1) | (seg[idx][1:] != seg[idx][:-1])]
            a = idx[new]
            z = idx[np.r_[new[1:], True]]
            found.append((seg[a], off[a], off[z] + 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _range_rows(width: int):
    """rows (bin, n, blob, bytes) of whole bins -> rows (uid, a, z): byte ranges to remove."""

    def run(batches):
        _thrifty()
        heads, bodies = [], []
        for b in batches:
            for n, blob, raw in zip(b.column(1), b.column(2), b.column(3), strict=True):
                head = _unblob(blob.as_py(), n.as_py(), "i8", "i8", "i8", "u4", "i4")
                heads.append(head)
                bodies.append(raw.as_py())
        if not heads:
            return
        rank, uid, key, first, size = (np.concatenate(x) for x in zip(*heads, strict=True))
        length = np.abs(size).astype(np.int64) + width - 1
        each = [int((np.abs(h[4]).astype(np.int64) + width - 1).sum()) for h in heads]
        data = np.concatenate([np.frombuffer(pa.decompress(x, n, codec="zstd", asbytes=True), np.uint8) for x, n in zip(bodies, each, strict=True)])
        del bodies, heads
        begin = np.cumsum(length) - length
        # keys in order, in pieces of some MB at key borders: what is compared, not what is held, sets the memory
        order = np.argsort(key, kind="stable")
        k, total = key[order], np.cumsum(length[order])
        border = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        at, seen = 0, 0
        stops = []
        for p in border[1:]:
            if total[p - 1] - seen > 1 << 19:
                stops.append(int(p))
                seen = total[p - 1]
        for stop in [*stops, len(order)]:
            i = order[at:stop]
            at = stop
            here = np.cumsum(length[i]) - length[i]
            take = np.repeat(begin[i] - here, length[i]) + np.arange(int(length[i].sum()))
            seg, a, z = repeated(rank[i], uid[i], key[i], first[i], size[i], data[take], here, width)
            if len(seg):
                base = first[i][seg].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uid[i][seg]), pa.array(base + a), pa.array(base + z + width - 1)], ["uid", "a", "z"])

    return run


def _cleaned_rows(batches):
    """rows (uid, text, copy, ranges) -> rows (uid, bytes kept, n_bytes, n_removed, n_spans)."""
    for b in batches:
        rows = []
        for i, text, copy, ranges in zip(*(b.column(k) for k in range(4)), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            n, removed, spans, parts, at, start = len(raw), 0, 0, [], 0, 0
            if copy.as_py():
                rows.append((i.as_py(), b"", n, n, 1))
                continue
            upto = -1
            for r in sorted((x["a"], x["z"]) for x in ranges.as_py() or []):
                if r[0] > upto:
                    if upto >= 0:
                        removed, spans, at = removed + upto - start, spans + 1, upto
                    parts.append(raw[at : r[0]])
                    start, upto = r
                else:
                    upto = max(upto, r[1])
            if upto >= 0:
                removed, spans, at = removed + upto - start, spans + 1, upto
            parts.append(raw[at:])
            rows.append((i.as_py(), b"".join(parts), n, removed, spans))
        types = (b.column(0).type, pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["uid", "kept", "n_bytes", "n_removed", "n_spans"])


def removals(base: DataFrame, width: int = WIDTH, gram: int = GRAM, order_col: str = "doc_id", hot: int = HOT) -> tuple[DataFrame, DataFrame, bool]:
    """For rows (uid, order_col, text): the later copies of whole texts (uid), the byte ranges to remove elsewhere (uid, ranges), and whether copies may be broadcast."""
    spark = base.sparkSession
    bins = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = F.coalesce(F.col(order_col).cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    texts = base.select("uid", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    sums, sums_at = cut(texts.where(F.octet_length("text") >= width).select("uid", "rank", F.md5("text").alias("sum")), "sums")
    firsts = sums.groupBy("sum").agg(F.min(F.struct("rank", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1").select("sum", "first.uid")
    firsts, firsts_at = cut(firsts.withColumnRenamed("uid", "kept_uid"), "firsts")
    copies, _ = cut(sums.join(firsts, "sum").where("uid <> kept_uid").select("uid"), "copies")
    remove(spark, sums_at, firsts_at)
    small = copies.count() <= MAX_BROADCAST_ROWS
    single = texts.where(F.octet_length("text") >= width).join(F.broadcast(copies) if small else copies, "uid", "left_anti")
    keys = single.select("uid", "text").mapInArrow(_key_rows(bins, width, gram), "bin bigint, n bigint, blob binary")
    recurring, recurring_at = cut(keys.repartition(F.col("bin")).mapInArrow(_recurring_rows(hot), "uid bigint, key bigint, first bigint, windows bigint, hot boolean"), "recurring")
    remove(spark)
    found = recurring.groupBy("uid").agg(F.collect_list(F.struct("key", "first", "windows", "hot")).alias("found"))
    contexts = texts.join(found, "uid").select("uid", "rank", "text", "found").mapInArrow(_context_rows(bins, width, gram), "bin bigint, n bigint, blob binary, bytes binary")
    ranges, _ = cut(contexts.repartition(F.col("bin")).mapInArrow(_range_rows(width), "uid bigint, a bigint, z bigint"), "ranges")
    remove(spark, recurring_at)
    return copies, ranges.groupBy("uid").agg(F.collect_list(F.struct("a", "z")).alias("ranges")), small


def _cleaned_texts(batches):
    """rows (uid, text, copy, ranges) -> rows (uid, text, n): the bytes that stay as text, and its characters."""
    for b in _cleaned_rows(batches):
        texts = [x.as_py().decode("utf-8", "ignore") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["uid", "text", "n"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, row) with docs' columns other than the text, and rows (uid, kept, n_bytes, n_removed, n_spans): uid numbers docs' rows, kept holds the bytes that stay."""
    rows, marked = _marked(docs, id_col, text_col, width, gram, hot)
    return rows, marked.mapInArrow(_cleaned_rows, "uid bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, row) as dedup() gives them, and rows (uid, text, copy, ranges): what to remove of each text."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"column {id_col} must be of an integer type: texts are ordered by it")
    placed, number = numbered(docs)
    base = placed.select(F.col(number).alias("uid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"), F.col(id_col).alias("_order"), F.col(text_col).alias("text"))
    copies, ranges, small = removals(base, width, gram, "_order", hot)
    marked = base.select("uid", "text").join(ranges, "uid", "left").join((F.broadcast if small else lambda x: x)(copies.withColumn("copy", F.lit(True))), "uid", "left")
    return base.select("uid", "row"), marked.select("uid", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ranges")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cleaned = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = cleaned.select("uid", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(digest, "uid").select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """docs with the removed bytes gone from their texts; texts left empty stay as rows. Bytes that no longer form a character are dropped."""
    rows, marked = _marked(docs, id_col, text_col)
    texts = marked.mapInArrow(_cleaned_texts, "uid bigint, text string, n bigint").withColumnsRenamed({"text": "_text", "n": "_n"})
    joined = rows.join(texts, "uid")
    pick = lambda c: F.col("_text").alias(c) if c == text_col else F.col("_n").alias(c) if c == n_col else F.col("row")[c].alias(c)
    return joined.select(*(pick(c) for c in docs.columns))

