"""Byte-level BPE encoding and decoding.

Every text is cut into overlapping chunks of chunk_chars, which are pre-tokenised one by one; neighbouring chunks are
stitched at the first pre-token boundary in their overlap on which both agree and that follows a character other than
white space, so that each piece, alone, pre-tokenises as it does within the whole text. Where an overlap has no such
boundary, the chunks stay one piece. Pieces are encoded, and decoding concatenates the bytes of the tokens.

Chunks of a text of up to task_chars are worked on by one task; those of longer texts are dealt out over tasks, and so are
their pieces. The chunks, the stitching and the encoding are the same.

Defined results: a null or empty text has no token and decodes to no bytes; rows that repeat are encoded one by one, a
null id included; other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table

CHUNK_CHARS = 4_096
OVERLAP = 256
#: The longest text whose chunks stay in one task.
TASK_CHARS = 262_144


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding(hashlib.md5(vocabulary).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, chunk: int, overlap: int) -> list[str]:
    """The text's chunks; each but the last goes on for overlap characters into the next."""
    n = max(1, -(-max(len(text) - overlap, 1) // chunk))
    return [text[k * chunk : (k + 1) * chunk + overlap if k + 1 < n else None] for k in range(n)]


def boundaries(split, text: str, first: bool, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The pre-token ends, behind other characters than white space, in a chunk's first and in its last overlap, as offsets into that overlap."""
    ends = [m.end() for m in split.finditer(text)] if not last else [m.end() for m in split.finditer(text[: 2 * overlap])] if not first else []
    ends = [e for e in ends if not text[e - 1].isspace()]
    return [] if first else [e for e in ends if e < overlap], [] if last else [e - chunk for e in ends if chunk <= e < chunk + overlap]


def text_pieces(split, text: str, chunk: int, overlap: int) -> list[str]:
    """The pieces of a text whose encodings, one after the other, are the text's."""
    parts = chunks(text, chunk, overlap)
    if len(parts) == 1:
        return parts
    marks = [boundaries(split, t, k == 0, k + 1 == len(parts), chunk, overlap) for k, t in enumerate(parts)]
    cuts = [0]
    for k in range(len(parts) - 1):
        common = set(marks[k][1]).intersection(marks[k + 1][0])
        if common:
            cuts.append((k + 1) * chunk + min(common))
    return [text[a:z] for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _ids(enc, parts: list[str]) -> list[np.ndarray]:
    return [enc.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False) if t else np.empty(0, "<u4") for t in parts]


def _encode_rows(sent, pattern: str):
    """rows (uid, id, piece, text) -> rows (uid, id, piece, n_tokens, ids); ids are little-endian unsigned 32-bit."""

    def run(batches):
        enc = _encoding(sent.value, pattern)
        for b in batches:
            ids = _ids(enc, b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["uid", "doc_id", "piece", "n_tokens", "ids"],
            )

    return run


def _digest_rows(sent, pattern: str, chunk: int, overlap: int):
    """rows (id, text) -> rows (id, n_tokens, ids_sha256, decoded_sha256): chunks, pieces, ids and bytes, a text at a time."""
    import regex

    split = regex.compile(pattern)

    def run(batches):
        enc = _encoding(sent.value, pattern)
        core = enc._core_bpe
        for b in batches:
            rows = []
            for t in b.column(1):
                n, ids_sha, out_sha = 0, hashlib.sha256(), hashlib.sha256()
                for ids in _ids(enc, text_pieces(split, t.as_py(), chunk, overlap)):
                    n += len(ids)
                    ids_sha.update(ids.tobytes())
                    out_sha.update(core.decode_bytes(ids.tolist()) if len(ids) else b"")
                rows.append((n, ids_sha.hexdigest(), out_sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode_rows(sent, pattern: str):
    def run(batches):
        core = _encoding(sent.value, pattern)._core_bpe
        for b in batches:
            out = [core.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return run


def _chunk_rows(chunk: int, overlap: int):
    """rows (uid, id, text) -> rows (uid, id, k, n, text): the chunks, numbered."""

    def run(batches):
        for b in batches:
            for uid, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                parts = chunks(t.as_py(), chunk, overlap)
                for k0 in range(0, len(parts), 1024):
                    own = parts[k0 : k0 + 1024]
                    ks = range(k0, k0 + len(own))
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(own), pa.int64()), pa.array([i] * len(own), b.column(1).type), pa.array(ks, pa.int64()), pa.array([len(parts)] * len(own), pa.int64()), pa.array(own, pa.string())], ["uid", "doc_id", "k", "n", "text"])

    return run


def _boundary_rows(pattern: str, chunk: int, overlap: int):
    """Adds head and tail: the chunks' boundaries()."""
    import regex

    split = regex.compile(pattern)

    def run(batches):
        for b in batches:
            marks = [boundaries(split, t, k == 0, k + 1 == n, chunk, overlap) for k, n, t in zip(*(b.column(j).to_pylist() for j in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[j] for m in marks], pa.list_(pa.int32())) for j in (0, 1))], [*b.schema.names, "head", "tail"])

    return run


def dealt_pieces(texts: DataFrame, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Rows (uid, doc_id, piece, text) of the pieces of texts (uid, doc_id, text), by chunks that are dealt out over tasks."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    parts = texts.mapInArrow(_chunk_rows(chunk_chars, overlap), f"uid bigint, doc_id {kind}, k bigint, n bigint, text string")
    marked = parts.repartition(F.col("uid"), F.col("k")).mapInArrow(_boundary_rows(pattern, chunk_chars, overlap), f"uid bigint, doc_id {kind}, k bigint, n bigint, text string, head array<int>, tail array<int>")
    by = Window.partitionBy("uid").orderBy("k")
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(by)))
    stitched = marked.select("uid", "doc_id", "k", "n", "text", common.alias("at")).select(
        "*", F.lag("at").over(by).alias("from"), F.coalesce(F.sum(F.when(F.col("at").isNotNull(), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("piece")
    )
    begin = F.when(F.col("k") == 0, 0).otherwise(F.coalesce("from", F.lit(0)))
    end = F.when(F.col("k") == F.col("n") - 1, F.length("text")).otherwise(F.lit(chunk_chars) + F.coalesce("at", F.lit(0)))
    return (
        stitched.select("uid", "doc_id", "piece", "k", F.col("text").substr(begin + 1, end - begin).alias("text"))
        .groupBy("uid", "doc_id", "piece")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
        .select("uid", "doc_id", F.col("piece").cast("bigint").alias("piece"), "text")
    )


def encode(texts: DataFrame, vocabulary: bytes, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The encoded pieces (uid, doc_id, piece, n_tokens, ids) of texts (uid, doc_id, text) without nulls."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: its size doesn't depend on the corpus
    schema = f"uid bigint, doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece bigint, n_tokens bigint, ids binary"
    return dealt_pieces(texts, pattern, chunk_chars, overlap).repartition(F.col("uid"), F.col("piece")).mapInArrow(_encode_rows(sent, pattern), schema)


def decode(encoded: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Adds decoded: the bytes of each row's ids, one after the other."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    return encoded.mapInArrow(_decode_rows(sent, pattern), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")


def digests(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, task_chars: int = TASK_CHARS) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    placed, row = numbered(docs)
    base = placed.select(F.col(row).alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    whole = base.where(F.length("text") <= task_chars).select("doc_id", "text").mapInArrow(_digest_rows(sent, pattern, chunk_chars, overlap), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    dealt = decode(encode(base.where(F.length("text") > task_chars), vocabulary, pattern, chunk_chars, overlap), vocabulary, pattern)
    joined = lambda c: F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", c))), lambda x: F.hex(x[c])), ""))
    dealt = dealt.groupBy("uid", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), joined("ids").alias("ids"), joined("decoded").alias("decoded"))
    return whole.unionByName(dealt.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
