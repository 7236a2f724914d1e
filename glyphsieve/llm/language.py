"""Language ID by string kernels.

A text is the set of its byte n-grams of lengths 1 to longest (a blended spectrum, presence only), hashed to 2**bits
places; the kernel of two texts is the size of their common set over the geometric mean of their sets' sizes. Nyström
landmarks give a feature map, kernel ridge regression learns one language versus the rest on it. As the kernel is linear
in presence, landmarks and weights fold into one matrix of places by languages, and batches of texts are scored by one
matrix product each.

Learns from about per_language documents of each language (chosen by the hash of id and text, equal ones once), some 2,000
in all, of the max_languages commonest languages; with more than 100 languages, 20 of each. Defined results: a text that is null or has no letter is `und` with score 0, as is every text
where nothing can be learned; of equal scores the first language by name; rows that repeat are judged one by one; rows
with a null language lend nothing; only doc_id, text and, to learn, lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

LONGEST = 4
BITS = 16
LANDMARKS = 256
PER_LANGUAGE = 400
MAX_LANGUAGES = 256
RIDGE = 1e-2
SHARPNESS = 4.0


def presence(text: str, longest: int = LONGEST, bits: int = BITS) -> np.ndarray:
    """A 0/1 byte for each place: whether an n-gram of the text falls there."""
    out = np.zeros(1 << bits, np.uint8)
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    shift = np.uint32(32 - bits)
    for at in range(0, max(len(b), 1), 1 << 20):  # slices bound the memory that a very long text takes
        part = b[at : at + (1 << 20) + longest - 1].astype(np.uint32) + np.uint32(1)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            out[((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift] = 1
    return out


def _presence_rows(batches):
    for b in batches:
        rows = [np.packbits(presence(t or "")).tobytes() for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], ["lang", "x"])


def fit(x: np.ndarray, y: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list, np.ndarray]:
    """The languages, by name, and the matrix that maps presence over the root of its sum to one value for each. x: packed bits, a row a text."""
    names = sorted(set(y.tolist()))

    def own(rows: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(x[rows], axis=1).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))

    # landmarks in turn from each language
    turn = np.zeros(len(y), np.int64)
    for name in names:
        mine = np.flatnonzero(y == name)
        turn[mine] = np.arange(len(mine))
    chosen = own(np.argsort(turn, kind="stable")[:landmarks])
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # a few texts at a time: unpacked, each takes 2**BITS floats
    features = np.concatenate([(own(np.arange(k, min(k + 64, len(y)))) @ chosen.T).astype(np.float64) for k in range(0, len(y), 64)]) @ root
    target = np.where(y[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([1 / max((y == v).sum(), 1) for v in y])[:, None] * len(y) / len(names)  # languages weigh the same
    weights = np.linalg.solve(features.T @ (share * features) + ridge * len(y) * np.eye(features.shape[1]), features.T @ (share * target))
    return names, (chosen.T @ (root @ weights).astype(np.float32)).astype(np.float32)


def learn(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[list, np.ndarray]:
    own = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    want = max(20, min(per_language, 2000 // len(sizes)))
    place = F.pmod(F.xxhash64(F.col("_id"), F.col("text"), F.lit(9)), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(k, min(1 << 30, int((1 << 30) * want / n) + 1)) for k, n in sizes.items()], "lang string, upto bigint")
    sample = own.join(F.broadcast(shares), "lang").where(place < F.col("upto")).select("text", "lang").mapInArrow(_presence_rows, "lang string, x binary").distinct().toPandas().sort_values(["lang", "x"])
    if not len(sample):
        return [], np.zeros((1 << BITS, 0), np.float32)
    x = np.frombuffer(b"".join(sample["x"]), np.uint8).reshape(len(sample), (1 << BITS) // 8)
    return fit(x, sample["lang"].to_numpy(str))


def predict(docs: DataFrame, keep, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score."""
    names, matrix = learn(docs, keep, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))  # 2**BITS floats for each of max_languages at most

    def run(batches):
        names, matrix = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            best, score = ["und"] * len(texts), [0.0] * len(texts)
            live = [i for i, t in enumerate(texts) if names and t and any(map(str.isalpha, t))]
            for k in range(0, len(live), 64):
                part = live[k : k + 64]
                x = np.stack([presence(texts[i]) for i in part]).astype(np.float32)
                z = (x @ matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) * SHARPNESS
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, j, v in zip(part, p.argmax(1), p.max(1), strict=True):
                    best[i], score[i] = names[j], float(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 4) == 2
    return predict(table(spark, sf_dir, "documents"), ~held, held)
