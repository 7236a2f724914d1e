"""Shared plumbing: table access, durable cuts of lineage, folds, words and shingles."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def bounded(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let no Arrow batch carry more than most bytes: with long texts, batches set what a Python worker needs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{64 << 20}b").lower().rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a local session takes a folder of its own; a cluster has none that all can see, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="glyphsieve-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: a replicated copy that outlives executors. Returns it and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphsieve/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete cuts that no later plan reads, and let the session free the shuffle files of dropped plans."""
    import gc

    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def _as_read(plan) -> bool:
    """Whether a plan is one folder or file as read, with nothing but columns chosen and rows left out."""
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and hasattr(plan.relation(), "location") and plan.relation().fileFormat().toString() == "Parquet" and plan.relation().location().rootPaths().size() == 1


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, and that column's name, which no other has: the file's number, by path, and the row's place in the file. Every scan of the result, however it is split, gives a row the same number. What is no Parquet table as read is written first."""
    if not _as_read(docs._jdf.queryExecution().analyzed()):
        docs, _ = cut(docs, "rows")
    own, name = [F.col(f"`{c}`") for c in docs.columns], fresh(docs.columns, "_row")
    path, at = docs.metadataColumn("_metadata")["file_path"], docs.metadataColumn("_metadata")["row_index"]
    paths = sorted(r[0] for r in docs.select(path).distinct().collect())
    if len(paths) <= 1:
        return docs.select(*own, at.alias(name)), name
    file, place, known, base = (fresh(docs.columns, x) for x in ("_file", "_place", "_known", "_base"))
    files = docs.sparkSession.createDataFrame([(p, k << 40) for k, p in enumerate(paths)], f"{known} string, {base} bigint")
    placed = docs.select(*own, path.alias(file), at.alias(place)).join(F.broadcast(files), F.col(file) == F.col(known))
    return placed.select(*own, (F.col(base) + F.col(place)).alias(name)), name


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text, modulo parts; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, with a memory of bounded size."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        h = xxhash.xxh3_64_intdigest
        out = [known.get(w) for w in words]
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                out[i] = known[w] = h(w.encode("utf-8", "surrogatepass"))
        return np.array(out, dtype=np.uint64)


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words; of fewer words, one for all of them; of none, none."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out ^ word_hashes[i : n - k + 1 + i])
    return out
