"""Shared helpers: tables, the shared folder, word rules and class-free hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z alone, as a byte table.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the session names none, a temporary folder is taken.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(at)
        return at
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="annospark-")
    sc.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/annospark-{what}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


class Steps:
    """Tables that an operator of many steps writes on its way, as compressed Parquet in the shared folder.

    A written table survives lost executors and cuts the lineage, so no step
    reads an earlier one's shuffle: within ``with``, an action's shuffle files
    go when it ends.  At the end the settings are as before and the tables are
    gone, but for those of :meth:`keep`, which the operator's result reads.
    """

    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

    def __init__(self, df: DataFrame, settings: dict[str, str] | None = None):
        self.spark, self.settings, self.tables = df.sparkSession, self.SETTINGS | (settings or {}), []

    def __enter__(self) -> Steps:
        self.before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        remove(self.spark, *[path for _, path in self.tables])

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = fresh_path(self.spark, what)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, what: str) -> DataFrame:
        path = fresh_path(self.spark, what)
        self.tables.append((None, path))
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[-1] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Tables that no later step reads."""
        remove(self.spark, *[path for f, path in self.tables if any(f is x for x in frames)])


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, a sum per task."""
    return int(df.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0)


def crc32_rest(col: str, n: int):
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered while the worker lives; at the bound it starts anew."""

    def __init__(self, seed: int = 0, most: int = 600_000):
        import xxhash

        super().__init__()
        self.seed, self.most, self.digest = seed, most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word, self.seed)
        return h


_hashes: dict[int, WordHashes] = {}


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    h = _hashes.get(seed)
    if h is None:
        h = _hashes[seed] = WordHashes(seed)
    return np.array([h[w] for w in words], dtype=np.uint64)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0x2B7E151628AED2A7, 0xB7E151628AED2A6B], dtype=np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes; empty where there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * _ODD[j % 13] + np.uint64(j)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return mix64(out)


def winnow_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the place of its minimum, the rightmost of equals.

    Equal windows choose the same relative place, so two texts that share
    w + k - 1 words (k the gram's length) share a chosen gram.  Fewer than w
    hashes are one window.
    """
    n = len(h)
    if not n:
        return np.empty(0, dtype=np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(h[::-1]))], dtype=np.int64)
    m = n - w + 1
    best, at = h[:m].copy(), np.zeros(m, dtype=np.int64)
    for j in range(1, w):
        x = h[j : j + m]
        less = x <= best
        np.copyto(best, x, where=less)
        at[less] = j
    return at + np.arange(m)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """The places of :func:`winnow_places`, once each; they never fall from one window to the next."""
    at = winnow_places(h, w)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def slices(batch, column: int, most: int = 4 << 20):
    """Parts of an Arrow batch, as (first row, texts), of about ``most`` characters, one text at least."""
    texts, first, size = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        text = x.as_py() or ""
        if texts and size + len(text) > most:
            yield first, texts
            texts, first, size = [], i, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts
