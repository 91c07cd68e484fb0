"""Questions of chunks to ranges of hashes, and answers in the same order.

A chunk (a few megabytes of documents, encoded once) asks about its distinct
keys in sorted, compressed lists, one for each range of hashes.  Each range
sees all lists that ask about its keys, answers each in its own order, and the
answers go back by chunk.  A key comes once from each chunk, however often it
occurs, so a hot key costs a range no more than one entry a chunk; nothing is
broadcast or collected but a range's totals.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if len(x) else b""


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: sorted uint64 as differences, all by byte planes, compressed."""
    import zstandard

    out = []
    for x in arrays:
        rises = x.dtype == np.uint64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        out.append((x.dtype.str, rises, _planes(np.diff(x, prepend=np.uint64(0)) if rises else x)))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out))


def expand(data: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, rises, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        x = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.empty(0, dtype=kind)
        out.append(np.cumsum(x, dtype=np.uint64) if rises else x)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


#: Arrow batches end at this size, so a chunk with its answers is one of its own and a task holds one.
ONE_A_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
ASK = "p int, chunk long, blob binary"


def ranges(sorted_at: np.ndarray):
    cuts = np.flatnonzero(np.diff(sorted_at)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(sorted_at)]):
        if e > s:
            yield int(sorted_at[s]), int(s), int(e)


def rows(data: list[tuple], names: tuple[str, ...] = ("p", "chunk", "blob")):
    kinds = {"p": pa.int32(), "chunk": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, list(zip(*data)) or [[]] * len(names))], list(names))


def answered(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk with its answers of each kind, in order of the ranges."""
    for k, a in enumerate(answers):
        own = a.where(F.col("chunk") >= 0).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("p", "blob"))).alias(f"a{k}"))
        chunks = chunks.join(own, "chunk", "left")
    return chunks


def reduce(asked: DataFrame, fn) -> DataFrame:
    """fn(list of chunk ids, list of array lists) gives an answer for each chunk and, for chunk -1, a range's totals."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        p = t.column("p")[0].as_py()
        chunks = t.column("chunk").to_pylist()
        return pa.Table.from_batches([rows([(p, c, b) for c, b in fn(p, chunks, [expand(x) for x in t.column("blob").to_pylist()])])])

    return asked.groupBy("p").applyInArrow(run, ASK)


def totals(answers: DataFrame) -> np.ndarray:
    """Sum of the ranges' totals: one short row a range."""
    own = answers.where(F.col("chunk") == -1).select("blob").collect()
    return sum((expand(bytes(r.blob))[0] for r in own), start=np.zeros(1, dtype=np.int64))
