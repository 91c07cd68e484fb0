"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents with one shingle set are one class; all that follows is between
classes.  Signatures are cut into bands; in each bucket of a band classes are
first compared with one centre, which links most copies at one comparison
each.  Buckets whose classes are then still in different components are
compared in full, but only across components and inside tasks: blocks of at
most about ``BLOCK`` classes (``BLOCK_BYTES`` of sets) against each other.  A
task first says which classes have a partner that passes the bounds; those
get their full sets, and a task verifies and unites them, so that a pair of
blocks gives a spanning forest of its links: fewer rows than it has classes.
No bucket's pairs are spelled out, and none is left out.

A candidate's signatures are compared in batches.  After each batch the
posterior probability that the similarity reaches the threshold (uniform
prior) is bounded, and a pair below ``miss`` goes; survivors are verified on
their full sets.  The number of bands keeps the chance that a pair at the
threshold shares no bucket below ``miss`` as well.

Rows: documents without words have an empty set, are linked with nothing and
are their own component; a null id takes part in nothing, is its own
component (null) and is kept; repeated ids: rows are linked by their texts,
each with its own result, so repeated rows of one id and text stay together;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import LOWER, Steps, gram_hashes, word_hashes
from annospark.llm.components import components

WORDS = 5
#: Signature values a band has.
ROWS = 7
#: Chance to miss a pair at the threshold, for the bands and for the posterior bound each.
MISS = 1e-6
#: Signature values that are compared at once.
BATCH = 32
#: Classes of a bucket that one task compares with as many others, and bytes of their sets.
BLOCK, BLOCK_BYTES = 2048, 16 << 20


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(0.999999, threshold**rows))))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z count as lower case."""
    ws = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.unique(gram_hashes(word_hashes(ws), min(words, len(ws)))) if ws else np.empty(0, np.uint64)


class Signatures:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.RandomState(seed)
        self.bands, self.rows = bands, rows
        self.a = (r.randint(0, 1 << 31, bands * rows, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
        self.b = r.randint(0, 1 << 32, bands * rows, dtype=np.int64).astype(np.uint32)[:, None]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
        return np.minimum.reduce([(self.a * x[:, i : i + 512] + self.b).min(1) for i in range(0, x.shape[1], 512)])

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band and its number."""
        h = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in signature.reshape(self.bands, self.rows).T.astype(np.uint64):
            h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return h.view(np.int64)


def least_matches(threshold: float, size: int, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, fewest matches of n compared values with which a pair stays) after each batch.

    With a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior,
    and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(batch, size, batch), size]:
        below, m = 0.0, 0
        while m <= n:
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def shingle_features(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """id, h, n, digest of the set, one byte of each signature value, and the bands' buckets."""

    def run(batches):
        import xxhash

        s = Signatures(bands, rows)
        for b in batches:
            n, digest, sig, buckets = [], [], [], []
            for x in b.column("text"):
                h = shingle_set(x.as_py() or "", words)
                n.append(len(h))
                if len(h):
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    values = s.of(h)
                    sig.append((values >> np.uint32(7)).astype(np.uint8).tobytes())
                    buckets.append(s.buckets(values).tolist())
                else:
                    digest.append(None), sig.append(None), buckets.append(None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["id", "h", "n", "digest", "sig", "buckets"])

    return docs.mapInArrow(run, "id long, h long, n long, digest binary, sig binary, buckets array<bigint>")


def _bayes(steps: list[tuple[int, int]]):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in b.columns[2:4])
            alive, matches, at = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64), 0
            for n, least in steps:
                matches[alive] += (x[alive, at:n] == y[alive, at:n]).sum(1)
                alive, at = alive[matches[alive] >= least], n
            yield b.select(["a", "b"]).take(pa.array(alive))

    return run


def groups(batches, keys: int):
    """Tables of successive rows with equal first ``keys`` columns; one group is held beyond a batch."""
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy() for c in b.columns[:keys]]
        edges = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            key = tuple(c[s] for c in columns)
            if held and key != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(s, e - s))
            at = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates_across(t: pa.Table, bounds: list[tuple[int, int]]):
    """Rows of a pair of blocks, and its candidates as two arrays of places: in different components and within the bounds; best first."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    at, node, c = (t.column(x).to_numpy() for x in ("block", "node", "c"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
    left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
    n, least = bounds[0]
    found = []
    for k in range(0, len(left), 64):
        x = left[k : k + 64]
        ok = c[x][:, None] != c[right][None, :]
        if i == j:
            ok &= x[:, None] < right[None, :]
        p, q = np.nonzero(ok & ((sig[x][:, None, :n] == sig[right][None, :, :n]).sum(2) >= least))
        p, q = x[p], right[q]
        matches, done = (sig[p, :n] == sig[q, :n]).sum(1), n
        for m, least_m in bounds[1:]:
            matches = matches + (sig[p, done:m] == sig[q, done:m]).sum(1)
            stay = matches >= least_m
            p, q, matches, done = p[stay], q[stay], matches[stay], m
        found.append((p, q, matches))
    p, q, matches = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    order = np.argsort(-matches, kind="stable")
    return node, c, p[order], q[order]


LIVE = "bucket long, i long, j long, block long, node long, c long, sig binary"


def _with_partner(bounds: list[tuple[int, int]]):
    """Of each pair of blocks the rows that are in a candidate."""

    def run(batches):
        for t in groups(batches, 3):
            _, _, p, q = candidates_across(t, bounds)
            if len(p):
                yield from t.take(pa.array(np.unique(np.concatenate([p, q])))).to_batches()

    return run


def similar(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return denominator * both >= numerator * (len(x) + len(y) - both)


def _forest(bounds: list[tuple[int, int]], similarity: tuple[int, int]):
    """Of each pair of blocks the links that join components, none that earlier ones have joined."""

    def run(batches):
        for t in groups(batches, 3):
            node, c, p, q = candidates_across(t, bounds)
            sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("set")]
            parent = {x: x for x in c.tolist()}

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            u, v = [], []
            for a, b in zip(p.tolist(), q.tolist()):
                x, y = root(int(c[a])), root(int(c[b]))
                if x != y and similar(sets[a], sets[b], *similarity):
                    parent[x] = y
                    u.append(int(node[a]))
                    v.append(int(node[b]))
            if u:
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return run


def _exact(numerator: int, denominator: int):
    def run(batches):
        for b in batches:
            keep = [i for i, (x, y) in enumerate(zip(b.column(2), b.column(3))) if similar(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), numerator, denominator)]
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    one = values.select(F.col("node").alias("a"), F.col(name).alias("x"))
    two = values.select(F.col("node").alias("b"), F.col(name).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def linked(df: DataFrame, similarity: tuple[int, int], words: int, rows: int, miss: float, steps: Steps) -> DataFrame:
    """``id, h, n, component`` of each row of ``df`` (id, text): h is a hash of its text, component null for rows that are in no link."""
    bands = bands_for(similarity[0] / similarity[1], rows, miss)
    bounds = least_matches(similarity[0] / similarity[1], bands * rows, miss)
    docs = df.select("id", "text", F.xxhash64("text").alias("h"))
    features = steps.write(shingle_features(docs, bands, rows, words), "shingles")
    whole = features.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = whole.groupBy("digest").agg(F.min(F.struct("id", "h", "n", "sig", "buckets")).alias("f")).select("digest", "f.*")
    classes = steps.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where(F.col("centre") < F.col("last")).drop("last")
    buckets = steps.write(members.join(shared, "bucket"), "buckets")
    wanted = buckets.select("node").distinct().join(classes.select("node", "id", "h"), "node")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py() or "", words).tobytes() for x in b.column(1)], pa.binary())], ["node", "set"])

    # a class has one pair of id and text hash, of which repeated rows may come
    texts = docs.join(wanted.hint("shuffle_hash"), ["id", "h"]).dropDuplicates(["id", "h"])
    full = steps.write(texts.select("node", "text").mapInArrow(sets, "node long, set binary"), "sets")
    signatures = steps.write(classes.select("node", "sig"), "signatures")
    of_digest = steps.write(classes.select("digest", "node", "id"), "nodes")
    narrow = steps.write(features.select("id", "h", "n", "digest"), "rows")
    steps.drop(features, classes)
    centres = buckets.where(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    passed = _with_both(centres, signatures, "sig").mapInArrow(_bayes(bounds), "a long, b long")
    found = steps.write(_with_both(passed, full, "set").mapInArrow(_exact(*similarity), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    labels = components(found, steps)
    known = buckets.join(labels.withColumnRenamed("component", "c"), "node", "left").select("bucket", "node", "n", F.coalesce("c", "node").alias("c"))
    open_ = known.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size"), F.sum(F.col("n").cast("long")).alias("n_all")).where(F.col("low") < F.col("high"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, 8 * F.col("n_all") / BLOCK_BYTES))
    live = known.join(open_.select("bucket", blocks.alias("blocks")), "bucket").join(signatures, "node")
    live = live.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    live = live.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c", "sig")
    near = steps.write(live.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_with_partner(bounds), LIVE), "near")
    near = near.join(full, "node").select(*near.columns, "set")
    more = steps.write(near.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_forest(bounds, similarity), "u long, v long").distinct(), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), steps)
    of_class = of_digest.join(labels, "node")
    smallest = of_class.groupBy("component").agg(F.min("id").alias("smallest"))
    of_class = of_class.join(smallest, "component").select("digest", "smallest")
    single = of_digest.select("digest", F.col("id").alias("own"))
    return narrow.join(single.join(of_class, "digest", "left").select("digest", F.coalesce("smallest", "own").alias("component")), "digest", "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (85, 100), words: int = WORDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """``id_col, n_shingles, component_id, kept, text_hash``: components of documents with numerator/denominator similarity or more.

    text_hash (xxhash64 of the text) tells rows with one id apart.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with Steps(df) as steps:
        found = steps.keep(linked(docs, similarity, words, rows, miss, steps).select("id", "h", "n", "component"), "near-duplicates")
    return (
        found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), F.col("h").alias("text_hash"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All rows and columns of ``df`` but those that :func:`near_duplicates` does not keep.

    A row goes by its own id and text: other rows with its id stay, and so do
    repeated rows of a kept one.
    """
    gone = near_duplicates(df, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h")).distinct()
    here = df.withColumn("__of", F.xxhash64(F.col(text_col).cast("string")))
    return here.join(gone, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__of") == F.col("__h")), "left_anti").select(*df.columns)
