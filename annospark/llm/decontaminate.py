"""Benchmark decontamination by winnowing.

Of each run of ``window - gram + 1`` successive grams the one with the
smallest hash is a fingerprint, on either side, so any shared span of
``window`` words shares a fingerprint.  Documents' fingerprints are looked up
in the benchmark's; each hit is extended over every window of words around it
and confirmed word by word.  Items of fewer words than a window are one
window of their own length, looked up at every place.

A benchmark of at most ``BLOCK_BYTES`` is broadcast, and documents are
read once.  A larger one is never broadcast nor brought to the driver: both
sides' fingerprints are joined by ranges of hashes
(:mod:`annospark.llm.overlap_join`), with the same results.

Rows: a null text has no words; items without words occur nowhere; null item
ids are not reported but their words are hit; repeated items count once by
id; null and repeated document ids are kept, one row out for each row in;
empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import gram_hashes, slices, winnow
from annospark.llm.overlap_join import joined, member, merged, words_of

#: Bound on a benchmark that is broadcast: texts, ids, and ``ITEM_BYTES`` for each item.
BLOCK_BYTES, ITEM_BYTES = 32 << 20, 64


class BenchmarkIndex:
    """Word numbers, fingerprints and windows of one block of items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, gram: int):
        self.window, self.gram, self.numbers = window, gram, {}
        #: length -> {window's word numbers: item ids}
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        prints: set[int] = set()
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            if not ids:
                continue
            n = min(window, len(ids))
            at = by_length.setdefault(n, {})
            for i in range(len(ids) - n + 1):
                at.setdefault(tuple(ids[i : i + n]), set()).add(item)
            if n == window:
                h = gram_hashes(np.array(ids, dtype=np.uint64), gram)
                prints.update(h[winnow(h, window - gram + 1)].tolist())
        self.prints = np.array(sorted(prints), dtype=np.uint64)
        self.windows = {}
        for n, at in by_length.items():
            rows = np.array(list(at), dtype=np.int64)
            h = gram_hashes_rows(rows)
            order = np.argsort(h)
            items_of = list(at.values())
            self.windows[n] = (h[order], rows[order], [items_of[i] for i in order])

    def starts(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Places at which a window of n words may begin."""
        if n < self.window:
            return np.arange(max(0, len(ids) - n + 1))
        h = gram_hashes(ids.astype(np.uint64), self.gram)
        at = winnow(h, n - self.gram + 1)
        seeds = at[member(self.prints, h[at])]
        around = (seeds[:, None] + np.arange(self.gram - n, 1)[None, :]).ravel()
        return np.unique(around[(around >= 0) & (around <= len(ids) - n)])

    def occurrences(self, ids: np.ndarray):
        """(start, length, item ids) of each place where a window occurs."""
        for n, (hashes, rows, items_of) in self.windows.items():
            starts = self.starts(ids, n)
            if not len(starts):
                continue
            if n < self.window:
                found = gram_hashes(ids.astype(np.uint64), n)
            else:
                found = gram_hashes_rows(ids[starts[:, None] + np.arange(n)])
            at = np.searchsorted(hashes, found)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == found):
                if np.array_equal(ids[starts[i] : starts[i] + n], rows[at[i]]):
                    yield int(starts[i]), n, items_of[at[i]]


def gram_hashes_rows(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of each row as one gram."""
    n = rows.shape[1]
    return gram_hashes(np.ascontiguousarray(rows).astype(np.uint64).ravel(), n)[::n] if len(rows) else np.empty(0, np.uint64)


_indexes: dict[tuple, BenchmarkIndex] = {}


def _index(block, window: int, gram: int) -> BenchmarkIndex:
    """The index of a broadcast block, made once a worker; a worker holds one."""
    key = (block._path, window, gram)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = BenchmarkIndex(block.value, window, gram)
    return _indexes[key]


def _looking_up(block, window: int, gram: int):
    """Arrow batches of id, text and more to batches of id, n_words, spans, items and more."""
    kinds = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string())

    def run(batches):
        index = _index(block, window, gram)
        number = index.numbers.get
        gap = [-1] * window
        for b in batches:
            n_words, spans, items = [], [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for first, texts in slices(b, 1):
                ids, ends = [], []
                for text in texts:
                    ws = words_of(text)
                    ids += [number(w, -1) for w in ws]
                    n_words.append(len(ws))
                    ends.append(len(ids))
                    ids += gap  # no window crosses from one document to the next
                found: dict[int, list] = {}
                for start, n, of in index.occurrences(np.array(ids, dtype=np.int64)):
                    d = int(np.searchsorted(ends, start, side="right"))
                    found.setdefault(d, []).append((start - (ends[d - 1] + window if d else 0), n, of))
                for d, hits in found.items():
                    spans[first + d] = merged([(s, s + n) for s, n, _ in hits])
                    items[first + d] = sorted({x for *_, of in hits for x in of if x is not None})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, kinds[0]), pa.array(items, kinds[1]), *b.columns[2:]], ["id", "n_words", "spans", "items", *b.schema.names[2:]])

    return run


def find_overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, n_words, spans, items`` and the columns in ``keep``, as ``keep_0``, ``keep_1`` ...: spans are hit word ranges [start, end), merged; items are sorted ids as text."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + ITEM_BYTES), F.lit(0)).alias("n")).first().n
    if size > block_bytes:
        out = joined(docs, b, window, gram)
    else:
        block = documents.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in b.collect()])
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
        kept = "".join(f", keep_{i} {kinds[f'keep_{i}']}" for i in range(len(keep)))
        out = docs.mapInArrow(_looking_up(block, window, gram), f"id {kinds['id']}, n_words long, spans array<struct<s:bigint,e:bigint>>, items array<string>{kept}")
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items", *[f"keep_{i}" for i in range(len(keep))])


def without_overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """All rows and columns of ``documents`` but the rows with a hit span; each row goes by its own text."""
    found = find_overlaps(documents, benchmark, id_col, keep=tuple(documents.columns), **how)
    return found.where(F.size("spans") == 0).select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(documents.columns)])
