"""Substring deduplication by seeds and extension.

Seeds are winnowed grams of words: every run of ``window`` words holds one,
chosen by its content alone, so runs that are equal share a seed at the same
place.  Documents are joined on their seeds; a seed that a single document has
is dropped.  Around each remaining seed all runs of ``window`` words that
chose it are extended to both sides and matched at once by the hash of their
words (80 bits), rather than pair by pair.  A run that also starts in a
document with a smaller id is a repeat; touching and overlapping repeats of a
document merge into its maximal repeats, all of ``window`` words or more.

Both joins are exchanges of chunks with ranges of hashes (see
:mod:`annospark.llm.exchange`): a passage that a third of all documents have
comes once from each chunk, and the answer is a bit.

Rows: a null text has no words; a null id takes no part and loses nothing;
rows with one id are told apart by a 64-bit hash of their texts and do not
match each other (no id is smaller); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm import exchange
from annospark.llm.common import Steps, gram_hashes, mix64, text_bytes, winnow_places, word_hashes
from annospark.llm.exchange import expand, squeeze

WINDOW = 13
#: Words of a seed.
GRAM = 6
#: Bytes of text in a chunk, and of all texts to a range of hashes.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
WORD_RE = re.compile("[^\\x20\\x09-\\x0D]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _encode(batches):
    """Chunks of documents: ids, text hashes, words a document, and the words as numbers of the chunk's distinct hashes."""
    from pyspark import TaskContext

    base, n = TaskContext.get().partitionId() << 24, 0

    def chunk():
        words, stream = np.unique(np.concatenate(hashes), return_inverse=True)
        data = squeeze(np.array(ids, np.int64), np.array(tags, np.int64), np.array(list(map(len, hashes)), np.int64), stream.astype(np.uint32), words)
        return exchange.rows([(base + n, data)], ("chunk", "blob"))

    ids, tags, hashes, size = [], [], [], 0
    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
            text = t.as_py()
            ids.append(i)
            tags.append(h)
            hashes.append(word_hashes(words_of(text)))
            size += len(text) + 64
            if size > CHUNK_BYTES:
                yield chunk()
                ids, tags, hashes, size, n = [], [], [], 0, n + 1
    if ids:
        yield chunk()


class Chunk:
    """Seeds and runs of a chunk; all documents' words stand in one array, and a run lies in one document."""

    def __init__(self, data: bytes, window: int, gram: int, bits: int):
        self.ids, self.tags, lens, stream, words = expand(data)
        self.window, self.gram, self.bits = window, gram, bits
        self.h = words[stream.astype(np.int64)]
        ends = np.cumsum(lens)
        self.begin, self.doc = ends - lens, np.repeat(np.arange(len(lens)), lens)
        n = max(0, len(self.h) - window + 1)
        self.starts = np.flatnonzero(np.arange(n) + window <= ends[self.doc[:n]])
        self.grams = gram_hashes(self.h, gram)
        chosen = winnow_places(self.grams, window - gram + 1)[self.starts]
        at = np.unique(chosen)
        self.seed_of = np.searchsorted(at, chosen)  # each run's seed
        self.seeds, self.number = np.unique(self.grams[at], return_inverse=True)
        low, high = np.full(len(self.seeds), len(lens)), np.full(len(self.seeds), -1)
        np.minimum.at(low, self.number, self.doc[at])
        np.maximum.at(high, self.number, self.doc[at])
        self.many = high > low

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def ask_seeds(self):
        for p, s, e in exchange.ranges(self.range_of(self.seeds)):
            yield p, squeeze(self.seeds[s:e], self.many[s:e])

    def extend(self, shared: np.ndarray) -> None:
        """Runs around shared seeds, by the hash of their words, and each distinct run's smallest id here."""
        on = shared[self.number][self.seed_of]
        self.starts = self.starts[on]
        w = gram_hashes(self.h, self.window)[self.starts]
        more = mix64(self.grams[self.starts] ^ (self.grams[self.starts + self.window - self.gram] >> np.uint64(7))) >> np.uint64(48)
        order = np.lexsort((more, w))
        w, more = w[order], more[order]
        fresh = np.ones(len(w), dtype=bool)
        fresh[1:] = (w[1:] != w[:-1]) | (more[1:] != more[:-1])
        self.run = np.empty(len(w), dtype=np.int64)
        self.run[order] = np.cumsum(fresh) - 1
        self.runs, self.more = w[fresh], more[fresh].astype(np.uint16)
        self.owner = self.ids[self.doc[self.starts]]
        self.low = np.full(len(self.runs), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.run, self.owner)

    def ask_runs(self):
        for p, s, e in exchange.ranges(self.range_of(self.runs)):
            yield p, squeeze(self.runs[s:e], self.more[s:e], self.low[s:e])

    def repeats(self, smaller: np.ndarray):
        """(id, text hash, places) of documents with repeated runs."""
        hit = np.flatnonzero(smaller[self.run] | (self.owner > self.low[self.run]))
        doc = self.doc[self.starts[hit]]
        for d, s, e in exchange.ranges(doc):
            yield int(self.ids[d]), int(self.tags[d]), (self.starts[hit[s:e]] - self.begin[d]).tolist()


def _shared_seeds(p, chunks, parts):
    seeds, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.bincount(at, weights=1.0 + np.concatenate([m for _, m in parts]), minlength=len(seeds))
    for c, i in zip(chunks, np.split(at, np.cumsum([len(k) for k, _ in parts])[:-1])):
        yield c, squeeze(np.array([len(i)], np.int64), np.packbits(n[i] > 1))


def _smaller_runs(p, chunks, parts):
    w, more, low = (np.concatenate([x[k] for x in parts]) for k in range(3))
    order = np.lexsort((more, w))
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (w[order][1:] != w[order][:-1]) | (more[order][1:] != more[order][:-1])
    run = np.empty(len(w), dtype=np.int64)
    run[order] = np.cumsum(fresh) - 1
    first = np.minimum.reduceat(low[order], np.flatnonzero(fresh))
    smaller = first[run] < low
    for c, i in zip(chunks, np.split(smaller, np.cumsum([len(x[0]) for x in parts])[:-1])):
        yield c, squeeze(np.array([len(i)], np.int64), np.packbits(i))


def _bits(answers) -> np.ndarray:
    parts = [np.unpackbits(a, count=int(n[0])).astype(bool) for n, a in (expand(x["blob"]) for x in answers or [])]
    return np.concatenate(parts) if parts else np.empty(0, dtype=bool)


def _asking(window: int, gram: int, bits: int, step: str):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk(b.column(1)[i].as_py(), window, gram, bits)
                if step != "seeds":
                    c.extend(_bits(b.column(2)[i].as_py()))
                if step == "repeats":
                    found = list(c.repeats(_bits(b.column(3)[i].as_py())))
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["id", "h", "starts"])
                else:
                    name = b.column(0)[i].as_py()
                    yield exchange.rows([(p, name, blob) for p, blob in (c.ask_seeds() if step == "seeds" else c.ask_runs())])

    return run


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id, h, starts``: for each document with repeats the places of its repeated runs; h is xxhash64 of its text."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).where("id is not null and text is not null")
    bits = max(2, int(text_bytes(docs) // RANGE_BYTES).bit_length())
    with Steps(df, exchange.ONE_A_BATCH) as steps:
        chunks = steps.write(docs.mapInArrow(_encode, "chunk long, blob binary"), "chunks")
        seeds = steps.write(exchange.reduce(chunks.mapInArrow(_asking(window, gram, bits, "seeds"), exchange.ASK), _shared_seeds), "seeds")
        runs = steps.write(exchange.reduce(exchange.answered(chunks, seeds).mapInArrow(_asking(window, gram, bits, "runs"), exchange.ASK), _smaller_runs), "runs")
        found = exchange.answered(chunks, seeds, runs).mapInArrow(_asking(window, gram, bits, "repeats"), "id long, h long, starts array<bigint>")
        return steps.keep(found.dropDuplicates(["id", "h"]), "repeats")  # repeated rows of one id and text have the same


def covered(starts: list[int] | None, n: int, window: int) -> np.ndarray:
    """Which of n words a repeated run covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if starts:
        at = np.unique(np.array(starts, dtype=np.int64))
        edge[at] += 1
        edge[at + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_repeats(df: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``run`` over Arrow batches of id, text, starts and the columns in ``keep``."""
    found = repeats(df, id_col, text_col, window, gram)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    return docs.join(found, ["id", "h"], "left").select("id", "text", "starts", *[f"_k{i}" for i in range(len(keep))]).mapInArrow(run, schema)


def kept_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256, spans``: spans are the maximal repeats as word ranges [start, end)."""

    def run(batches):
        import hashlib

        spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            n, gone, sha, spans = [], [], [], []
            for x, starts in zip(b.column(1), b.column(2)):
                text = x.as_py() or ""
                words = words_of(text)
                out = covered(starts.as_py(), len(words), window)
                n.append(len(words))
                gone.append(int(out.sum()))
                left = [w for w, o in zip(words, out.tolist()) if not o] if gone[-1] else words
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
                at = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                spans.append([{"s": s, "e": e} for s, e in at.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, spans_type)], ["id", "n_words", "n_removed", "kept_sha256", "spans"])

    out = with_repeats(df, run, "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<s:bigint,e:bigint>>", id_col, text_col, (), window, gram)
    return out.withColumnRenamed("id", id_col)


def cut(text: str, starts: list[int] | None, window: int = WINDOW) -> str:
    """The text without its repeats, each with the white space after it."""
    if not starts:
        return text
    found = list(WORD_RE.finditer(text))
    out = covered(starts, len(found), window)
    if not out.any():
        return text
    ends = [*(m.start() for m in found[1:]), len(text)]
    return text[: found[0].start()] + "".join(text[m.start() : e] for m, e, o in zip(found, ends, out.tolist()) if not o)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of ``df``, the text without its repeats."""
    others = tuple(c for c in df.columns if c not in (id_col, text_col))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        for b in batches:
            texts = [None if x.as_py() is None else cut(x.as_py(), s.as_py(), window) for x, s in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[3:]], ["id", "text", *b.schema.names[3:]])

    schema = "id long, text string" + "".join(f", _k{i} {kinds[c]}" for i, c in enumerate(others))
    out = with_repeats(df, run, schema, id_col, text_col, others, window, gram)
    back = {id_col: F.col("id").cast(kinds[id_col]), text_col: F.col("text")} | {c: F.col(f"_k{i}") for i, c in enumerate(others)}
    return out.select(*[back[c].alias(c) for c in df.columns])
