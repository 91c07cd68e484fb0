"""Join of documents' and a benchmark's fingerprints, for a benchmark of any size.

Both sides are cut into chunks that exchange hashes by ranges (see
:mod:`annospark.llm.exchange`); nothing is broadcast, and a key that many
documents have comes once from each chunk.

1. Seeds.  Of each window of ``window`` words the winnowed gram is its seed; a
   window of an item with fewer words is a seed as a whole.  A document chunk
   learns for each of its seeds whether the benchmark has it.
2. Extension.  All windows around a shared seed are asked for by 128 bits of
   their words; the answers name the items that hold them.
3. Spans and items of each text that is hit, by the digest of the text, are
   written and joined to the documents.

The item ids of one window are in one task and in one document's row, as the
result lists them all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm import exchange
from annospark.llm.common import Steps, gram_hashes, mix64, text_bytes, winnow_places, word_hashes
from annospark.llm.exchange import expand, small, squeeze

#: Bytes of text in a chunk, and of all texts to a range of hashes.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: A-Z in lower case; every byte outside a-z, 0-9 and non-ASCII becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same rule for texts of which places are needed.
WORD_RE = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOUND = "digest string, spans array<struct<s:bigint,e:bigint>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"s": s, "e": e} for s, e in out]


def _strings(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data = [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]
    return np.array([-1 if v is None else len(d) for v, d in zip(values, data)], np.int64), np.frombuffer(b"".join(data), np.uint8)


def _listed(lens: np.ndarray, data: np.ndarray) -> list[str | None]:
    raw, ends = data.tobytes(), np.cumsum(np.maximum(lens, 0)).tolist()
    return [None if n < 0 else raw[e - n : e].decode("utf-8", "surrogatepass") for n, e in zip(lens.tolist(), ends)]


def _encoding(of_items: bool):
    """Chunks of (key, text): keys, words a text, and the words as numbers of the chunk's distinct hashes.

    Documents' chunks are numbered from 0 up and hold equal texts once, the
    benchmark's from -2 down.
    """

    def run(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 24, 0

        def chunk():
            words, stream = np.unique(np.concatenate(hashes), return_inverse=True)
            name = -2 - base - n if of_items else base + n
            return exchange.rows([(name, squeeze(*_strings(keys), np.array(list(map(len, hashes)), np.int64), stream.astype(np.uint32), words))], ("chunk", "blob"))

        keys, hashes, seen, size = [], [], set(), 0
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not of_items:
                    if key in seen:
                        continue
                    seen.add(key)
                text = t.as_py()
                keys.append(key)
                hashes.append(word_hashes(words_of(text)))
                size += len(text) + 64
                if size > CHUNK_BYTES:
                    yield chunk()
                    keys, hashes, seen, size, n = [], [], set(), 0, n + 1
        if keys:
            yield chunk()

    return run


class Chunk:
    """Windows and seeds of a chunk; all words stand in one array, and a window lies in one text."""

    def __init__(self, data: bytes, of_items: bool, window: int, gram: int, lengths: list[int], bits: int):
        key_lens, key_data, lens, stream, words = expand(data)
        self.key_data, self.bits, self.lengths = (key_lens, key_data), bits, lengths
        self.h = words[stream.astype(np.int64)]
        ends = np.cumsum(lens)
        self.begin, self.text = ends - lens, np.repeat(np.arange(len(lens)), lens)
        left = ends[self.text] - np.arange(len(self.h))
        starts, seeds = [], []
        for n in lengths:
            # an item of fewer words than the window is one window, at its start
            at = self.begin[lens == n] if of_items and n < window else np.flatnonzero(left >= n)
            h = gram_hashes(self.h, gram if n == window else n)
            if n == window and len(at):
                h = h[winnow_places(h, window - gram + 1)]
            starts.append(at.astype(np.int32))
            seeds.append(mix64(h[at] ^ np.uint64(n)))
        self.n = np.repeat(np.array(lengths, np.int32), list(map(len, starts)))
        self.starts = np.concatenate([np.empty(0, np.int32), *starts])
        self.seeds, self.number = np.unique(np.concatenate([np.empty(0, np.uint64), *seeds]), return_inverse=True)

    def ranges(self, hashes: np.ndarray):
        return exchange.ranges((hashes >> np.uint64(64 - self.bits)).astype(np.int64))

    def keys(self) -> list[str | None]:
        return _listed(*self.key_data)

    def ask_seeds(self):
        for p, s, e in self.ranges(self.seeds):
            yield p, squeeze(self.seeds[s:e])

    def extend(self, shared: np.ndarray | None = None) -> None:
        """The windows around shared seeds (all of them if None), and the distinct ones by 128 bits of their words."""
        if shared is not None:
            on = shared[self.number]
            self.n, self.starts = self.n[on], self.starts[on]
        w, more = np.empty(len(self.n), np.uint64), np.empty(len(self.n), np.uint64)
        other = mix64(self.h ^ np.uint64(0x9E3779B97F4A7C15))
        for n in self.lengths:
            on = self.n == n
            if on.any():
                w[on] = mix64(gram_hashes(self.h, n)[self.starts[on]] ^ np.uint64(n))
                more[on] = gram_hashes(other, n)[self.starts[on]]
        order, fresh = _distinct(w, more)
        self.of = np.empty(len(w), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.w, self.more = w[order][fresh], more[order][fresh]

    def ask_windows(self):
        for p, s, e in self.ranges(self.w):
            yield p, squeeze(self.w[s:e], self.more[s:e])

    def tell_windows(self):
        """Windows with the items that hold them, once for each item row."""
        windows, texts = _pairs(self.of, self.text[self.starts])
        keys = self.keys()
        for p, s, e in self.ranges(self.w[windows]):
            rows, number = np.unique(texts[s:e], return_inverse=True)
            of = windows[s:e]
            yield p, squeeze(self.w[of], self.more[of], number.astype(np.uint32), *_strings([keys[r] for r in rows.tolist()]))

    def hits(self, answers):
        """(digest, spans, items) of each text that a window of the benchmark hits."""
        hit, counts, names = [np.empty(0, bool)], [np.empty(0, np.int64)], []
        for x in answers or []:
            n, bits, count, flat, lens, data = expand(x["blob"])
            hit.append(np.unpackbits(bits, count=int(n[0])).astype(bool))
            counts.append(np.zeros(int(n[0]), np.int64))
            counts[-1][hit[-1]] = count
            known = _listed(lens, data)
            names += [known[i] for i in flat.tolist()]
        hit, counts = np.concatenate(hit), np.concatenate(counts)
        ends = np.cumsum(counts)
        at = np.flatnonzero(hit[self.of]) if len(self.of) else np.empty(0, np.int64)
        at = at[np.argsort(self.text[self.starts[at]], kind="stable")]
        text, keys = self.text[self.starts[at]], self.keys()
        for t, s, e in exchange.ranges(text):
            own = at[s:e]
            begin = self.starts[own] - self.begin[t]
            items: set[str] = set()
            for w in np.unique(self.of[own]).tolist():
                items.update(names[ends[w] - counts[w] : ends[w]])
            yield keys[t], merged(list(zip(begin.tolist(), (begin + self.n[own]).tolist()))), sorted(items)


def _distinct(w: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (w, more), and where in it a new pair begins."""
    order = np.lexsort((more, w))
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (w[order][1:] != w[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, fresh


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    order, fresh = _distinct(a, b)
    return a[order][fresh], b[order][fresh]


def _shared_seeds(p, chunks, parts):
    known = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[0] for c, x in zip(chunks, parts) if c < -1)]))
    for c, x in zip(chunks, parts):
        if c >= 0:
            yield c, squeeze(np.array([len(x[0])], np.int64), np.packbits(member(known, x[0])))


def _items_of_windows(p, chunks, parts):
    told, names = [x for c, x in zip(chunks, parts) if c < -1], {None: -1}
    w, more = (np.concatenate([np.empty(0, np.uint64), *(x[k] for x in told)]) for k in range(2))
    item = [np.empty(0, np.int64)]
    for x in told:
        numbers = [names.setdefault(k, len(names) - 1) for k in _listed(x[3], x[4])]
        item.append(np.array(numbers, np.int64)[x[2].astype(np.int64)])
    order, fresh = _distinct(w, more)
    w, more = w[order][fresh], more[order][fresh]
    held, items = _pairs(np.cumsum(fresh) - 1, np.concatenate(item)[order])
    held, items = held[items >= 0], items[items >= 0]  # rows without an item id hit, but are not reported
    ends = np.searchsorted(held, np.arange(len(w)), side="right")
    counts = np.diff(ends, prepend=0)
    equal = int(np.diff(np.flatnonzero(np.diff(w, prepend=~w[:1]) != 0), append=len(w)).max()) if len(w) else 0
    known = [k for k in names if k is not None]
    for c, x in zip(chunks, parts):
        if c < 0:
            continue
        first, at = np.searchsorted(w, x[0]), np.full(len(x[0]), -1)
        for k in range(equal):  # windows that share the first 64 bits lie side by side
            j = np.minimum(first + k, len(w) - 1)
            at = np.where((w[j] == x[0]) & (more[j] == x[1]), j, at)
        of = at[at >= 0]
        count = counts[of]
        flat = items[np.repeat(ends[of] - np.cumsum(count), count) + np.arange(int(count.sum()))]
        rows, number = np.unique(flat, return_inverse=True)
        yield c, squeeze(np.array([len(at)], np.int64), np.packbits(at >= 0), small(count), small(number), *_strings([known[r] for r in rows.tolist()]))


def _bits(answers) -> np.ndarray:
    parts = [np.unpackbits(a, count=int(n[0])).astype(bool) for n, a in (expand(x["blob"]) for x in answers or [])]
    return np.concatenate(parts) if parts else np.empty(0, dtype=bool)


def found_texts(documents: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """``digest, spans, items`` of each text that is hit, from documents (``digest, text``) and items (``item, text``), texts not null."""
    bits = max(2, int((text_bytes(documents) + text_bytes(items)) // RANGE_BYTES).bit_length())
    n_words = F.regexp_count("text", F.lit(WORD_RE.pattern))
    lengths = sorted(r.n for r in items.select(F.least(n_words, F.lit(window)).alias("n")).where("n > 0").distinct().collect())  # at most ``window`` rows

    def asking(of_items: bool, step: str):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    c = Chunk(b.column(1)[i].as_py(), of_items, window, gram, lengths, bits)
                    if step != "seeds":
                        c.extend(None if of_items else _bits(b.column(2)[i].as_py()))
                    if step == "hits":
                        found = list(c.hits(b.column(3)[i].as_py()))
                        kinds = pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["digest", "spans", "items"])
                    else:
                        name = b.column(0)[i].as_py()
                        asked = c.ask_seeds() if step == "seeds" else c.tell_windows() if of_items else c.ask_windows()
                        yield exchange.rows([(p, name, blob) for p, blob in asked])

        return run

    with Steps(documents, exchange.ONE_A_BATCH) as steps:
        chunks = steps.write(documents.mapInArrow(_encoding(False), "chunk long, blob binary"), "chunks")
        bench = steps.write(items.mapInArrow(_encoding(True), "chunk long, blob binary"), "items")
        asked = chunks.mapInArrow(asking(False, "seeds"), exchange.ASK).unionByName(bench.mapInArrow(asking(True, "seeds"), exchange.ASK))
        seeds = steps.write(exchange.reduce(asked, _shared_seeds), "seeds")
        asked = exchange.answered(chunks, seeds).mapInArrow(asking(False, "windows"), exchange.ASK).unionByName(bench.mapInArrow(asking(True, "windows"), exchange.ASK))
        windows = steps.write(exchange.reduce(asked, _items_of_windows), "windows")
        found = exchange.answered(chunks, seeds, windows).mapInArrow(asking(False, "hits"), FOUND)
        return steps.keep(found.dropDuplicates(["digest"]), "overlaps")  # equal texts of several chunks have the same


def joined(documents: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """``documents`` with ``n_words``, ``spans`` and ``items`` of their column ``text``; a null text has no words."""
    docs = documents.withColumn("digest", F.md5("text"))
    found = found_texts(docs.select("digest", "text").where("text is not null"), items, window, gram)
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD_RE.pattern)), F.lit(0)).cast("long")
    out = docs.withColumn("n_words", n_words).join(found, "digest", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("spans", "items")})
