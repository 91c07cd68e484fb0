"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens at places that no piece of the vocabulary
crosses, so the count of a text is the sum of its pre-tokens' counts.  Tier
one is a broadcast table of the most frequent pre-tokens with their counts,
of bounded size; tier two is a cache in each worker, filled by the library.
No pre-token is ever shuffled: the table comes from bounded summaries of
heavy hitters, one a task over all rows, merged in a tree.  The table only
saves work; a count never depends on what it holds.

Rows: a null text counts as empty (0 bytes, 0 tokens); null and repeated ids
are kept as they are, one row out for each row in; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import Steps

#: Pre-tokens that a task's summary and the broadcast table hold at most.
TABLE_SIZE = 16_384
#: Pre-tokens that a worker's cache holds at most; then it starts anew.
CACHE_SIZE = 700_000
#: Summaries that one merging task or the driver reads at once.
FAN_IN = 64

_RUNS = re.compile(" +[^ \n]*|\n[^ \n]*")


class PieceCounter:
    """Counts of a sentencepiece model, pre-token by pre-token.

    Spaces become U+2581 and one is put before the text.  A cut goes before
    each run of them and before each line feed; that is exact when no piece
    has another character before U+2581 and none a line feed.  For other
    models whole texts go to the library.
    """

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = "a ﬁ\n b"
        self.cuts = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces) and "".join(self.sp.encode(probe, out_type=str)).startswith("▁a▁ﬁ")
        self.cache: dict[str, int] = {}
        self.cache_size = cache_size
        self.table: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        """Pre-tokens: one that starts with a line feed has no space before it, all others have one."""
        if not text:
            return []
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " in text or text[0] == " ":
            return [x if x[0] == "\n" else x[1:] for x in _RUNS.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def missing(self, units: list[str]) -> None:
        new = list(dict.fromkeys(units))
        for u, ids in zip(new, self.sp.encode(new, num_threads=1)):
            # the library puts a space before each: a line feed has none, an empty unit is that space
            self.cache[u] = len(ids) - 1 if u[:1] == "\n" else len(ids) if u else 1

    def lookup(self, u: str) -> int | None:
        return self.cache.get(u)

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        if len(self.cache) > self.cache_size:
            self.cache = dict(self.table)
        out, get = [], self.cache.__getitem__
        for text in texts:
            units = self.units(text)
            try:
                out.append(sum(map(get, units)))
            except KeyError:
                self.missing([u for u in units if u not in self.cache])
                out.append(sum(map(get, units)))
        return out


_counters: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def _top(c: Counter, k: int) -> Counter:
    return Counter(dict(c.most_common(k)))


def _summaries(path: str, k: int):
    def run(batches):
        p, seen, some = _counter(path), Counter(), False
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(p.units(text))
                    some = True
                if len(seen) > 16 * k:
                    seen = _top(seen, 4 * k)
        if some:
            yield pa.RecordBatch.from_pydict({"blob": [json.dumps(_top(seen, k))]})

    return run


def _merged(k: int):
    def run(batches):
        seen, some = Counter(), False
        for b in batches:
            for blob in b.column(0).to_pylist():
                seen.update(json.loads(blob))
                some = True
            seen = _top(seen, 4 * k)
        if some:
            yield pa.RecordBatch.from_pydict({"blob": [json.dumps(_top(seen, k))]})

    return run


def frequent_pretokens(df: DataFrame, path: str, text_col: str = "text", k: int = TABLE_SIZE) -> list[str]:
    """The k most frequent pre-tokens by mergeable bounded summaries of all rows."""
    summaries = df.select(F.col(text_col).cast("string")).mapInArrow(_summaries(path, k), "blob string")
    n, total = df.rdd.getNumPartitions(), Counter()
    with Steps(df) as steps:
        while n > 1:  # down to one summary, FAN_IN of which meet in a task
            n = -(-n // FAN_IN)
            summaries = steps.write(summaries, "summaries").coalesce(n).mapInArrow(_merged(k), "blob string")
        for row in summaries.collect():
            total.update(json.loads(row.blob))
    return [u for u, _ in total.most_common(k)]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for each row, as the sentencepiece model at ``path`` counts whole texts."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    counter = _counter(path)
    frequent = frequent_pretokens(src, path, "_text", table_size) if counter.cuts else []
    counter.missing(frequent)
    table = df.sparkSession.sparkContext.broadcast({u: counter.cache[u] for u in frequent})

    def run(batches):
        p = _counter(path)
        if not p.table:
            p.table = table.value
            p.cache |= p.table
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(p.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
