"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents become token ids on the map side.  A document longer than a
sequence is cut: whole sequences first, and the rest is packed with other
documents.  Documents are dealt into randomised groups of about
``group_docs``, and each group is packed on its own, so no task ever holds
more than a group and the groups are as many as the input asks for.

Rows: a null text counts as empty and is its end id alone; null and repeated
ids are kept, each row packed by itself; a row's group is drawn from its id,
its token ids and its partition's number, so a repeated task deals as the first
did, in whatever order its rows come (repeated rows of one id and text share a
group with those of their partition alone); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents a group is meant to have.
GROUP_DOCS = 8192
CACHE_SIZE = 600_000
#: Unicode's White_Space, as the inside of a character class.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LATIN = re.compile("[\n -~À-ɏ]+")
_RARE = re.compile("[\t\x0b\x0c\r\x85\xa0  -     　]")
_BEFORE_SPACE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


class ByteLevelIds:
    """Token ids of a byte-level BPE of the ``tokenizers`` library, remembered by pre-token.

    The pre-tokeniser never joins a character and white space after it, so
    texts may be cut there; each unit (white space, then the rest) is encoded
    by the library once and its ids kept as little-endian uint32 bytes.

    ``ranks`` may name the same vocabulary as ranks: then ``tiktoken``, with
    the same pattern and so the same ids, encodes units of ASCII and Latin
    letters, on which the two libraries' Unicode tables cannot differ.
    """

    def __init__(self, path: str, ranks: str | None = None, cache_size: int = CACHE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tk.get_added_tokens_decoder().values()]
        self.cuts = '"type":"ByteLevel","add_prefix_space":false' in self.tk.to_str().replace(" ", "") and self.tk.normalizer is None
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.quick = None
        if ranks and self.cuts:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = {t: i for t, i in self.tk.get_vocab(with_added_tokens=False).items() if i < len(table)}
            if len(own) == len(table):
                self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        """Units of a text; those that don't start with white space have a space before them, save the first."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _RARE.search(text):
            return _BEFORE_SPACE.split(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[u if u[:1] == "\n" else " " + u for u in rest]]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(x in text for x in self.added):
            return self.whole([text])[0]
        units = self.units(text)
        try:
            return b"".join(map(self.cache.__getitem__, units))
        except KeyError:
            if len(self.cache) > self.cache_size:
                self.cache.clear()
            new = {u for u in units if u not in self.cache}
            if self.quick:
                for u in [u for u in new if _LATIN.fullmatch(u)]:
                    self.cache[u] = array("I", self.quick(u)).tobytes()
                    new.discard(u)
            if new:
                new = list(new)
                self.cache.update(zip(new, self.whole(new)))
            return b"".join(map(self.cache.__getitem__, units))


_encoders: dict[str, ByteLevelIds] = {}


def _encoder(path: str, ranks: str | None) -> ByteLevelIds:
    if path not in _encoders:
        _encoders[path] = ByteLevelIds(path, ranks)
    return _encoders[path]


class Tournament:
    """First bin, by number, that still has room: a tree of the largest free capacity, grown by doubling."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.tree = [0, capacity]

    def put(self, size: int) -> int:
        t = self.tree
        if t[1] < size:
            old, n = t, self.leaves
            self.leaves, t = 2 * n, [0] * (4 * n)
            for level in range(n.bit_length()):  # the old tree becomes the left half
                w = 1 << level
                t[2 * w : 3 * w] = old[w : 2 * w]
                t[3 * w : 4 * w] = [self.capacity] * w
            t[1] = self.capacity
            self.tree = t
        i = 1
        while i < self.leaves:
            i *= 2
            if t[i] < size:
                i += 1
        at = i - self.leaves
        t[i] -= size
        while i > 1:
            i //= 2
            t[i] = max(t[2 * i], t[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes of one value keep their order."""
    bins, tree = [0] * len(sizes), Tournament(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.put(sizes[i])
    return bins


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS, seed: int = 17, ranks: str | None = None) -> DataFrame:
    """One row a piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    groups = max(1, -(-df.count() // group_docs))
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def pieces(batches):
        from pyspark import TaskContext

        enc, salt = _encoder(path, ranks), f"{seed} {TaskContext.get().partitionId()}"
        for b in batches:
            ids_of, of, start, length, crc, total, group = b.column(0), [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                g = zlib.crc32(ids, zlib.crc32(f"{salt} {ids_of[i].as_py()} ".encode())) % groups
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    of.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
                    group.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), ids_of.take(pa.array(of, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], ["grp", "id", "start", "length", "ids_crc32", "doc_tokens"])

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = t.column("length").to_pylist()
        bins = first_fit_decreasing(sizes, capacity)
        fill: dict[int, int] = {}
        offset = []
        for b, n in zip(bins, sizes):
            offset.append(at := fill.get(b, 0))
            fill[b] = at + n
        base = (t.column("grp")[0].as_py() << 32) if len(sizes) else 0
        return t.drop(["grp"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    rows = "id {0}, start long, length long, ids_crc32 long, doc_tokens long".format(kind)
    return (
        src.mapInArrow(pieces, f"grp long, {rows}").groupBy("grp").applyInArrow(packed, f"{rows}, sequence_id long, offset long")
        .select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )
