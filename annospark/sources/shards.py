"""Key-value files: the sharded container and one file a key, with writers, a manifest and readers.

A shard file starts with the shard index: for each minishard the start and end
of its index, counted from the end of the shard index.  A minishard index is
uint64[3][n]: keys as differences, starts as differences from the end of the
value before, sizes.  Values and indexes may be gzip files.

Tasks write to a name of their own attempt and move the file into place, so a
repeated or speculative task does no harm; what was written is counted by
group and compared with the number of keys that the caller expects.

A task holds one shard as its compressed bytes, and reads one a span at a time;
no entry is an object of its own for longer than it is handled.
"""

from __future__ import annotations

import gzip
import os
import posixpath
import uuid
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions.bits import signed, unsigned, unsigned_order
from annospark.functions.shardhash import ShardSpec, with_shards
from annospark.operators.decode import GROUP_SCHEMA, group_batches
from annospark.operators.encode import group_value, joined_runs

#: Rows of groups that one task sorts, about; a group of more is sorted by several.
PIECE_ROWS = 200_000
#: Bytes of values in one batch or read, about; one value may have more.
SPAN = 4 << 20


def file_system(path: str):
    """The file system and the path in it, of a local path or a URI."""
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def put_file(path: str, *data: bytes) -> None:
    fs, p = file_system(path)
    fs.create_dir(posixpath.dirname(p), recursive=True)
    own = f"{posixpath.dirname(p)}/.{posixpath.basename(p)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for d in data:
            f.write(d)
    fs.move(own, p)


def get_file(path: str) -> bytes:
    fs, p = file_system(path)
    with fs.open_input_stream(p) as f:
        return f.read()


def make_dir(path: str) -> None:
    fs, p = file_system(path)
    fs.create_dir(p, recursive=True)


def replace_dir(staged: str, path: str) -> None:
    """Puts a staged directory in the place of another: by a rename, or by copies where a store has none."""
    fs, p = file_system(path)
    s = file_system(staged)[1]
    if fs.get_file_info(p).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(p)
    try:
        fs.move(s, p)
    except (OSError, NotImplementedError):
        pyarrow.fs.copy_files(s, p, source_filesystem=fs, destination_filesystem=fs)
        fs.delete_dir(s)


def remove_dir(path: str) -> None:
    fs, p = file_system(path)
    if fs.get_file_info(p).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(p)


def _squeezed(data: bytes, how: str) -> bytes:
    return gzip.compress(data, 6, mtime=0) if how == "gzip" else data


def _opened(data: bytes, how: str) -> bytes:
    return gzip.decompress(data) if how == "gzip" else data


class ShardBuffer:
    """A shard in the making, to which values come in order of (minishard, unsigned key): one buffer of bytes, and 24 bytes an entry."""

    def __init__(self, spec: ShardSpec):
        self.spec, self.body, self.largest = spec, bytearray(), 0
        self.minis, self.keys, self.sizes = array("Q"), array("Q"), array("Q")

    def add(self, mini: int, key: int, value: bytes) -> None:
        self.largest = max(self.largest, len(value))
        value = _squeezed(value, self.spec.data_encoding)
        self.body += value
        self.minis.append(mini)
        self.keys.append(key)
        self.sizes.append(len(value))

    def finish(self) -> bytes:
        """The shard index; minishard indexes are put behind the values in ``body``, which follows it."""
        index = np.zeros((1 << self.spec.minishard_bits, 2), dtype="<u8")
        minis, keys, sizes = (np.frombuffer(x, dtype=np.uint64) for x in (self.minis, self.keys, self.sizes))
        ends = np.cumsum(sizes, dtype=np.uint64)
        edges = [*np.flatnonzero(np.concatenate([[True], minis[1:] != minis[:-1]])).tolist(), len(minis)] if len(minis) else []
        for s, e in zip(edges, edges[1:]):
            a = np.zeros((3, e - s), dtype="<u8")
            a[0, 0], a[0, 1:] = keys[s], np.diff(keys[s:e])
            a[1, 0], a[2] = ends[s] - sizes[s], sizes[s:e]
            at = len(self.body)
            self.body += _squeezed(a.tobytes(), self.spec.minishard_index_encoding)
            index[int(minis[s])] = at, len(self.body)
        return index.tobytes()


def pack_shard(entries: Sequence[tuple[int, int, bytes]], spec: ShardSpec) -> bytes:
    """A shard of (minishard, unsigned key, value), in that order."""
    b = ShardBuffer(spec)
    for entry in entries:
        b.add(*entry)
    return b.finish() + bytes(b.body)


def shard_values(read, spec: ShardSpec) -> Iterator[tuple[int, bytes]]:
    """(unsigned key, value) of a shard, of which ``read(start, end)`` gives bytes; a span of values is held at once."""
    head = 16 << spec.minishard_bits
    for start, end in np.frombuffer(read(0, head), dtype="<u8").reshape(-1, 2).tolist():
        if start == end:
            continue
        a = np.frombuffer(_opened(read(head + start, head + end), spec.minishard_index_encoding), dtype="<u8").reshape(3, -1)
        keys, ends = np.cumsum(a[0], dtype=np.uint64).tolist(), np.cumsum(a[1] + a[2], dtype=np.uint64).tolist()
        sizes, first = a[2].tolist(), 0
        while first < len(keys):
            at, last = ends[first] - sizes[first], first + 1
            while last < len(keys) and ends[last] - at <= SPAN:
                last += 1
            data = memoryview(read(head + at, head + ends[last - 1]))
            for k, e, n in zip(keys[first:last], ends[first:last], sizes[first:last]):
                yield k, _opened(bytes(data[e - n - at : e - at]), spec.data_encoding)
            first = last


def unpack_shard(data: bytes, spec: ShardSpec) -> dict[int, bytes]:
    """Values by unsigned key."""
    return dict(shard_values(lambda start, end: data[start:end], spec))


MANIFEST = "grp long, shard long, entries long, bytes long, largest long"


def write_sharded(rows: DataFrame, spec_of: dict[int, ShardSpec], dir_of: dict[int, str], grouped: bool, order: Sequence[str] = (), keys_of: dict[int, int] | None = None, count: int = 0) -> list:
    """Writes shards of ``grp, key, [order], id, record`` rows; returns shards, entries, bytes and the largest value of each ``grp``.

    ``grp`` tells the levels or relationships apart, so all go in one pass, and
    each shard is a partition.  grouped: rows of one key make one value; else a
    record is a value.  Groups' rows (``count`` of them) are first sorted in
    ranges of about PIECE_ROWS, which cut large groups, and joined; so shards
    are put together from few rows of joined bytes, however their rows are
    spread.  A value, and a shard's compressed bytes, are in memory at a time.
    ``keys_of`` says how many keys each group has; what is written must agree.
    """
    if not spec_of:
        return []
    shards = sum(1 << s.shard_bits for s in spec_of.values())
    n = max(1, min(shards, 20_000))
    first, at = [], 0
    for g in range(max(spec_of) + 1):
        first.append(at % n)
        at += 1 << spec_of[g].shard_bits if g in spec_of else 0
    by = ["grp", "shard", "minishard", unsigned_order(F.col("key"))]
    placed = with_shards(rows, F.col("grp"), F.col("key"), spec_of)

    def join(batches):
        """One row for each run: its members, records and ids."""
        from pyspark import TaskContext

        piece, own, size = TaskContext.get().partitionId(), [], 0
        names = ["grp", "shard", "minishard", "key", "piece", "n", "records", "ids"]
        for key, members, records, ids in joined_runs(batches, 4):
            own.append((*key, piece, members, records, ids))
            size += len(records) + len(ids) + 64
            if size >= SPAN:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*own)))), schema=joined)
                own, size = [], 0
        if own:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*own)))), schema=joined)

    joined = pa.schema([*[(c, pa.int64()) for c in ("grp", "shard", "minishard", "key", "piece", "n")], ("records", pa.binary()), ("ids", pa.binary())])
    if grouped:
        pieces = placed.repartitionByRange(max(1, -(-count // PIECE_ROWS)), *by, *order).sortWithinPartitions(*by, *order).select("grp", "shard", "minishard", "key", "id", "record")
        placed = pieces.mapInArrow(join, "grp long, shard long, minishard long, key long, piece long, n long, records binary, ids binary")
        order = ["piece"]
    place = F.element_at(F.lit(first).cast("array<bigint>"), F.col("grp").cast("int") + 1) + F.col("shard")
    src = placed.repartitionById(n, (place % n).cast("int")).sortWithinPartitions(*by, *order)
    src = src.select("grp", "shard", "minishard", "key", *(["n", "records", "ids"] if grouped else ["id", "record"]))

    def values(batches):
        """((grp, shard, minishard, key), value) of sorted rows."""
        if not grouped:
            for key, members, records, _ in joined_runs(batches, 4):
                if members > 1:
                    raise ValueError(f"key {unsigned(key[3])} is repeated")
                yield key, records
            return
        last, parts = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:5]]
            for i, (*key, members) in enumerate(zip(*columns)):
                if key != last:
                    if parts:
                        yield tuple(last), group_value(*(f(x) for f, x in zip((sum, b"".join, b"".join), zip(*parts))))
                    last, parts = key, []
                parts.append((members, b.column(5)[i].as_py(), b.column(6)[i].as_py()))
        if parts:
            yield tuple(last), group_value(*(f(x) for f, x in zip((sum, b"".join, b"".join), zip(*parts))))

    def run(batches):
        at = shard = None

        def close():
            head = shard.finish()
            put_file(f"{dir_of[at[0]]}/{spec_of[at[0]].file_name(at[1])}", head, shard.body)
            return pa.RecordBatch.from_pydict({"grp": [at[0]], "shard": [at[1]], "entries": [len(shard.keys)], "bytes": [len(head) + len(shard.body)], "largest": [shard.largest]})

        for (g, s, mini, key), value in values(batches):
            if (g, s) != at:
                if at is not None:
                    yield close()
                at, shard = (g, s), ShardBuffer(spec_of[g])
            shard.add(mini, unsigned(key), value)
        if at is not None:
            yield close()

    written = src.mapInArrow(run, MANIFEST).groupBy("grp").agg(F.count(F.lit(1)).alias("shards"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest")).collect()
    for g, n in (keys_of or {}).items():
        got = next((r for r in written if r.grp == g), None)
        if (got.entries if got else 0) != n:
            raise RuntimeError(f"group {g} has {n} keys, of which {got.entries if got else 0} were written")
    return written


def write_files(values: DataFrame, name: str = "name", value: str = "value") -> int:
    """One file a row, at the path in ``name``; returns how many."""

    def run(batches):
        fs_of, made = {}, set()  # a directory is made, and its file system found, once a task
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder, _, own_name = p.rpartition("/")
                if folder not in made:
                    fs_of[folder] = file_system(folder)
                    fs_of[folder][0].create_dir(fs_of[folder][1], recursive=True)
                    made.add(folder)
                fs, at = fs_of[folder]
                own = f"{at}/.{own_name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(data)
                fs.move(own, f"{at}/{own_name}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return values.select(name, value).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def _shard_items(spark: SparkSession, path: str, spec: ShardSpec, schema: str, batches_of) -> DataFrame:
    """``batches_of`` the (unsigned key, value) of each shard under ``path``, which its task reads in spans."""

    def run(batches):
        fs, base = file_system(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:

                    def read(start, end):
                        f.seek(start)
                        return f.read(end - start)

                    yield from batches_of(shard_values(read, spec))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shard").load(path)  # of which only the names are read
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name")).mapInArrow(run, schema)


def _spans(items, key_type, names):
    """Batches of (key, value) of about SPAN bytes."""
    keys, values, size = [], [], 0
    for k, v in items:
        keys.append(k)
        values.append(v)
        size += len(v) + 64
        if size >= SPAN:
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(values, pa.binary())], names)
            keys, values, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(values, pa.binary())], names)


def read_sharded(spark: SparkSession, path: str, spec: ShardSpec) -> DataFrame:
    """``key, value`` of all shards under ``path``; keys are longs with the unsigned bits."""
    return _shard_items(spark, path, spec, "key long, value binary", lambda items: _spans(((signed(k), v) for k, v in items), pa.int64(), ["key", "value"]))


def read_sharded_groups(spark: SparkSession, path: str, spec: ShardSpec, record_size: int, numbers: int) -> DataFrame:
    """``key, seq, id, coords, rest`` of each member of the group values of all shards: :func:`read_sharded` and ``group_rows`` in one task, which passes on no whole value."""
    return _shard_items(spark, path, spec, f"key long, {GROUP_SCHEMA}", lambda items: group_batches((((signed(k),), v) for k, v in items), record_size, numbers, [("key", pa.int64())]))


def _names(path: str) -> Iterator[str]:
    """Names of the files in a folder, as they come; hidden ones are not taken."""
    fs, p = file_system(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(p) as entries:
            yield from (e.name for e in entries if e.name[0] not in "._" and e.is_file())
    else:
        yield from (i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(p)) if i.is_file and i.base_name[0] not in "._")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of an unsharded index.

    One task lists the folder and tasks read thousands of files each: the
    driver knows no file, and small ones do not make a task for every few.
    """

    def listed(batches):
        if sum(b.num_rows for b in batches):
            own = []
            for name in _names(path):
                own.append(name)
                if len(own) == 10_000:
                    yield pa.RecordBatch.from_pydict({"name": own})
                    own = []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["name"])

    def run(batches):
        fs, base = file_system(path)

        def content(name):
            with fs.open_input_stream(f"{base}/{name}") as f:
                return f.read()

        yield from _spans(((name, content(name)) for b in batches for name in b.column(0).to_pylist()), pa.string(), ["name", "value"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return spark.range(0, 1, 1, 1).mapInArrow(listed, "name string").repartition(n, "name").mapInArrow(run, "name string, value binary")
