"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles
(runs of ``words`` words; a shorter text is one shingle; a text without words
has an empty sketch).  Sketches of parts merge into the sketch of the whole.
Two sketches estimate resemblance, containment and, one alone, the number of
distinct shingles; while a text has at most k shingles all are exact.

Rows: a null text counts as empty; two empty sketches have likeness 1, an empty
and another 0; repeated ids are kept in the order (id, hash of the text); null
ids come first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIZE = 128
WORDS = 5
_SPLIT = "[\\x20\\x09-\\x0D]+"
_LONGS = "array<bigint>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    hashes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.slice(h, i, words)))
        return F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast(_LONGS))

    return let(hashes, runs)


def smallest(hashes: Column, k: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = SIZE, words: int = WORDS) -> Column:
    """The text's sketch: its smallest distinct shingle hashes, ascending."""
    return smallest(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Of the k smallest hashes of both: how many, and how many that both have."""
    u = merge(a, b, k)
    return F.size(u), F.size(F.array_intersect(F.array_intersect(a, b), u))


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimate of |A & B| / |A | B|; 1 for two empty sketches, null where one is null."""
    n, both = _shared(a, b, k)
    return F.when(n == 0, 1.0).otherwise(both.cast("double") / F.greatest(n, F.lit(1)))


def distinct_shingles(s: Column, k: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) / the k-th smallest as a share of all hashes."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimate of |A & B| / |A|: the resemblance times the size of the union, over the size of A; 1 for an empty A."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def text_of(s: Column) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merge_parts(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = SIZE, salts: int = 64) -> DataFrame:
    """``key, sketch`` of all parts of each key.

    Ranks hashes within salted pieces of a key first, so a key with a third of
    all parts is cut down to k hashes a piece before its pieces meet.
    """
    h = parts.select(F.col(key), F.explode_outer(sketch_col).alias("h")).distinct()
    piece = W.partitionBy(key, F.pmod(F.col("h"), F.lit(salts))).orderBy("h")
    h = h.withColumn("r", F.row_number().over(piece)).where(F.col("r") <= k).select(key, "h")
    return h.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("sketch"))


def _range_buckets(ids: DataFrame, n: int) -> tuple[list[list[int]], list[int]]:
    """Bounds of about n ranges of ids with as many rows each, in runs of up to 512 for a search in two steps, and the first bound of each run."""
    if n < 2:
        return [], []
    got = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("b")).first().b or []
    bounds = sorted(set(got))
    runs = [bounds[i : i + 512] for i in range(0, len(bounds), 512)]
    return runs, [r[0] for r in runs]


def with_next(df: DataFrame, id_col: str, text_col: str, made: dict, finish) -> DataFrame:
    """Each row with the text of the next in ascending id (after the last: the first).

    One shuffle of the rows by ranges of ids; the first row of each range is
    also sent, as a ghost, to the end of the range before.  ``made`` are columns
    from ``id, text, next``; ``finish`` are columns that may also use the same
    of the next row, named ``next_<name>``.  The second window needs no shuffle.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    runs, heads = _range_buckets(src.select("id"), 2 * df.rdd.getNumPartitions())
    if heads:
        longs = lambda xs: F.lit(xs).cast(_LONGS)
        below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("id")))
        nested = F.array(*[longs(r) for r in runs])
        run = below(longs(heads))
        place = F.when(F.col("id").isNull() | (run == 0), 0).otherwise((run - 1) * 512 + below(F.element_at(nested, F.greatest(run, F.lit(1)))))
    else:
        place = F.lit(0)
    src = src.withColumn("bucket", place.cast("int"))
    firsts = {r.bucket: r.f.id for r in src.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("f")).collect()}
    full = sorted(firsts)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    size = full[-1] + 1 if full else 1
    first = F.element_at(F.lit([firsts.get(b) or 0 for b in range(size)]).cast(_LONGS), F.col("bucket") + 1)
    null_first = bool(full) and firsts[full[0]] is None
    is_first = F.col("id").eqNullSafe(F.when((F.col("bucket") == (full[0] if full else 0)) & F.lit(null_first), F.lit(None).cast("long")).otherwise(first))
    back = F.element_at(F.lit([before.get(b, 0) for b in range(size)]).cast("array<int>"), F.col("bucket") + 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    ghost = F.struct(back.alias("bucket"), F.lit(True).alias("ghost"))
    rows = src.select("id", "text", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))).alias("at")).select("id", "text", "at.bucket", "at.ghost")
    # a ghost follows all rows of its range: their ids are smaller, but for the first row of all
    order = W.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = rows.withColumn("next", F.lead("text").over(order))
    rows = rows.select("id", "text", "bucket", "ghost", "next", *[c.alias(n) for n, c in made.items()])
    later = [F.lead(n).over(order).alias(f"next_{n}") for n in made if n in finish[0]]
    return rows.select("*", *later).where(~F.col("ghost")).select(F.col("id").alias(id_col), *[c.alias(n) for n, c in finish[1].items()])


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIZE, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to it and to the next document's."""
    n = F.length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next", F.lit(1), m))
    made = {
        "n_chars": n.cast("long"),
        "own": sketch(F.col("text"), k, words),
        "both": let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), sketch(e, k, words).alias("s"))),
    }
    own, other = F.col("own"), F.col("both.s")
    finish = {
        "n_chars": F.col("n_chars"), "edited_sha256": F.col("both.sha"), "fingerprint": text_of(own), "edited_fingerprint": text_of(other),
        "near_edited": resemblance(own, other, k), "near_next": resemblance(own, F.col("next_own"), k),
        "n_shingles_est": distinct_shingles(own, k),
    }
    return with_next(df, id_col, text_col, made, ({"own"}, finish))
