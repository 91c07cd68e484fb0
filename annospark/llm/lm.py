"""Language-model scores by a hierarchical Pitman-Yor process over words.

Each context (the word before; a document's first word has the end before it)
is a Chinese restaurant whose customers are the training tokens that follow
it; the tables of all of them are the customers of one parent restaurant, and
its base is uniform over the vocabulary and one unknown word.  Gibbs sweeps go
over contexts and parent in turn: each dish's number of tables is drawn from
its conditional given the other tables of its restaurant and the parent's
probability of it: directly up to ``DIRECT`` customers, above by
Metropolis-Hastings steps.  The generalised Stirling numbers in it are exact
up to ``STIRLING`` customers, above they are the saddle point of their
generating function (some percent more tables where they are very few).  After burn-in, each sweep gives a sample of all
predictive probabilities, which are averaged; perplexity is from the average.

No table of words or pairs is ever broadcast or collected.  The corpus is
encoded once in chunks; each chunk asks about its distinct words or pairs, in
sorted and compressed lists, one for each range of hashes, and an answer comes
back in the same order:

1. words: training counts;
2. pairs go to ranges by the context's hash, and stay there as the state of
   the sampler; the pairs of a context with more than ``HOT`` customers are
   dealt over several ranges by the second word;
3. in each sweep a range tells ranges of words how many tables it has of each
   of its words (and of each dealt context), these draw the parent's tables,
   and answer with the totals;
4. each chunk's pairs get the logs of their averaged probabilities.

All totals are counted, none is extrapolated.  As usual for sampling in
parallel, a restaurant's dishes are drawn in ``BLOCKS`` blocks given the totals
before the block, and what lies in other ranges (the parent, other parts of a
dealt context) is of the sweep before.  Words are known by 64-bit hashes, in
pairs and in the parent by 40 bits.

Rows: a null text is empty: the end alone; a null id is not learned from, nor
held out; repeated ids are scored each by its text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm import exchange
from annospark.llm.common import LOWER, Steps, mix64, text_bytes, word_hashes
from annospark.llm.exchange import expand, small, squeeze

#: Discount and strength of the contexts' restaurants and of the parent's.
CONTEXT, PARENT = (0.8, 4.0), (0.6, 20.0)
BURN_IN, SAMPLES = 3, 3
#: Customers up to which a dish's tables are drawn directly, and up to which Stirling numbers are exact.
DIRECT, STIRLING = 64, 1024
#: Blocks of dishes of a restaurant in a sweep, and Metropolis-Hastings steps of a large dish.
BLOCKS, STEPS = 4, 4
#: Customers beyond which a context's pairs are dealt over several ranges.
HOT = 2_000_000
#: Bytes of text in a chunk, and of all texts to a range of hashes.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
END = b"\n"  # no word holds white space
#: Bits of a word's hash in pairs and in the parent: the top ones, so that ids are ordered as hashes are.
WORD_BITS = 40


def ids_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - WORD_BITS)


# ---- chunks


def _encode(rest: int, out_of: int):
    def chunk(ids, learn, held, texts):
        docs = [[*t.encode("utf-8", "surrogatepass").translate(LOWER).split(), END] for t in texts]
        stream = word_hashes([w for d in docs for w in d])
        words, stream = np.unique(stream, return_inverse=True)
        return squeeze(np.array([len(d) for d in docs], dtype=np.int64), np.array(learn, dtype=bool), np.array(held, dtype=bool), stream.astype(np.uint32), words, np.array([0 if i is None else i for i in ids], dtype=np.int64), np.array([i is None for i in ids], dtype=bool))

    def run(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 24, 0
        rows, size = ([], [], [], []), 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                r = None if i is None else zlib.crc32(str(i).encode()) % out_of
                for column, x in zip(rows, (i, r is not None and r != rest, r == rest, text)):
                    column.append(x)
                size += len(text) + 64
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_pydict({"chunk": [base + n], "data": [chunk(*rows)]})
                    rows, size, n = ([], [], [], []), 0, n + 1
        if size:
            yield pa.RecordBatch.from_pydict({"chunk": [base + n], "data": [chunk(*rows)]})

    return run


class Chunk:
    def __init__(self, data: bytes):
        self.lens, self.learn, self.held, self.stream, self.words, self.ids, self.null = expand(data)
        self.stream = self.stream.astype(np.int64)
        self.learned = np.repeat(self.learn, self.lens)
        end = int(np.searchsorted(self.words, word_hashes([END])[0]))
        self.before = np.empty_like(self.stream)
        self.before[1:] = self.stream[:-1]
        self.before[np.cumsum(self.lens) - self.lens] = end

    def counts(self) -> np.ndarray:
        return np.bincount(self.stream[self.learned], minlength=len(self.words))

    def pairs(self, customers: np.ndarray, bits: int, hot: int):
        """Distinct pairs as (context, word, range), sorted by range, context, word, each token's pair, and the training count.

        customers: training tokens that follow each of the chunk's words as a context.
        """
        key, of = np.unique(self.before * len(self.words) + self.stream, return_inverse=True)
        u, w = key // len(self.words), key % len(self.words)
        deal = 1 + customers[u] // hot
        salt = (mix64(self.words[w]) % deal.astype(np.uint64)).astype(np.uint64)
        home = np.where(salt > 0, mix64(self.words[u] + salt * np.uint64(0x9E3779B97F4A7C15)), mix64(self.words[u]))
        at = (home >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), dtype=np.int64)
        order = np.lexsort((w, self.words[u], at))  # numbers of words are ordered as their hashes are
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return u[order], w[order], at[order], place[of], np.bincount(place[of][self.learned], minlength=len(key))


def _each(batch):
    """Chunk id, chunk, and the answers of each kind, as lists of array lists, of each row."""
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), Chunk(batch.column(1)[i].as_py()), *[[expand(x["blob"]) for x in c[i].as_py() or []] for c in batch.columns[2:]]


def _joined(parts: list[list[np.ndarray]], k: int) -> np.ndarray:
    return np.concatenate([p[k].astype(np.int64) for p in parts]) if parts else np.empty(0, np.int64)


# ---- words


def _ask_words(bits: int):
    def run(batches):
        for b in batches:
            for chunk, c in _each(b):
                n = c.counts()
                at = (c.words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(c.words), np.int64)
                yield exchange.rows([(p, chunk, squeeze(c.words[s:e], small(n[s:e]))) for p, s, e in exchange.ranges(at)])

    return run


def _merge(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums by key over all parts (values: part x keys x columns), and where each part's keys are among the distinct ones."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros((len(distinct), values[0].shape[1]), dtype=np.int64)
    for j in range(total.shape[1]):
        total[:, j] = np.bincount(at, weights=np.concatenate([v[:, j] for v in values]), minlength=len(distinct)).astype(np.int64)
    return total, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def _word_counts(p, chunks, parts):
    total, at = _merge([k for k, _ in parts], [n.astype(np.int64)[:, None] for _, n in parts])
    for c, i in zip(chunks, at):
        yield c, squeeze(small(total[i, 0]))
    yield -1, squeeze(np.array([total.sum(), (total > 0).sum()], dtype=np.int64))


# ---- restaurants


@lru_cache(8)
def log_stirling(discount: float, size: int = STIRLING) -> np.ndarray:
    """Logs of generalised Stirling numbers: seatings of c customers at t tables, by c and t."""
    s = np.full((size + 1, size + 2), -np.inf)
    s[0, 0] = 0
    for c in range(size):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(np.maximum(c - discount * t, 0)))
    return s


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers."""
    low = np.zeros_like(x)
    few = x < 8
    if few.any():
        low[few] = np.log(x[few][:, None] + np.arange(8)).sum(1)
    z = np.where(few, x + 8, x)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def log_stirling_at(discount: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Logs of generalised Stirling numbers of many (c, t), 1 <= t <= c; exact for c up to ``STIRLING``, t = 1 and t = c.

    Else by the saddle point: the number is c! / (t! d^t) times the coefficient
    of x^c in f(x)^t, f(x) = 1 - (1 - x)^d.  x = 1 - exp(-y) solves x f'(x) / f(x) = c / t;
    Newton's steps from the right never pass y.
    """
    d, c, t = discount, c.astype(np.float64), t.astype(np.float64)
    out = np.where(t == c, 0.0, lgamma(c - d) - lgamma(np.array([1 - d])))
    known = c <= STIRLING
    out[known] = log_stirling(discount)[c[known].astype(np.int64), t[known].astype(np.int64)]
    i = np.flatnonzero((t > 1) & (t < c) & ~known)
    c, t = c[i], t[i]
    goal = np.log(c / t)
    y = 2 * goal / (1 - d)
    for _ in range(12):
        log_h = np.log(d) + np.log(-np.expm1(-y)) + (1 - d) * y - np.log(-np.expm1(-d * y))
        slope = 1 / np.expm1(y) + (1 - d) - d / np.expm1(d * y)
        y = np.maximum(y - (log_h - goal) / slope, goal / (1 - d))
    spread = c * (1 / np.expm1(y) + (1 - d) - d / np.expm1(d * y)) * np.expm1(y)
    out[i] = lgamma(c + 1) - lgamma(t + 1) - t * np.log(d) + t * np.log(-np.expm1(-d * y)) - c * np.log(-np.expm1(-y)) - 0.5 * np.log(2 * np.pi * spread)
    return out


def _log_tables(discount: float, strength: float, c, t, rest, log_base) -> np.ndarray:
    """Log of the conditional of t tables of a dish with c customers, up to a constant; rest: the restaurant's other tables."""
    a = strength / discount + rest
    return log_stirling_at(discount, c, t) + t * (log_base + np.log(discount)) + lgamma(a + t) - lgamma(a)


def seated_in_turn(c, rest, base, discount: float, strength: float, rng: np.random.RandomState) -> np.ndarray:
    """Where a chain of a large dish starts: customers seated one after another, in growing blocks."""
    t, seated, alive = np.ones(len(c)), np.ones(len(c)), np.arange(len(c))
    while len(alive):
        block = np.minimum(np.maximum(1, seated[alive] // 32), c[alive] - seated[alive])
        fresh = (strength + discount * (rest[alive] + t[alive])) * base[alive]
        p = fresh / (fresh + seated[alive] - discount * t[alive])
        t[alive] += rng.binomial(block.astype(np.int64), np.clip(p, 0, 1))
        seated[alive] += block
        alive = alive[seated[alive] < c[alive]]
    return np.minimum(t, c).astype(np.int64)


def sweep(customers: np.ndarray, tables: np.ndarray, restaurant: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.RandomState, first: bool = False) -> np.ndarray:
    """New tables of each dish, drawn from their conditionals in blocks of dishes.

    others: tables of each restaurant that are not among these dishes' (other
    ranges); base: the parent's probability of each dish; first: there is no
    earlier sweep.
    """
    new = np.where(first, np.minimum(customers, 1), np.clip(tables, np.minimum(customers, 1), customers))
    stirling, open_ = log_stirling(discount), np.flatnonzero(customers > 1)
    for part in np.array_split(rng.permutation(open_), BLOCKS):
        total = np.bincount(restaurant, weights=new, minlength=len(others)) + others
        few = part[customers[part] <= DIRECT]
        few = few[np.argsort(customers[few], kind="stable")]
        for c, s, e in exchange.ranges(customers[few]):
            for dishes in np.array_split(few[s:e], max(1, (e - s) * c // 1_000_000)):
                rest = total[restaurant[dishes]] - new[dishes]
                t = np.arange(1, c + 1)
                grow = np.log(strength + discount * (rest[:, None] + t[None, :] - 1))
                log_p = stirling[c, 1 : c + 1] + t * np.log(base[dishes])[:, None] + np.cumsum(grow, axis=1)
                new[dishes] = 1 + np.argmax(log_p + rng.gumbel(size=log_p.shape), axis=1)
        for many in np.array_split(part[customers[part] > DIRECT], max(1, len(part) // 200_000)):
            if not len(many):
                continue
            c, rest, log_base = customers[many], total[restaurant[many]] - new[many], np.log(base[many])
            t = seated_in_turn(c, rest, base[many], discount, strength, rng) if first else new[many]
            width = 1 + (np.sqrt(c) / 2).astype(np.int64)
            log_p = _log_tables(discount, strength, c, t, rest, log_base)
            for _ in range(STEPS):
                to = t + rng.randint(-width, width + 1)
                ok = (to >= 1) & (to <= c)
                there = _log_tables(discount, strength, c, np.where(ok, to, t), rest, log_base)
                ok &= np.log(rng.uniform(size=len(t))) < there - log_p
                t, log_p = np.where(ok, to, t), np.where(ok, there, log_p)
            new[many] = t
    return new


def predictive(customers, tables, all_customers, all_tables, base, discount: float, strength: float):
    """Probability of a dish in a restaurant, given the parent's."""
    return (customers - discount * tables + (strength + discount * all_tables) * base) / (strength + all_customers)


# ---- pairs

#: Rows between sweeps.  kind: 0 a range's state, 1 its tables of words for a range of words, 2 a range of words' state, 3 its answer, 4 where a chunk's pairs are in a range.
MOVE = "kind int, to int, frm long, blob binary, n_customers long, n_tables long"
STATE, TABLES, PARENT_STATE, ANSWER, PLACES = range(5)


def _moved(data: list[tuple]) -> pa.Table:
    kinds = {"kind": pa.int32(), "to": pa.int32(), "frm": pa.int64(), "blob": pa.binary(), "n_customers": pa.int64(), "n_tables": pa.int64()}
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*data)) or [[]] * 6, kinds.values())], names=list(kinds))


def _ask_pairs(bits: int):
    def run(batches):
        for b in batches:
            for chunk, c, counts in _each(b):
                seen = _joined(counts, 0)
                u, w, at, _, n = c.pairs(seen, bits, HOT)
                rows = []
                for p, s, e in exchange.ranges(at):
                    first = np.flatnonzero(np.r_[True, u[s + 1 : e] != u[s : e - 1]])
                    contexts = c.words[u[s:e][first]]
                    rows.append((p, chunk, squeeze(contexts, small(np.diff(np.r_[first, e - s])), small(1 + seen[u[s:e][first]] // HOT), *_five(ids_of(c.words[w[s:e]])), small(n[s:e]))))
                yield exchange.rows(rows)

    return run


def _five(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40 bits as 32 and 8."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint8)


def _gathered(parts):
    """Contexts, parts that each is dealt to, pairs' contexts (places), word ids and counts, and the place of each asked pair."""
    contexts, at_context = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    deal = np.zeros(len(contexts), dtype=np.int64)
    deal[at_context] = np.concatenate([x[2] for x in parts])
    of = np.repeat(at_context, np.concatenate([x[1].astype(np.int64) for x in parts]))
    ids = np.concatenate([x[3].astype(np.uint64) | (x[4].astype(np.uint64) << np.uint64(32)) for x in parts])
    order = np.lexsort((ids, of))
    fresh = np.r_[True, (of[order][1:] != of[order][:-1]) | (ids[order][1:] != ids[order][:-1])][: len(of)]
    place = np.empty_like(order)
    place[order] = np.cumsum(fresh) - 1
    customers = np.bincount(place, weights=np.concatenate([x[5] for x in parts]), minlength=int(fresh.sum())).astype(np.int64)
    return contexts, deal, of[order][fresh], ids[order][fresh], customers, place


def _by_range(ids: np.ndarray, bits: int, of: int = WORD_BITS) -> np.ndarray:
    return (ids >> np.uint64(of - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)


class Range:
    """The state of a range of contexts."""

    def __init__(self, data: bytes):
        self.hot, sizes, word, self.words, customers, tables, self.sum = expand(data)
        self.restaurant = np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
        self.word, self.customers, self.tables = word.astype(np.int64), customers.astype(np.int64), tables.astype(np.int64)
        self.n, self.sizes = len(sizes), sizes

    @classmethod
    def of(cls, contexts, deal, restaurant, ids, customers) -> Range:
        self = cls.__new__(cls)
        self.words, self.word = np.unique(ids, return_inverse=True)
        self.hot = np.stack([np.flatnonzero(deal > 1).astype(np.uint64), contexts[deal > 1]]).ravel()  # places and hashes of dealt contexts
        self.n, self.sizes, self.restaurant = len(contexts), np.bincount(restaurant, minlength=len(contexts)), restaurant
        self.customers, self.tables, self.sum = customers, np.minimum(customers, 1), np.empty(0, np.float32)
        return self

    def rows(self, p: int, bits: int) -> list[tuple]:
        """The state, and for each range of words and dealt contexts its tables (and the dealt contexts' customers) here."""
        state = squeeze(self.hot, small(self.sizes), self.word.astype(np.uint32), self.words, small(self.customers), small(self.tables), self.sum)
        out = [(STATE, p, p, state, 0, 0)]
        t = np.bincount(self.word, weights=self.tables, minlength=len(self.words)).astype(np.int64)
        where, hashes, totals = self.dealt()
        at, hot_at = _by_range(self.words, bits), _by_range(hashes, bits, 64)
        for q in np.union1d(at, hot_at).tolist():
            i, h = at == q, hot_at == q
            out.append((TABLES, q, p, squeeze(self.words[i], small(t[i]), hashes[h], *[small(x[h]) for x in totals]), 0, 0))
        return out

    def dealt(self):
        """Places, hashes, and customers and tables here, of contexts that are dealt over ranges."""
        where, hashes = self.hot.reshape(2, -1)
        where = where.astype(np.int64)
        return where, hashes, [np.bincount(self.restaurant, weights=x, minlength=self.n)[where].astype(np.int64) for x in (self.customers, self.tables)]

    def learn(self, answers: list, n_words: int, sums: tuple[int, int]) -> None:
        """The parent's probabilities of the words here, and what dealt contexts have in other ranges."""
        customers, tables = (np.concatenate([a[k].astype(np.int64) for a in answers]) for k in range(2))
        self.base = predictive(customers, tables, sums[0], sums[1], 1 / (n_words + 1), *PARENT)[self.word]
        self.others = np.zeros((2, self.n))
        where, hashes, here = self.dealt()
        order = np.argsort(hashes, kind="stable")  # answers are in order of ranges, and so of hashes
        for k in range(2):
            self.others[k, where[order]] = np.concatenate([a[2 + k].astype(np.int64) for a in answers]) - here[k][order]

    def keep(self) -> None:
        """Add this sample's probabilities."""
        customers, tables = (np.bincount(self.restaurant, weights=x, minlength=self.n) + o for x, o in zip((self.customers, self.tables), self.others))
        p = predictive(self.customers, self.tables, customers[self.restaurant], tables[self.restaurant], self.base, *CONTEXT)
        self.sum = (p + (self.sum if len(self.sum) else 0)).astype(np.float32)


def _start(bits: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        p, parts = t.column("p")[0].as_py(), [expand(x) for x in t.column("blob").to_pylist()]
        *pairs, place = _gathered(parts)
        out, at = Range.of(*pairs).rows(p, bits), 0
        for chunk, x in zip(t.column("chunk").to_pylist(), parts):  # lists are in the order of the range's pairs, so places rise
            out.append((PLACES, p, chunk, squeeze(place[at : at + len(x[3])].astype(np.uint64)), 0, 0))
            at += len(x[3])
        return _moved(out)

    return run


def _draw_parent(seed: int, k: int, n_words: int, sum_tables: int):
    """A range of words' new tables, given the customers that ranges of contexts send; answers to them in their order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("frm", "ascending")])
        q, rng = t.column("to")[0].as_py(), np.random.RandomState((seed * 2_000_003 + 7919 * k + t.column("to")[0].as_py()) % (1 << 32))
        kinds, frm, blobs = (t.column(x).to_pylist() for x in ("kind", "frm", "blob"))
        parts = [expand(b) for kind, b in zip(kinds, blobs) if kind == TABLES]
        before = [expand(b)[0].astype(np.int64) for kind, b in zip(kinds, blobs) if kind == PARENT_STATE]
        total, at = _merge([x[0] for x in parts], [x[1].astype(np.int64)[:, None] for x in parts])
        hot, hot_at = _merge([x[2] for x in parts], [np.stack(x[3:5], 1).astype(np.int64) for x in parts])
        customers = total[:, 0]
        tables = before[0] if before else np.minimum(customers, 1)
        others = np.array([float(max(0, sum_tables - tables.sum()))])
        tables = sweep(customers, tables, np.zeros(len(customers), np.int64), others, np.full(len(customers), 1 / (n_words + 1)), *PARENT, rng, first=not before)
        out = [(PARENT_STATE, q, q, squeeze(small(tables)), int(customers.sum()), int(tables.sum()))]
        for p, i, h in zip([f for kind, f in zip(kinds, frm) if kind == TABLES], at, hot_at):
            out.append((ANSWER, p, q, squeeze(small(customers[i]), small(tables[i]), small(hot[h, 0]), small(hot[h, 1])), 0, 0))
        return _moved(out)

    return run


def _draw_pairs(seed: int, k: int, bits: int, n_words: int, sums: tuple[int, int], keep: bool, last: bool):
    """Keeps the sample that a range's state and the answers make, then draws new tables."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("frm", "ascending")])
        p, rng = t.column("to")[0].as_py(), np.random.RandomState((seed * 1_000_003 + 7919 * k + t.column("to")[0].as_py()) % (1 << 32))
        state, *answers = t.column("blob").to_pylist()
        r = Range(state)
        r.learn([expand(x) for x in answers], n_words, sums)
        if keep:
            r.keep()
        if last:
            return _moved([(STATE, p, p, squeeze(r.sum), 0, 0)])
        r.tables = sweep(r.customers, r.tables, r.restaurant, r.others[1], r.base, *CONTEXT, rng, first=not k)
        return _moved(r.rows(p, bits))

    return run


def _answer_pairs(samples: int):
    """Logs of averaged probabilities of each chunk's pairs."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("frm", "ascending")])
        p, chunks = t.column("to")[0].as_py(), t.column("frm").to_pylist()
        state, *places = (expand(b)[0] for b in t.column("blob").to_pylist())
        log_p = np.log10(state.astype(np.float64) / samples).astype(np.float32)
        return pa.Table.from_batches([exchange.rows([(p, c, squeeze(log_p[i.astype(np.int64)])) for c, i in zip(chunks[1:], places)])])

    return run


def sampled(asked: DataFrame, bits: int, n_words: int, seed: int, steps: Steps) -> DataFrame:
    """``p, chunk, blob``: for each list of pairs in ``asked`` the logs of their probabilities, averaged over the samples."""
    pairs = started = steps.write(asked.groupBy("p").applyInArrow(_start(bits), MOVE), "pairs")
    parent, sum_tables = None, 0
    for k in range(BURN_IN + SAMPLES):
        last = k == BURN_IN + SAMPLES - 1
        sent = pairs.where(F.col("kind") == TABLES)
        sent = sent.unionByName(parent.where(F.col("kind") == PARENT_STATE)) if parent else sent
        before, parent = parent, steps.write(sent.groupBy("to").applyInArrow(_draw_parent(seed, k, n_words, sum_tables), MOVE), "parent")
        if before:
            steps.drop(before)
        sums = tuple(parent.agg(F.coalesce(F.sum("n_customers"), F.lit(0)), F.coalesce(F.sum("n_tables"), F.lit(0))).first())
        sum_tables = sums[1]
        own = pairs.where(F.col("kind") == STATE).unionByName(parent.where(F.col("kind") == ANSWER))
        drawn = own.groupBy("to").applyInArrow(_draw_pairs(seed, k, bits, n_words, sums, k >= BURN_IN, last), MOVE)
        before, pairs = pairs, steps.write(drawn, "pairs")
        if before is not started:
            steps.drop(before)
    logs = pairs.unionByName(started.where(F.col("kind") == PLACES)).groupBy("to").applyInArrow(_answer_pairs(SAMPLES), exchange.ASK)
    logs = steps.write(logs, "logs")
    steps.drop(parent, pairs, started)
    return logs


# ---- scores


def _scores(bits: int, n_tokens: int, n_words: int):
    def run(batches):
        for b in batches:
            for _, c, counts, logs in _each(b):
                seen = _joined(counts, 0)
                *_, of, _ = c.pairs(seen, bits, HOT)
                log_p = np.concatenate([x[0] for x in logs]).astype(np.float64)
                starts = np.cumsum(c.lens) - c.lens
                model = np.add.reduceat(log_p[of], starts)
                base = np.add.reduceat(np.log10((seen + 1) / (n_tokens + n_words + 1))[c.stream], starts)
                known = np.add.reduceat((seen > 0)[c.stream].astype(np.int64), starts)
                columns = [pa.array(c.ids, mask=c.null), pa.array(c.held), pa.array(c.lens), pa.array(known), pa.array(np.full(len(known), n_tokens)), pa.array(base), pa.array(model), pa.array(10 ** (-model / c.lens))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (2, 7), seed: int = 7) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``; held out: crc32 of the id as text has that remainder."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    ranges = max(1, text_bytes(docs) // RANGE_BYTES)
    bits = max(2, int(ranges).bit_length())
    with Steps(df, exchange.ONE_A_BATCH) as steps:
        chunks = steps.write(docs.mapInArrow(_encode(*held_out), "chunk long, data binary"), "chunks")
        words = steps.write(exchange.reduce(chunks.mapInArrow(_ask_words(bits), exchange.ASK), _word_counts), "words")
        totals = exchange.totals(words)
        n_tokens, n_words = (int(totals[0]), int(totals[1])) if len(totals) > 1 else (0, 0)
        logs = sampled(exchange.answered(chunks, words).mapInArrow(_ask_pairs(bits), exchange.ASK), bits, n_words, seed, steps)
        return steps.keep(exchange.answered(chunks, words, logs).mapInArrow(_scores(bits, n_tokens, n_words), schema), "scores").withColumnRenamed("id", id_col)
