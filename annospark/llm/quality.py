"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's potentials are sums of weights of its
own binned features and of its neighbours' (the line before and the line
after); transition weights join successive lines.  Training maximises the
likelihood of lines that take their document's label.  A document's mean
marginal of "good", weighted by line lengths, passes a logistic curve fitted
on the training documents and is its score.

Training takes at most ``per_class`` labelled documents of each class, and no
more than ``class_bytes`` of their text (but one document at least): those with
the smallest hash of (id, text), and weighs them by the class's share of all
labelled rows; the score thus estimates the probability of label 1.  The sample
is chosen by ids and hashes alone; then a broadcast of the chosen hashes
fetches its texts, so no other text is shuffled.

Rows: a null or empty text is one empty line and is scored like any other;
null and repeated ids are kept, one row out for each row in; label rows with a
null label or without a document are not learned from, rows of one id, text and
label once; with no labelled row
every score is 0.5; with one class, its share; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annospark.llm.common import Steps, slices

#: Documents of a class that training takes at most.
PER_CLASS = 1500
#: Bytes of text that training takes of a class at most.
CLASS_BYTES = 16 << 20
BINS = 6
_SYMBOL = re.compile(r"[^\w\s]")
FEATURES = 12


def line_features(line: str) -> tuple[float, ...]:
    """Fixed features of a line; shares are of its characters or words."""
    n = len(line)
    words = line.split()
    m = len(words)
    if not m:
        return (0.0,) * FEATURES
    symbols = len(_SYMBOL.findall(line))
    letters = len(line.replace(" ", "")) - symbols
    upper = sum(map(str.isupper, words))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    inner = sum(1 for w in words if not w[-1].isalnum())
    return (
        float(np.log1p(n)), m / n, len(set(words)) / m, runs / m, symbols / n, upper / m, inner / m,
        sum(w.isalnum() for w in words) / m, sum(map(str.isdigit, line)) / n, letters / m,
        float(line[-1:] in ".?!"), len(set(line)) / n,
    )


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and lines a text."""
    f, size, n = [], [], []
    for t in texts:
        lines = t.split("\n")
        n.append(len(lines))
        for x in lines:
            f.append(line_features(x))
            size.append(len(x))
    return np.array(f, dtype=np.float32).reshape(-1, FEATURES), np.array(size, dtype=np.float64), np.array(n, dtype=np.int64)


class Field:
    """Weights by feature and bin for a line and its two neighbours, and transitions."""

    def __init__(self, cuts: np.ndarray):
        self.cuts = cuts  # feature x (BINS - 1)
        self.w = np.zeros((3, FEATURES, BINS + 1, 2))  # own, before, after; the last bin: no such line
        self.t = np.zeros((2, 2))
        self.curve = np.array([1.0, 0.0])

    def bins(self, f: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[j], f[:, j], side="left") for j in range(FEATURES)], 1)

    def neighbours(self, bins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, after = np.roll(bins, 1, 0), np.roll(bins, -1, 0)
        ends = np.cumsum(n)
        before[ends - n] = BINS
        after[ends - 1] = BINS
        return bins, before, after

    def potentials(self, three) -> np.ndarray:
        out = np.zeros((len(three[0]), 2))
        for k in range(3):
            for j in range(FEATURES):
                out += self.w[k, j][three[k][:, j]]
        return out

    def marginals(self, u: np.ndarray, n: np.ndarray, pairs: bool = False):
        """P(state) of each line; with pairs, also the expected transitions and the log of the partition sums."""
        starts = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        s, sizes = starts[order], n[order]
        steps = int(sizes[0]) if len(sizes) else 0
        alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # documents with more than t lines
        e = np.exp(self.t)
        a, b, scale = np.zeros_like(u), np.ones_like(u), np.zeros(len(u))
        top = u.max(1)
        p = np.exp(u - top[:, None])
        for t in range(steps):
            i = s[: alive[t]] + t
            x = p[i] * (a[i - 1] @ e if t else 1.0)
            z = x.sum(1)
            a[i], scale[i] = x / z[:, None], z
        for t in range(steps - 2, -1, -1):
            i = s[: alive[t + 1]] + t
            x = (b[i + 1] * p[i + 1]) @ e.T
            b[i] = x / scale[i + 1][:, None]
        m = a * b
        m /= m.sum(1)[:, None]
        if not pairs:
            return m
        first = np.zeros(len(u), dtype=bool)
        first[starts] = True
        i = np.flatnonzero(~first)
        joint = a[i - 1][:, :, None] * e[None] * (p[i] * b[i])[:, None, :] / scale[i][:, None, None]
        return m, joint, np.log(scale) + top, i

    def fit(self, three, n: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, rate: float = 0.15, penalty: float = 1e-3) -> None:
        """Adam steps on the weighted conditional likelihood; y and weight are by line."""
        target = np.eye(2)[y]
        total = weight.sum()
        state = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.t)]
        for r in range(1, rounds + 1):
            u = self.potentials(three)
            m, joint, _, i = self.marginals(u, n, pairs=True)
            d = (target - m) * (weight / total)[:, None]
            g = np.zeros_like(self.w)
            for k in range(3):
                for j in range(FEATURES):
                    for c in range(2):
                        g[k, j, :, c] = np.bincount(three[k][:, j], weights=d[:, c], minlength=BINS + 1)
            seen = target[i - 1][:, :, None] * target[i][:, None, :]
            gt = ((seen - joint) * (weight[i] / total)[:, None, None]).sum(0)
            for x, grad, v, q in ((self.w, g - penalty * self.w, 0, 1), (self.t, gt - penalty * self.t, 2, 3)):
                state[v] = 0.9 * state[v] + 0.1 * grad
                state[q] = 0.99 * state[q] + 0.01 * grad**2
                x += rate * (state[v] / (1 - 0.9**r)) / (np.sqrt(state[q] / (1 - 0.99**r)) + 1e-8)

    def good(self, texts: list[str]) -> np.ndarray:
        """Mean marginal of "good" of each text, weighted by line lengths."""
        f, size, n = features(texts)
        m = self.marginals(self.potentials(self.neighbours(self.bins(f), n)), n)[:, 1]
        starts, w = np.cumsum(n) - n, size + 1e-9
        return np.add.reduceat(m * w, starts) / np.add.reduceat(w, starts)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * logit(self.good(texts)) + self.curve[1])))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    z, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (y - p)) - 1e-3 * (w - np.array([1.0, 0.0]))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, g)
    return w


class Constant:
    def __init__(self, p: float):
        self.p = p

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.p)


def train(sample: list[tuple[str, int]], share: float) -> Field | Constant:
    """sample: texts and labels of a bounded sample; share: of label 1 among all labelled rows."""
    y = np.array([label for _, label in sample], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Constant(share if len(y) else 0.5)
    f, size, n = features([t for t, _ in sample])
    cuts = np.stack([np.quantile(f[:, j], np.arange(1, BINS) / BINS) for j in range(FEATURES)])
    field = Field(cuts)
    per_doc = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    line_weight = np.repeat(per_doc / n, n) * 0.5 + np.repeat(per_doc, n) * size / np.repeat(np.maximum(1, np.add.reduceat(size, np.cumsum(n) - n)), n) * 0.5
    field.fit(field.neighbours(field.bins(f), n), n, np.repeat(y, n), line_weight)
    field.curve = platt(logit(field.good([t for t, _ in sample])), y.astype(float), per_doc)
    return field


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Field | Constant:
    """A model from documents and the labels (0 or 1) of some ids."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = texts.select("id", "h", F.octet_length("text").alias("size")).join(known, "id").groupBy("h", "y").agg(F.max("size").alias("size"))
    with Steps(docs) as steps:
        rows = steps.write(rows, "labelled")
        counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        if not counts:
            return Constant(0.5)
        # the part below a bound holds more than per_class rows in all likelihood; the ranking is over few rows then, and over all if it does not
        share = lambda y: F.lit(min(1.0, 2.0 * per_class / counts.get(y, 1)))
        part = rows.where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.when(F.col("y") == 1, share(1)).otherwise(share(0)) * (1 << 20))
        if any(part.where(F.col("y") == y).count() < min(per_class, n) for y, n in counts.items()):
            part = rows
        order = W.partitionBy("y").orderBy(F.pmod(F.col("h"), F.lit(1 << 20)), "h")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_class)
        chosen, used = {}, {0: 0, 1: 0}
        for r in part.orderBy("y", "rank").collect():  # two numbers a row
            used[r.y] += r["size"]
            if r["rank"] == 1 or used[r.y] <= class_bytes:
                chosen.setdefault(r.h, []).append(r.y)
        few = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
        got = texts.join(F.broadcast(few), "h").groupBy("h").agg(F.first("text").alias("text")).collect()
    sample = sorted((r.text, y) for r in got for y in chosen[r.h])
    return train(sample, counts.get(1, 0) / sum(counts.values()))


def score(df: DataFrame, model: Field | Constant, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """``id_col``, the columns named in ``keep``, and the score, in ``out_col``."""
    m = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "_text") + ", score double"

    def run(batches):
        for b in batches:
            for first, texts in slices(b, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(first, len(texts)) for i in range(b.num_columns) if i != 1], pa.array(m.value.score(texts), pa.float64())], [*[n for n in b.schema.names if n != "_text"], "score"])

    out = src.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(out_col))
