"""Language identification by hierarchical discrimination.

A text's language family is decided first, by one-versus-one linear support
vector machines between families; then one-versus-one machines between the
languages of that family decide.  Features are relative frequencies of hashed
byte trigrams of the lower-cased whole text, scaled by what training texts
have.  Families of known language codes are a fixed table; a language outside
it is a family of its own.  More than ``FLAT`` names to decide between are put
into groups of like mean features, and a group is decided first, so that n
names take about n ** 1.5 machines instead of n ** 2 / 2.

Every language is learned.  Training takes at most ``per_language`` texts of
each, and fewer of each (``LEAST`` at least) when all together would be over
``TOTAL``: those with the smallest hash of (id, text), so it is the same for
every layout of the input.  Model and training grow with the number of
languages, not with the rows.

Rows: a null text, or one without a letter, is ``und`` with score 0; null and
repeated ids are kept, one row out for each row in; rows with a null language
are not learned from; with nothing to learn from every text is ``und``; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annospark.llm.common import slices

DIM = 1 << 13
#: Texts of a language that training takes at most.
PER_LANGUAGE = 500
#: Texts that training takes of all languages, as long as each has LEAST.
TOTAL, LEAST = 32_000, 16
#: Names that one-versus-one machines decide between without groups.
FLAT = 64
#: Families of common ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he am mt",
    "indo-aryan": "hi bn ur pa mr gu ne",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"own:{lang}")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after another, and where each text's begin."""
    parts = [f"  {' '.join(t.lower().split())} ".encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    b = np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13), np.concatenate(([0], ends[:-1]))


def frequencies(texts: list[str]) -> np.ndarray:
    h, starts = trigrams(texts)
    ends = np.append(starts[1:], len(h))
    return np.stack([np.bincount(h[s:e], minlength=DIM) / max(1, e - s) for s, e in zip(starts, ends)]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine by accelerated gradient steps on the squared hinge loss; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    step = 0.5 / (2 * float((weight * ((x * x).sum(1) + 1)).sum()) + penalty)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        gradient = np.append(-2 * (slack @ x), -2 * slack.sum()) + penalty * v
        new = v - step * gradient
        v = new + (i / (i + 3)) * (new - w)
        w = new
    return w


def grouped(names: list, means: np.ndarray, parts: int) -> list[list]:
    """The names in so many (a power of two) groups of like size, halved along the direction in which their means differ most."""
    if parts == 1:
        return [names]
    centred = means - means.mean(0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    halves = [sorted(half.tolist()) for half in np.array_split(order, 2)]
    return [g for half in halves for g in grouped([names[i] for i in half], means[half], parts // 2)]


class Node:
    """A decision between children, each a language or a Node; pairs are children's places, of which weights and bias have a row each."""

    def __init__(self, children: list):
        self.children = children
        self.langs = [a for c in children for a in langs_of(c)]
        self.pairs = list(combinations(range(len(children)), 2))

    def fit(self, x: np.ndarray, of: np.ndarray, scale: np.ndarray) -> None:
        child = {a: i for i, c in enumerate(self.children) for a in langs_of(c)}
        at = np.array([child.get(a, -1) for a in of])
        w = np.zeros((len(self.pairs), DIM + 1), dtype=np.float32)
        for k, (a, b) in enumerate(self.pairs):
            rows = (at == a) | (at == b)
            w[k] = svm(x[rows], np.where(at[rows] == a, 1, -1).astype(np.float32))
        self.weights, self.bias = np.ascontiguousarray(w[:, :-1] * scale), w[:, -1].copy()
        for c in self.children:
            if isinstance(c, Node):
                c.fit(x, of, scale)

    def decide(self, margins: np.ndarray) -> tuple[int, float]:
        """The child with most one-versus-one wins (ties: larger sum of margins) and the mean logistic of its margins."""
        own = [[] for _ in self.children]
        for (a, b), m in zip(self.pairs, margins.tolist()):
            own[a].append(m)
            own[b].append(-m)
        best = max(range(len(own)), key=lambda i: (sum(m > 0 for m in own[i]), sum(own[i])))
        return best, float(np.mean([1 / (1 + np.exp(-4 * m)) for m in own[best]]))

    def walk(self, h: np.ndarray, n: np.ndarray, texts: np.ndarray, out: list) -> None:
        """Multiplies the score of each text (its place in out; h are the trigrams of all, n how many each has) and sets its language."""
        starts = np.cumsum(n) - n
        margins = np.stack([np.add.reduceat(w[h], starts) for w in self.weights], 1) / n[:, None] + self.bias
        picked = np.empty(len(texts), dtype=np.int64)
        for i, (t, row) in enumerate(zip(texts.tolist(), margins)):
            picked[i], p = self.decide(row)
            out[t] = (self.children[picked[i]], out[t][1] * p)
        for k, c in enumerate(self.children):
            mine = picked == k
            if isinstance(c, Node) and mine.any():
                c.walk(h[np.repeat(mine, n)], n[mine], texts[mine], out)


def langs_of(child) -> list[str]:
    return child.langs if isinstance(child, Node) else [child]


def tree(children: list, means: dict[str, np.ndarray]):
    """One child as it is, up to FLAT as a Node, more as a Node of groups."""
    if len(children) == 1:
        return children[0]
    if len(children) > FLAT:
        parts = min(FLAT, 1 << (int(np.sqrt(len(children))).bit_length() - 1))
        rows = np.stack([np.mean([means[a] for a in langs_of(c)], axis=0) for c in children])
        children = [tree(g, means) for g in grouped(children, rows, parts)]
    return Node(children)


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        of = np.array(langs)
        scale = 1 / np.sqrt((x.mean(0) if len(x) else np.zeros(DIM)) + 1e-5)
        x = x * scale
        means = {a: x[of == a].mean(0) for a in self.langs} if len(self.langs) > FLAT else {}
        families: dict[str, list[str]] = {}
        for a in self.langs:
            families.setdefault(family(a), []).append(a)
        self.root = tree([tree(families[f], means) for f in sorted(families)], means) if families else None
        if isinstance(self.root, Node):
            self.root.fit(x, of, scale)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        h, starts = trigrams(texts)
        n = np.diff(np.append(starts, len(h)))
        out: list = [(self.root, 1.0)] * len(texts)
        if isinstance(self.root, Node) and texts:
            self.root.walk(h, n, np.arange(len(texts)), out)
        return [(lang, min(1.0, max(0.0, p))) if self.langs and any(map(str.isalpha, t)) else ("und", 0.0) for t, (lang, p) in zip(texts, out)]


def training_set(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, total: int = TOTAL) -> tuple[np.ndarray, list[str]]:
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return np.zeros((0, DIM), dtype=np.float32), []
    per_language = min(per_language, max(LEAST, total // len(counts)))
    # a share of each language by hash comes first, so the ranking below is over few rows, however common a language is; the smallest hash is always among them
    shares = labelled.sparkSession.createDataFrame([(r.lang, float(min(1.0, 2.0 * per_language / r.n) * (1 << 20)), r.least) for r in counts], "lang string, below double, least long")
    rows = rows.join(F.broadcast(shares), "lang").where((F.pmod(F.col("h"), F.lit(1 << 20)) < F.col("below")) | (F.col("h") == F.col("least")))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= per_language)

    def features(batches):
        for b in batches:
            for first, texts in slices(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([f.astype("<f2").tobytes() for f in frequencies(texts)], pa.binary())], ["lang", "f"])

    got = rows.select("lang", "text").mapInArrow(features, "lang string, f binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.f)))
    return np.stack([np.frombuffer(r.f, dtype="<f2").astype(np.float32) for r in got]), [r.lang for r in got]


def identify(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``id_col, lang_pred, score`` of each row of ``df``, learned from ``labelled``."""
    x, langs = training_set(labelled, id_col, text_col, lang_col, per_language)
    model = df.sparkSession.sparkContext.broadcast(Model(x, langs))

    def run(batches):
        for b in batches:
            for first, texts in slices(b, 1):
                got = model.value.predict(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([a for a, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["id", "lang_pred", "score"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
