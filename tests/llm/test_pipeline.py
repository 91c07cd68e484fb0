"""Each stage of the pipeline on what the stage before it kept."""

import brute
import corpus_pipeline
import pytest
from annospark.llm import substring
from edge_rows import EDGE
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, data, steps):
    start, good, unique, cut, clean, packed = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "pack"]
    assert all(s.columns == start.columns for s in steps[1:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {i for i, _ in rows(good)}
    assert sum(i in kept for i, q in labels.items() if q == 1) > 0.93 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) < 0.5 * sum(q == 0 for q in labels.values())
    near = brute.near(rows(good), 80, 100)
    assert {i for i, _ in rows(unique)} == {i for i, (_, c, k) in near.items() if k}
    want = brute.repeats(rows(unique))
    after = {i: brute.sha(" ".join(brute.WS.findall(t))) for i, t in rows(cut)}
    assert after == {i: h for i, (n, gone, h) in want.items() if n > gone}
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {i for i, _ in rows(clean)} == {r[0] for r in brute.overlaps(rows(cut), items) if not r[-1]}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in rows(clean)}


def test_run_is_the_stages(spark, data, steps):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, data)) == key(steps[-1])


def test_cut_keeps_other_text():
    words = "a b\nc  d e".split()
    assert substring.cut(" a b\nc  d e\n", None) == " a b\nc  d e\n"
    assert substring.cut(" a b\nc  d e\n", [1], window=2) == " a d e\n" and len(words) == 5


def test_edge(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge)
        assert out.columns == docs.columns and out.count() <= len(EDGE)
        assert stage(spark, docs.limit(0), edge).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, edge).select("doc_id").distinct().count() == len({i for i, _ in EDGE})


def test_only_documents_that_lose_every_word_go(spark):
    copy = " ".join(f"w{k}" for k in range(20))
    rows = [(1, copy), (2, copy), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one"), (7, "other " + copy), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.substring_stage(spark, docs, "")
    key = lambda rows: sorted(map(repr, rows))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert key(got) == key([(i, t, len(t or "")) for i, t in rows if i not in (2, 7)] + [(7, "other ", 6)])
