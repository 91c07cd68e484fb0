"""Language identification of more languages than one flat decision takes."""

from collections import Counter

import numpy as np
from annospark.llm import langid, queries


def many(n, each, seed=1):
    """(id, text, lang) of n invented languages, each of words of its own."""
    r = np.random.RandomState(seed)
    vocab = [["".join(chr(97 + c) for c in r.randint(0, 26, 5)) for _ in range(30)] for _ in range(n)]
    return [(k * each + i, " ".join(vocab[k][w] for w in r.randint(0, 30, 25)), f"q{k:03d}") for k in range(n) for i in range(each)]


def test_every_language_is_found(spark, tmp_path):
    n = langid.FLAT + 6
    rows = many(n, 9)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op3_language_id"](spark, str(tmp_path)).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows) and {r.lang_pred for r in got} == set(want.values())
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_sample_is_bounded_by_rows_not_languages(spark):
    copies = [(None, "the same words", "copies")] * 400
    df = spark.createDataFrame(many(80, 40) + copies + [(9999, "only one", "rare")], "doc_id long, text string, lang string")
    x, langs = langid.training_set(df, "doc_id", "text", "lang", 500, 80 * 20)
    n = Counter(langs)
    assert len(x) == len(langs) and len(n) == 82 and n["rare"] == 1
    assert max(n.values()) == 80 * 20 // 82
