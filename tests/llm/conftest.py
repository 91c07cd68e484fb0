import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_rows import EDGE  # noqa: E402


@pytest.fixture(scope="session")
def docs(data):
    """(id, text) of the standard table."""
    d = pd.read_parquet(f"{data}/documents.parquet")
    return list(zip(d.doc_id.tolist(), d.text.tolist()))


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    at = str(tmp_path_factory.mktemp("edge"))
    rows = [(i, t, [None, "en", "fr"][k % 3], None if k % 2 else "s", len(t or ""), k, 0.5, "n", k) for k, (i, t) in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, score double, id string, starts int")
    df.write.parquet(f"{at}/documents.parquet")
    df.limit(0).write.parquet(f"{at}/empty/documents.parquet")
    bench = [("b1", "Beta, gamma; delta epsilon zeta eta theta iota kappa lambda MU"), ("b2", "one"), ("b3", None), (None, "two three"), ("b4", ""), ("b1", "one")]
    b = spark.createDataFrame(bench, "item_id string, text string")
    b.write.parquet(f"{at}/benchmark.parquet")
    b.limit(0).write.parquet(f"{at}/empty/benchmark.parquet")
    lab = spark.createDataFrame([(i, k % 2 if k % 3 else None, 0) for k, (i, _) in enumerate(EDGE)], "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{at}/labels.parquet")
    lab.limit(0).write.parquet(f"{at}/empty/labels.parquet")
    pages = spark.createDataFrame([(3, "http://a/b c", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (4, "u", ""), (5, "v", "a\r\n\r\nWARC/1.1\r\n"), (6, "é", "é\n\n" * 1000), (7, "w", "<p>x</p>")], "page_id long, url string, html string")
    pages.write.parquet(f"{at}/pages.parquet")
    pages.limit(0).write.parquet(f"{at}/empty/pages.parquet")
    return at
