"""Every registered query against its SQL in another engine."""

import compare
import pytest
from annospark.plans import file_queries  # noqa: F401
from annospark.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    assert name in SQL
    assert compare.same(df, data, SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_polyline_orphans_of_large_ids(spark, tmp_path):
    """Ids that no fixed range holds, in rows that the standard tables lack."""
    users = [1, 2, 124_999, 125_000, 125_003, 10**9, None]
    rows = [(k, u, t, float(k)) for k, (u, t) in enumerate((u, t) for u in users for t in ("view", "click", "purchase", "view"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["polyline_orphans"](spark, str(tmp_path))
    assert compare.same(df, str(tmp_path), SQL["polyline_orphans"]) == ""
    assert df.agg({"annotation_id": "max"}).first()[0] > 10**9
