"""The driver's contract."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["rank", "vec_id", "leader", "selected_by", "technical_rank", "crop_safe", "final_score"]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert all(callable(q) for q in queries.values())
