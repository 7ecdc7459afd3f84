"""The driver's entry points."""

import __spark_entry__


def test_entry_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["region_id", "chrom", "start", "end", "strand", "count"] and out.count() > 0


def test_sql_has_queries():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values())) and all(isinstance(v, str) for v in sql.values())
