import re

import __spark_entry__ as entry


def test_registry_is_complete(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    # random or iterative results have no SQL form
    own = {n for n in queries if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(sql) == {"isolation_forest", "kmeans", "auto_k", "elbow", "pca", "top_loadings"}


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 <= row.overall_score <= 100 and row.grade
