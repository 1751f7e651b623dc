import re

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score", "preview"] and 0 < df.count() <= 20


def test_every_query_of_the_engine_has_its_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 45
    assert all(re.match(r"op\d+_|pipeline$", q) for q in set(queries) - set(sql))
