"""Every query of the subpackage that has SQL gives what DuckDB gives for it, on the smallest tables."""

import duckdb
import pytest

from ragloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    cursor = connection.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert plain(found.select(*names).collect()) == plain(cursor.fetchall())
