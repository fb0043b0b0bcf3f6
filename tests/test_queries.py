"""Every query that has SQL gives what DuckDB gives for it, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry_module._own.SQL))
def test_against_sql(spark, duck, name):
    found, expected = entry_module._own.QUERIES[name](spark, SF).toPandas(), duck.execute(entry_module._own.SQL[name]).df()
    pd.testing.assert_frame_equal(plain(found), plain(expected), check_dtype=False)


@pytest.mark.parametrize("name", sorted(k for k in entry_module._own.QUERIES if k not in entry_module._own.SQL))
def test_without_sql(spark, name):
    assert entry_module._own.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_library_does_not_need_the_training_data_operators():
    import pathlib

    root = pathlib.Path(entry_module.__file__).parent
    for path in (root / "ragloom").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "ragloom.llm" not in path.read_text(), path
