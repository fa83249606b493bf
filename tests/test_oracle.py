"""Every registered query with SQL against DuckDB, on the smallest given tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for column in pdf:
        if str(pdf[column].dtype).startswith("datetime"):
            pdf[column] = pdf[column].astype("datetime64[us]").astype(str)
    pdf = pdf.astype(object).where(pdf.notna(), None)

    def plain(value):
        if isinstance(value, (bool, np.bool_)):
            return repr(bool(value))
        return repr(float(value)) if isinstance(value, (float, int, np.number)) else repr(value)

    return sorted(tuple(map(plain, row)) for row in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(SF_DIR)).toPandas()
    expected = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["farm_id", "state_name", "n_rows", "positive_rate", "mean_rpm_volatility"]
    assert result.count() > 0
