"""Every query of the catalogue against its SQL in DuckDB."""

import pytest

from timeweave.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(name, spark, sf_dir, same_rows):
    same_rows(catalogue.queries()[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry_is_stable(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["user_id", "n_frames", "n_kept", "original_us", "condensed_us"]
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
