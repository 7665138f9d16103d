"""Every registered job against its DuckDB SQL, and that the entry point runs."""

import __spark_entry__ as entry_module
import compare
import pytest

from rillstone.jobs import all_jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(all_jobs.QUERIES))
def test_job(spark, con, name):
    df = all_jobs.QUERIES[name](spark, SF)
    if name in all_jobs.ORACLE_SQL:
        difference = compare.same(df, con, all_jobs.ORACLE_SQL[name])
        assert not difference, difference
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
