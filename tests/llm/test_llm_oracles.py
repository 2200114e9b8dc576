"""Every query of the subpackage that has SQL against DuckDB, over the small tables."""

import pytest

from tilewright.llm.catalog import ORACLES, QUERIES

from tests.test_oracles import con, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):  # noqa: F811
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr) and rows
