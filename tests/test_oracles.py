"""Every registered query with SQL against DuckDB, over the small tables."""

import math
import os

import duckdb
import pytest

from tilewright.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr) and rows


def test_all_have_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_containers_of_customers_with_any_keys(spark, sf_dir, tmp_path):
    c = duckdb.connect()
    for name in ("region", "nation"):
        os.symlink(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    keys = "SELECT i + CASE i % 4 WHEN 0 THEN 0 WHEN 1 THEN 499990 WHEN 2 THEN 13000000 ELSE 1000000000000 END AS k, i FROM range(-20, 6000) r(i)"
    c.sql(f"CREATE TABLE customer AS SELECT CAST(k AS BIGINT) AS c_custkey, CAST(i * i % 26 AS INTEGER) AS c_nationkey FROM ({keys})")
    c.sql(f"CREATE TABLE orders AS SELECT CAST(k AS BIGINT) AS o_custkey, CASE WHEN i % 3 > 0 THEN 'P' ELSE 'F' END AS o_orderstatus FROM ({keys})")
    for name in ("customer", "orders"):
        c.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    for name in ("textured_containers", "innermost_containers"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())


def test_tables_in_files_and_folders(spark, tmp_path):
    want = duckdb.sql(ORACLES["table_files"]).fetchall()
    root = tmp_path / "outer.parquet" / "data 1"
    parts = ["", "/part-0000.parquet", "/part-0000.parquet", "/k=1/part-0.c000.snappy.parquet", "/0001"]
    for nth, (name,) in enumerate(want):
        for part in {parts[nth % 5], parts[nth % 5].replace("0000", "0001")}:
            path = root / f"{name}.parquet{part}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x")
    for other in ("notes.txt", "events.parquet.md5", "old/events2.parquet"):
        (root / other).parent.mkdir(exist_ok=True)
        (root / other).write_bytes(b"x")
    for said in (str(root), f"{root}/", f"file://{root}", os.path.relpath(root)):
        assert sorted(map(tuple, QUERIES["table_files"](spark, said).collect())) == sorted(want), said
