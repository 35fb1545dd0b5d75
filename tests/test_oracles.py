"""Every query against its DuckDB oracle on the smallest tables."""

import os

import pytest

from lanewise.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_oracle(spark, duck, name, tmp_path):
    got = catalogue.queries()[name](spark, SF)
    got.write.parquet(str(tmp_path / "got"))
    duck.sql(f"create or replace table got as select * from '{tmp_path}/got/*.parquet'")
    assert duck.sql("from got").columns == got.columns
    if name not in catalogue.oracles():
        return
    duck.sql(f"create or replace table want as {catalogue.oracles()[name]}")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(duck.sql("from want").columns) == sorted(got.columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.sql(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []
