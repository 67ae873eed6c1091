import duckdb
import pytest
from chronoline.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(registry.ORACLES[name]).to_arrow_table().select(columns).to_pylist()
    key = lambda row: repr([row[c] for c in columns])
    assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, want))
