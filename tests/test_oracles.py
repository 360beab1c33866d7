"""Every query against its DuckDB twin on the smallest tables: names, types and values."""

import duckdb
import pytest

from tidemark.operators.entity_documents import ENTITIES
from tidemark.plans import catalogue, oracles
from tidemark.sources.adapters import BASE, with_adapters

DATA = "/root/testdata/sf0.001"
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}
QUERIES, SQL = catalogue.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS[k] for c, k in df.dtypes} == {d[0]: str(d[1]) for d in result.description}
    columns = sorted(names)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs


def test_every_query_has_an_oracle_but_those_that_sql_cannot_express():
    assert set(QUERIES) - set(SQL) == {"chunk_text", "md_chunks", "pack_chunks"}
    assert set(SQL) <= set(QUERIES)


def test_linked_rows_have_each_column_once(duck):
    """DuckDB reads the first of two columns of one name, so a link must hide the raw one."""
    for entity in ENTITIES.values():
        text = oracles._linked({field: (key, column) for field, (_, key, column) in entity.links.items()})
        names = [d[0] for d in duck.execute(with_adapters(f"select * from {text}")).description]
        assert len(names) == len({n.removesuffix("_1") for n in names})
