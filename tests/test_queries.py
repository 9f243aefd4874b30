"""Every engine query that has SQL, against DuckDB over the smallest tables."""

import duckdb
import pytest

from triplane.queries import ORACLE_SQL, QUERIES, SPARQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    asked = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in asked.description]
    assert sorted(df.columns) == sorted(columns)
    got, wanted = df.collect(), asked.fetchall()
    assert canonical(got, df.columns) == canonical(wanted, columns)
    if name in ORDERED:
        assert [tuple(r[c] for c in columns) for r in got] == wanted


#: Queries whose order is total.
ORDERED = "flagship order_asc_desc order_expr order_unbound store_optional_order topk topk_offset limit_offset".split()


def test_few_queries_are_empty(spark):
    """Most queries that have a result over no rows would show nothing."""
    empty = {name for name in SPARQL if QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()}
    assert empty == {"false_pattern", "filter_type_error", "regex_flags_error", "limit_zero"}
