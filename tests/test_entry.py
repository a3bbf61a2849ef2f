import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_names_and_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["document_metrics", "p5_found", "box_overlap_pairs", "text_reconcile", "to_markdown", "continued_tables"])
def test_against_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    at = [sql.columns.index(c) for c in order]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in sql.fetchall())
