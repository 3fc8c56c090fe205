"""Driver contract: entry runs, every query has a name, oracles only for registered queries."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields][:2] == ["term", "coefficient"]
    assert len(rows) == 2


def test_oracles_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
