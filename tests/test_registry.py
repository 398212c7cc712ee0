import importlib
import subprocess
import sys

import pytest


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_the_rest_does_not_need_the_llm_folder():
    code = "import sys; sys.modules['sagaledger.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("pathlib").Path(__file__).parent.parent)


def names():
    from sagaledger.plans import registry

    return sorted(registry.oracles())


@pytest.mark.parametrize("name", names())
def test_query_equals_its_oracle(spark, name):
    import os

    import duckdb
    import pandas as pd

    from sagaledger.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return str(v) if isinstance(v, (str, bool)) else (round(float(v), 6) if isinstance(v, (int, float)) else str(v))

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)

    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(con.execute(registry.oracles()[name]).df())
