import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _names():
    from folio.oracles import ORACLES

    return sorted(ORACLES)


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, name):
    import duckdb

    from folio.oracles import ORACLES
    from folio.queries import QUERIES

    con = duckdb.connect()
    for path in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr([_plain(r[i]) for i in at]) for r in cursor.fetchall())
