import os

import duckdb
import pytest

import __spark_entry__ as entry
from skyloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["gross_value", "qc_stats", "regularise_asof", "interpolate_time", "haversine_pairs", "aggregate_category", "combine_first", "landcover_groups"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(cursor_rows):
    return sorted(tuple("" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in cursor_rows)


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, df.select(columns).collect())) == rows(want)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) - len([q for q in QUERIES if q in entry.oracle_sql()]) <= 4
