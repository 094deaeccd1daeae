"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest
from airtide.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "embeddings events lineitem".split()


def plain(rows):
    return sorted(str(tuple(None if v is None else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(core.SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0
