"""Every registered query of the catalog runs, and equals its DuckDB SQL where it has one."""

import os

import duckdb
import pytest

from strandline import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    """Rows in a comparable form, by column name."""
    df = df[sorted(df.columns)]
    return sorted(repr([None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) else v for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_every_line_is_simplified(spark, duck):
    got = {r["id"]: r["n"] for r in catalog.QUERIES["simplified_lines"](spark, "/root/testdata/sf0.01").collect()}
    sizes = dict(duck.sql("SELECT user_id, count(*) FROM '/root/testdata/sf0.01/events.parquet' GROUP BY 1").fetchall())
    assert max(sizes) >= 40 and got.keys() == sizes.keys()
    assert all(min(2, sizes[k]) <= n <= sizes[k] for k, n in got.items())
