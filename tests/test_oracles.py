"""Every registered query that SQL can say, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from wayside.plans import ends, files, maps, perturbations, registry, reports, streaming, streams, trips, worlds  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    mine = registry.QUERIES[name](spark, SMALL)
    theirs = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows_of(mine.columns, mine.collect()) == rows_of(names, theirs.fetchall())


@pytest.mark.parametrize("name", ["approx_sync", "pose_bisect", "feature_row_26", "observer_gated", "observer_simple", "observer_linear", "off_map_modes", "live_mates"])
def test_the_rest_give_rows_and_repeat_them(spark, name):
    first, again = (registry.QUERIES[name](spark, SMALL) for _ in range(2))
    found = rows_of(first.columns, first.collect())
    assert found
    assert found == rows_of(again.columns, again.collect())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
