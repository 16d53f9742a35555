"""Whole queries on pair moments with 60,000 cells, whose number squared is beyond an int, against their SQL."""

import os
from pathlib import Path

import duckdb
import pytest

from peakweave.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """(folder, database) of the smallest tables with 60,000 suppliers."""
    folder, db = tmp_path_factory.mktemp("wide"), duckdb.connect()
    for t in ("lineitem", "part"):
        os.symlink(f"{DATA}/{t}.parquet", folder / f"{t}.parquet")
    some = f"SELECT k AS s_suppkey, s.* EXCLUDE (s_suppkey) FROM range(60000) t(k) JOIN '{DATA}/supplier.parquet' s ON s.s_suppkey = k % 10"
    db.execute(f"COPY ({some}) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    for t in ("lineitem", "part", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", ["ccan_links_masked", "ccan_graph", "init_corrcoef"])
def test_like_sql(spark, wide, name):
    folder, db = wide
    df = catalog.QUERIES[name](spark, folder)
    want = db.sql(catalog.SQL[name]).select(*df.columns).fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def test_modules(spark, wide):
    """Modules have three regions or more, all of them in the graph."""
    folder, db = wide
    rows = catalog.QUERIES["louvain_ccans"](spark, folder).collect()
    sizes = {}
    for r in rows:
        sizes[r.CCAN] = sizes.get(r.CCAN, 0) + 1
    assert sizes and min(sizes.values()) > 2
    assert {r.Peak for r in rows} <= {x for (x,) in db.sql(catalog.SQL["ccan_nodes"]).fetchall()}
