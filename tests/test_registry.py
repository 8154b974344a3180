"""Every registered query runs, and equals its SQL in DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tidewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr([plain(r[i]) for i in order]) for r in data))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    data = [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in got.collect()]
    if name not in registry.ORACLES:
        assert data
        return
    want = duck.sql(registry.ORACLES[name])
    columns, theirs = rows(want.columns, want.fetchall())
    assert rows(got.columns, data) == (columns, theirs)


def test_translation_errors_at_line_ends(spark, tmp_path):
    """References that end or begin with a line end, a tab or a wide space, as the SQL takes them."""
    texts = ["ab cd, ef gh", "ab cd ef.\ngh ij kl mn op", "\n\tab cd ef gh ij", "ab cd ef\r\n", "\u3000ab cd ef gh\u00a0", " ab cd ef gh\u2028", "\n", None]
    items = [(i, s) for i in range(12) for s in texts]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    got = registry.QUERIES["p21_translation_errors"](spark, str(tmp_path))
    want = con.sql(registry.ORACLES["p21_translation_errors"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
