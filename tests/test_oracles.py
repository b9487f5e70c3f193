"""Every query with an oracle gives DuckDB's rows on the small tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
#: Those of the training-data operators are tested beside them.
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


def rows_of(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "ifb" else str(x)

    return sorted(([plain(x) for x in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def oracle(sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con.execute(sql).df()


@pytest.mark.skipif(not DATA.exists(), reason="needs the sample tables")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), oracle(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
