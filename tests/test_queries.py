"""Every core query against its SQL on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quorate.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)

    return sorted("|".join(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    assert canonical(got) == canonical(want)
