from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def rows(names, values):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_subpackage_is_imported_by_nothing_else():
    root = Path(entry.__file__).parent
    for p in (root / "phaseflow").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
