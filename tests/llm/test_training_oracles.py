"""The queries that have SQL give the same rows in DuckDB; all keep their own names out of other queries' way."""

import duckdb
import pytest

from stemma.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    out = QUERIES[name](spark, small)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    got = sorted(tuple(r[c] for c in columns) for r in out.collect())
    want = sorted(cursor.fetchall())
    assert len(got) == len(want)
    assert all(a == pytest.approx(b) if isinstance(a, float) else a == b for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
