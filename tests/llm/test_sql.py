"""The text operators' queries that have DuckDB text give the same rows as that text."""

from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
from netdensity.llm import queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data")
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = duck.sql(queries.oracle_sql()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall()), key=str)
