"""Registered queries against their SQL on DuckDB, over the whole smallest tables."""
import os
from pathlib import Path

import pytest

from incipit.plans import book_queries, layout_queries, queries, text_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = text_queries.ORACLES | book_queries.ORACLES | layout_queries.ORACLES | {n: queries.ORACLES[n] for n in ("bm25_topk", "bm25_indexed", "evidence_found", "distinctive_topics", "recall_at_words")}
FOUND = {n: q for n, q in (queries.QUERIES | text_queries.QUERIES | book_queries.QUERIES | layout_queries.QUERIES).items() if n in SQL}


@pytest.fixture(scope="module")
def duck():
    db = pytest.importorskip("duckdb").connect()
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    for name in ("documents", "benchmark", "labels", "pages", "conversations"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


def rows(names, values):
    at = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: v if v is None or isinstance(v, (str, bool)) else round(float(v), 5)
    return sorted((tuple(plain(r[k]) for k in at) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_same_rows(spark, duck, name):
    got = FOUND[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
