"""Hard negatives against all scores in plain Python."""
import math
from collections import Counter

import numpy as np
import pytest

from incipit.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, v string, q string, anchor string"


def brute(rows, is_anchor=lambda i: i % 50 == 0, most=5, take=3):
    usable = [(i, lb, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, lb in rows if None not in (i, v, lb) and all(c is not None and math.isfinite(c) for c in v)]
    out = Counter()
    for n, (i, lb, q) in enumerate(usable):
        if not is_anchor(i):
            continue
        scored = [(-sum(map(int.__mul__, q, v)), j, lj, v, m) for m, (j, lj, v) in enumerate(usable) if m != n and len(v) == len(q)]
        near = sorted((s, j, v) for s, j, lj, v, _ in scored if lj == lb)[:most]
        for s, j, _ in near:
            fits = sorted((t, k, lk, v) for t, k, lk, v, _ in scored if lk != lb and 50 * -s <= 100 * -t <= 95 * -s)[:take]
            out.update((i, j, r + 1, k, -s, -t) for r, (t, k, *_) in enumerate(fits))
    return out


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lb, "a", "b", "c") for i, v, lb in rows], SCHEMA)
    got = hn.mined(hn.whole_vectors(df), "vec_id % 50 = 0", **sizes)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def clustered(n=900, d=8, labels=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d)) * 0.5 + 0.6
    label = np.where(rng.random(n) < 0.4, 0, rng.integers(0, labels, n))
    x = (centres[label] + rng.normal(size=(n, d)) * 0.25).astype(np.float32)
    return [(i, x[i].tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 100, "block_rows": 4}])
def test_same_as_all_scores(spark, sizes):
    rows = clustered()
    want = brute(rows)
    assert len(want) > 100 and found(spark, rows, **sizes) == want


def test_ties_repeats_bad_rows_and_rare_labels(spark):
    rows = [(i, [1.0, float(i % 3), 0.5], i % 4) for i in range(0, 260)]  # many ties
    rows += [(50, [1.0, 2.0, 0.5], 2), (50, [1.0, 0.0, 0.5], 3), (7, [1.0, 0.0, 0.5], 3), (300, [0.0, 0.0, 0.0], 1), (350, [-1.0, -1.0, 0.0], 0)]
    rows += [(400, None, 1), (450, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (500, [1.0, None, 0.0], 1), (550, [float("nan"), 1.0, 1.0], 1), (600, [float("inf"), 1.0, 1.0], 2)]
    rows += [(650, [1.0, 1.0], 1), (651, [1.0, 1.0], 1), (652, [0.7, 0.8], 2), (700, [], 1), (701, [], 1), (702, [], 5)] + [(800 + k, [1.0, 1.0, 1.0 / (k + 1)], 1000 + k) for k in range(60)]
    want = brute(rows)
    assert want and found(spark, rows) == want
    assert found(spark, rows, part_rows=16, block_rows=2) == want


def test_large_components(spark):
    rows = [(i, [3e5 + i, 1e6 * (i % 5), 7e5], i % 3) for i in range(0, 120)]
    assert found(spark, rows) == brute(rows)
    big = hn.products(np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0]]))
    assert big.tolist() == [[2**60 + 3]]
    with pytest.raises(OverflowError):
        hn.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_empty(spark):
    assert not found(spark, [])
    assert not found(spark, [(0, [1.0], 1)])


def test_pruning_visits_few_leaves(monkeypatch):
    """On clustered rows the tree leaves most rows unvisited, and still finds the same partners."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.repeat(rng.normal(size=(60, 8)) * 4, 60, axis=0) + rng.normal(size=(3600, 8)) * 8)
    q, label = x[::300], np.zeros(3600, np.int64)
    seen = []
    plain = hn.products
    monkeypatch.setattr(hn, "products", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    no = np.full(len(q), np.inf)
    p, r, s = hn.BallTree(x, label).search(q, 5, lambda a, b: np.ones((len(a), len(b)), bool), lambda a, one: np.ones(len(a), bool), -no, no)
    keep = hn.best(p, s, r, 5)
    want = plain(q, x)
    for k in range(len(q)):
        assert sorted(s[keep][p[keep] == k]) == sorted(want[k])[-5:]
    assert sum(seen) < 0.5 * len(q) * len(x)


def test_same_rows_as_sql(spark):
    db = pytest.importorskip("duckdb").connect()
    sf = "/root/testdata/sf0.001"
    db.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = db.execute(hn.oracle())
    got = hn.op12_hard_negatives(spark, sf)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
