"""Forest search against brute force."""
import numpy as np

from incipit.llm import ann

IS_QUERY = "vec_id % 20 = 0"


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x.astype(float) @ q.astype(float)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, q string")


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({a for a, _ in got.get(q, [])} & {a for a, _ in w}) / len(w) for q, w in want.items()])


def data(n=1500, d=16, unit=True):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return np.arange(n), (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if unit else x * rng.uniform(0.2, 3, size=(n, 1)).astype(np.float32)


def test_recall_and_scores(spark):
    for unit in (True, False):
        ids, x = data(unit=unit)
        got, want = results(ann.nearest(frame(spark, zip(ids.tolist(), x.tolist())), IS_QUERY, least=100, part_rows=200)), brute(ids, x)
        assert got.keys() == want.keys() and recall(got, want) >= 0.9
        for q, near in got.items():
            assert len(near) == 20 and near == sorted(near, key=lambda p: (-p[1], p[0]))
            assert all(abs(s - x[q].astype(float) @ x[v].astype(float)) < 1e-9 for v, s in near)


def brute_rows(rows, k=20):
    """By row: (query_id, [(vec_id, score)]) for every usable query row, against all usable rows of its length but itself."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for n, (i, q) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float((q * v).sum()), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))[:k]
            out.append((i, [(j, -s) for s, j in near]))
    return sorted(out)


def by_row(df):
    """Results as brute_rows has them, for tables where a query_id may repeat: as a multiset of (query, rank, id)."""
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_exact_with_all_candidates_ties_and_bad_rows(spark):
    ids, x = data(300, 8)
    x[100:180] = x[3]  # a large class, queries among it
    x[200] = x[7]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [1.0] * 7 + [None]), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (1100, [1.0, 2.0]), (1120, []), (None, [1.0] * 8)]
    rows = list(zip(ids.tolist(), x.tolist())) + bad + [(40, x[40].tolist()), (60, x[41].tolist()), (61, x[42].tolist()), (1160, [2.0, 2.0]), (7, [1.0, -3.0])]
    got = ann.nearest(frame(spark, rows), IS_QUERY, share=100.0)
    assert by_row(got) == sorted((q, n + 1, j, round(s, 9)) for q, near in brute_rows(rows) for n, (j, s) in enumerate(near))


def test_many_ties_of_different_vectors(spark):
    """399 distinct vectors with one inner product: the smallest ids win, in pieces and whole."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(i % 21 - 10), float(i // 21 - 10)]) for i in range(1, 400)]
    for part in (20_000, 50):
        got = results(ann.nearest(frame(spark, rows), "vec_id = 0", share=100.0, part_rows=part))
        assert got == {0: [(i, 0.5) for i in range(1, 21)]}


def test_few_rows(spark):
    assert ann.nearest(frame(spark, []), IS_QUERY).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0, 2.0])]), IS_QUERY).count() == 0
    assert results(ann.nearest(frame(spark, [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [-1.0, 0.0])]), IS_QUERY)) == {0: [(3, 5.0), (5, -1.0)]}
