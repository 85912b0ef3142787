"""Targets, draws and shards against brute force."""
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from incipit.llm import mixing


def brute_targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, full, left = share * sum(sizes.values()), {}, set(names)
    while True:
        level = (goal - sum(full.values())) / max(1, sum(w[s] for s in left)) if left else 0
        over = {s for s in left if level * w[s] > most * sizes[s]}
        if not over:
            return full | {s: level * w[s] for s in left}
        full |= {s: most * sizes[s] for s in over}
        left -= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 7, "Z": 0}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 100000}, {"é": 50, "z": 3000, "zz": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_hypergeometric(spark):
    total, marked, n = 60, 25, 20
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(n), (F.col("id") + 0.5) / 4000).alias("x")).collect()
    seen, upto = Counter(r.x for r in draws), 0.0
    for x in range(21):
        p = math.comb(marked, x) * math.comb(total - marked, n - x) / math.comb(total, n)
        assert abs(seen[x] / 4000 - p) < 1e-3
    edge = spark.createDataFrame([(0, 0, 0), (5, 0, 3), (5, 5, 3), (5, 3, 5), (5, 3, 0), (10**9, 4 * 10**8, 5 * 10**8)], "t long, m long, n long")
    for r in edge.select("*", mixing.hypergeometric(F.col("t"), F.col("m"), F.col("n"), F.lit(0.37)).alias("x")).collect():
        assert max(0, r.n - r.t + r.m) <= r.x <= min(r.m, r.n)


def corpus():
    rows = [(k, " ".join(["w"] * (1 + k * 37 % 90)), ["hot", "hot", "b", "c", None][k % 5]) for k in range(600)]
    return rows + [(700, None, "b"), (701, "", "only empty"), (702, "x y", "hot"), (702, "x y", "hot"), (None, "a b c", "hot"), (703, "w " * 5000, "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3, 4, 5) for r in rows], "doc_id long, text string, source string, size int, key string, position int, copies int, epoch int, h int")


def test_mix(spark):
    docs = frame(spark, corpus())
    shards = 7
    rows = [r.asDict() for r in mixing.mix(docs, shards, 16).select("doc_id", "text", "source", F.spark_partition_id().alias("p"), "shard").collect()]
    words = lambda t: len((t or "").split())
    sizes, taken, copies = defaultdict(int), defaultdict(int), Counter()
    for _, t, s in corpus():
        sizes[s] += words(t)
    for r in rows:
        taken[r["source"]] += words(r["text"])
        copies[r["doc_id"], r["text"]] += 1
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(4, 0.01 * want[s]), (s, taken[s], want[s])
    assert max(v for (d, _), v in copies.items() if d != 702) <= 2 and copies[702, "x y"] <= 4
    assert {r["shard"] for r in rows} == set(range(shards))
    again = mixing.mix(docs.repartition(5), shards, 16).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.shard) for r in again))) == sorted(map(str, ((r["doc_id"], r["text"], r["shard"]) for r in rows)))


def test_columns_that_clash(spark):
    docs = frame(spark, corpus()).withColumns({"shard": F.lit("mine"), "_doc": F.lit(1), "a.b": F.lit(2)})
    mixed = mixing.mix(docs, 4, 16)
    assert mixed.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    assert {(r["size"], r["key"], r["position"], r["copies"], r["epoch"], r["h"], r["_doc"], r["a.b"]) for r in mixed.collect()} == {(1, "s", 2, 3, 4, 5, 1, 2)}
    plain = mixing.mix(docs, 4, 16, shard_as=None)
    assert plain.columns == docs.columns and {r["shard"] for r in plain.collect()} == {"mine"}


def test_rows_of_one_key_are_drawn_one_by_one(spark):
    """A source of one row a thousand times, with a target of 1.5 times its size."""
    docs = spark.createDataFrame([(7, "a b", "x")] * 1000 + [(None, "c d", "y")] * 10, "doc_id long, text string, source string").repartition(5)
    taken = Counter(r.source for r in mixing.mix(docs, 4, 16).collect())
    want = brute_targets({"x": 2000, "y": 20})
    assert all(abs(2 * taken[s] - want[s]) <= 2 for s in want)


def test_ranks(spark):
    names = [f"s{k}" for k in range(500)] + [None, "é", "Z", ""]
    got = {r.source: r.k for r in mixing.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(7)).collect()}
    assert got == {n: k for k, n in enumerate(sorted((n for n in names if n is not None), key=str.encode))} | {None: len(names) - 1}


@pytest.mark.parametrize("chunk", [1024, 1])
def test_leaf_quotas_are_exact(spark, chunk):
    units = spark.createDataFrame([("a", k) for k in range(101)] + [(None, k) for k in range(13)] + [("b", 0)], "source string, rank int")
    got = mixing.leaf_ranks(units, 8, chunk).collect()
    by = defaultdict(list)
    for r in got:
        by[r.leaf_source].append(r.leaf_rank)
    assert {s: sorted(v) for s, v in by.items()} == {"a": list(range(1, 102)), None: list(range(1, 14)), "b": [1]}
    totals = Counter(r.shard for r in got)
    assert set(totals) == set(range(8)) and max(totals.values()) - min(totals.values()) <= 1


def test_empty(spark):
    assert mixing.mix(frame(spark, []), 4, 4).count() == 0
