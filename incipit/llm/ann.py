"""Approximate nearest neighbours by a hash-prefix forest (LSH forest) under the inner product.

Every tree gives each vector a long bit string (signs of random projections against their median on a bounded sample) and
is a sorted array of these strings, stored as partitions by the first bits. A query descends to its longest matching prefix
in every tree; then all trees ascend together, one bit at a time, until their matches add up to the wanted number of
candidates. Phase one counts matches by level with binary searches and sums them over the trees; phase two visits the chosen
prefix ranges (in sibling partitions where the prefix is shorter than a partition's) and scores them in double precision.
For inner products of vectors of any length, vectors get one more component that brings all to the largest norm.

`share` is the number of candidates (with repeats over trees) as a share of all vectors. Vectors without any structure need
a large one: on this project's test tables recall 0.9 takes about three quarters of the rows, which the query set visits in
blocks. Equal vectors are one class: classes are searched, and the least ids of the found classes are listed.

Bounds: a partition is cut by a hash into pieces of at most about `part_rows` vectors, and its queries likewise, so no task
holds more than one piece of each; the sample that the projections are fitted on has `fit_rows` vectors.

Ties: within a range every candidate within rounding of the k-th largest product is summed again in double precision, in
blocks, and only then ordered by score and id, so the smaller vec_id wins wherever it was visited.

Edge cases: null and zero vectors and those with null or non-finite components take no part; vectors of different lengths
have no inner product, so each length is searched by itself; a row is a candidate of every query but itself: rows that
repeat a vec_id, with the same vector or another, are rows of their own; null vec_id takes no part; fewer candidates than k
give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.scale import cut, small

KEY = ["tree", "prefix", "salt", "qsalt"]


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


class Forest:
    """Projections of all trees, fitted on a sample; pickled to the tasks (a few hundred KB)."""

    def __init__(self, sample: np.ndarray, most_norm: float, trees: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.most, self.trees, self.bits = most_norm, trees, bits
        w = rng.normal(size=(trees * bits, d + 1))
        self.w = (w / np.linalg.norm(w, axis=1, keepdims=True)).T
        self.at = np.median(self.lifted(sample, False) @ self.w, axis=0)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.most
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes by vector and tree."""
        on = (self.lifted(x, query) @ self.w > self.at).reshape(len(x), self.trees, self.bits)
        return on @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def coded(classes: DataFrame, forest, query: bool, name: str) -> DataFrame:
    """tree, code and the class, a row for each tree."""

    def run(batches):
        f = forest.value
        for b in batches:
            if b.num_rows:
                codes = f.codes(matrix(b.column(1)), query)
                n, t = codes.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(codes.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), t))], ["tree", "code", name])

    return classes.select("rep", "vec").mapInArrow(run, f"tree int, code long, {name} long")


def best_of(q: np.ndarray, qx: np.ndarray, c: np.ndarray, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's m best candidates by exact score, then id: query, candidate, score."""
    rough = qx @ x.T
    if rough.shape[1] > m:
        last = np.partition(rough, -m, axis=1)[:, -m]
        slack = 1e-12 * x.shape[1] * np.linalg.norm(qx, axis=1) * np.linalg.norm(x, axis=1).max()  # above any rounding
        row, col = np.nonzero(rough >= (last - slack)[:, None])
    else:
        row, col = (v.ravel() for v in np.indices(rough.shape))
    # The same sum for a pair in every tree; in blocks, since ties may be many.
    score = np.concatenate([(qx[row[at : at + 100_000]] * x[col[at : at + 100_000]]).sum(axis=1) for at in range(0, len(row), 100_000)])
    order = np.lexsort((c[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < m
    return q[row[keep]], c[col[keep]], score[keep]


def bounds(codes: np.ndarray, q: np.ndarray, shift) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes that share q's prefix (all but the last shift bits) start and end in sorted codes."""
    head = q >> shift
    return np.searchsorted(codes, head << shift), np.searchsorted(codes, (head + 1) << shift)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, trees: int = 12, bits: int = 32, share: float = 1.2, least: int = 1000, part_rows: int = 20_000, fit_rows: int = 20_000, seed: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score; vectors has vec_id long and embedding array<float>, is_query is a SQL predicate of vec_id."""
    valid = vectors.select("vec_id", F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    valid = cut(valid.withColumn("d", F.size("vec")), "ann-vectors")
    found = [searched(valid.where(F.col("d") == r.d).drop("d"), is_query, k, trees, bits, share, least, part_rows, fit_rows, seed) for r in valid.select("d").distinct().collect()]  # lengths are few
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def searched(valid: DataFrame, is_query: str, k: int, trees: int, bits: int, share: float, least: int, part_rows: int, fit_rows: int, seed: int) -> DataFrame:
    """nearest() for usable vectors of one length (vec_id, vec)."""
    spark, is_query = valid.sparkSession, F.expr(is_query)

    # Classes of equal vectors: representative (least id), whether a query is among them, and the k + 1 least ids (repeated ones repeat).
    classes = cut(valid.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.max(is_query).alias("asks")), "ann-classes")
    first = valid.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = cut(first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("c"), "ids"), "ann-members")
    n = classes.count()
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = math.sqrt(classes.agg(F.max(norm2)).first()[0])
    sample = classes.orderBy(F.xxhash64("rep")).limit(fit_rows).select("vec").toArrow()
    forest = spark.sparkContext.broadcast(Forest(matrix(sample["vec"]), most, trees, bits, seed))
    want = max(least, math.ceil(share * n))
    p0 = max(0, math.ceil(math.log2(n / part_rows))) if n > part_rows else 0

    index = cut(coded(classes, forest, False, "c").withColumn("prefix", F.shiftright("code", bits - p0)), "ann-index")
    asks = cut(coded(classes.where("asks"), forest, True, "q").withColumn("prefix", F.shiftright("code", bits - p0)), "ann-queries")
    sizes = cut(index.groupBy("tree", "prefix").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / (2 * part_rows)).cast("int")), "ann-sizes")

    def dealt(rows: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index rows and routed queries, cut to pieces: each query meets each piece of its partition once."""
        load = cut(routed.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("qsalts")), "ann-load")
        rows = rows.join(small(sizes.drop("n")), ["tree", "prefix"]).join(small(load), ["tree", "prefix"])
        left = rows.withColumn("salt", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int")).withColumn("qsalt", F.explode(F.sequence(F.lit(0), F.col("qsalts") - 1)))
        right = routed.join(small(sizes.drop("n")), ["tree", "prefix"]).join(small(load), ["tree", "prefix"])
        right = right.withColumn("qsalt", F.pmod(F.xxhash64("q"), F.col("qsalts")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return left.drop("salts", "qsalts"), right.drop("salts", "qsalts")

    # Phase one: matches by level, summed over trees.
    levels = list(range(p0, bits + 1))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, q = np.sort(left["code"].to_numpy()), right["code"].to_numpy()
        sums = [hi - lo for lo, hi in (bounds(codes, q, bits - x) for x in levels)]
        return pa.table([right["q"]] + [pa.array(s.astype(np.int64)) for s in sums], names=["q"] + [f"n{x}" for x in levels])

    left, right = dealt(index, asks)
    deep = left.select(*KEY, "code").groupBy(*KEY).cogroup(right.select(*KEY, "code", "q").groupBy(*KEY)).applyInArrow(count, "q long, " + ", ".join(f"n{x} long" for x in levels))
    deep = deep.groupBy("q").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in levels])
    deep = deep.select("q", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"n{x}").alias("n")) for x in levels])).alias("l")).select("q", "l.level", "l.n")
    if p0:
        heads = F.explode(F.transform(F.sequence(F.lit(0), F.lit(p0 - 1)), lambda x: F.struct(x.alias("level"), F.call_function("shiftright", F.col("prefix"), p0 - x).alias("head"))))
        above = sizes.select("tree", "n", heads.alias("h")).groupBy("tree", "h.level", "h.head").agg(F.sum("n").alias("n"))
        deep = deep.unionByName(asks.select("q", "tree", heads.alias("h")).select("q", "tree", "h.level", "h.head").join(above, ["tree", "level", "head"]).groupBy("q", "level").agg(F.sum("n").alias("n")))
    chosen = cut(deep.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("n") >= want, F.col("level"))), F.lit(0)).alias("level")), "ann-levels")

    # Phase two: the chosen prefix ranges, scored.
    vec_of_q = classes.where("asks").select(F.col("rep").alias("q"), F.col("vec").alias("qvec"))
    up = F.greatest(F.lit(p0) - F.col("level"), F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("prefix"), up), up)
    routed = asks.join(chosen, "q").withColumn("prefix", F.explode(F.sequence(low, low + F.call_function("shiftleft", F.lit(1).cast("long"), up) - 1))).join(sizes.select("tree", "prefix"), ["tree", "prefix"])
    left, right = dealt(index, routed)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        q_out, c_out, s_out = [], [], []
        if left.num_rows and right.num_rows:
            codes = left["code"].to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, reps, x = codes[order], left["c"].to_numpy()[order], matrix(left["vec"])[order]
            q, qx = right["q"].to_numpy(), matrix(right["qvec"])
            lo, hi = bounds(codes, right["code"].to_numpy(), bits - right["level"].to_numpy().astype(np.int64))
            ranges, group = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
            for g, (a, b) in enumerate(ranges):
                rows = np.flatnonzero(group.ravel() == g)
                for part in np.array_split(rows, max(1, math.ceil(len(rows) * (b - a) / 4e6))):  # bounds the score matrix
                    if a == b or not len(part):
                        continue
                    for out, values in zip((q_out, c_out, s_out), best_of(q[part], qx[part], reps[a:b], x[a:b], k + 1), strict=True):
                        out.append(values)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table([flat(q_out, pa.int64()), flat(c_out, pa.int64()), flat(s_out, pa.float64())], names=["q", "c", "score"])

    left = left.join(classes.select(F.col("rep").alias("c"), "vec"), "c").select(*KEY, "code", "c", "vec")
    right = right.join(vec_of_q, "q").select(*KEY, "code", "level", "q", "qvec")
    found = left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(score, "q long, c long, score double").distinct()

    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.join(members, "c").select("q", "score", "c", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    found = cut(found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id", "c"))).alias("near")), "ann-found")
    queries = valid.where(is_query).join(classes.where("asks").select("vec", F.col("rep").alias("q")), "vec").select(F.col("vec_id").alias("query_id"), "q").join(found, "q")
    # The query's own row is the first entry with its id and its vector.
    own = F.array_position(F.transform("near", lambda x: F.struct(x["vec_id"].alias("i"), x["c"].alias("c"))), F.struct(F.col("query_id").alias("i"), F.col("q").alias("c"))) - 1
    near = F.slice(F.filter("near", lambda x, i: i != F.col("own")), 1, k)
    return queries.withColumn("own", own).select("query_id", F.posexplode(near).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.away")).alias("score"))


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
