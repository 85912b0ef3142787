"""Hard negatives by ball-tree branch-and-bound over inner products of whole-number vectors.

Vectors are dealt by label into pieces; each task builds a ball tree over one piece and sends a block of anchors down it.
A node with centre c and radius r bounds the inner products of its rows with q by q.c - |q| r and q.c + |q| r. Positives
(an anchor's best rows of its own label) visit the pieces of that label, and a node goes when its upper bound lies
strictly beneath the anchor's k-th score so far. Negatives visit the pieces that hold another label; a node goes when its
bounds lie outside the score window, which the positive's score sets, or the upper one strictly beneath the k-th. Rows on a
bound are visited, so ties are decided by vec_id. Every piece gives its k best, the best of these are taken at the end.

Anchors are a stated query set and meet the rows in blocks: no task holds more than about `part_rows` rows and
`block_rows` anchors. Few labels share a piece only where they are rare, and frequent labels are cut in several pieces.

Vectors without structure (as in this project's test tables) give wide balls, so few nodes are pruned there.

Edge cases: rows with a null vec_id, label or vector, or any null or non-finite component take no part; vectors of
different lengths have no inner product, so each length is searched by itself; an empty vector scores 0 with others; rows
that repeat a vec_id are rows of their own, in the order of label and vector; an anchor is no partner of itself, but its
equals are; an anchor without positives or a positive without negatives gives no row; a score that 64 bits cannot hold is
an error; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.scale import cut, small

LEAF = 64
EXACT_FLOAT = float(1 << 53)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the rows of q with those of x, as int64; both hold whole numbers as float64."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT_FLOAT:
        return (q @ x.T).astype(np.int64)
    a, b = ([[int(v) for v in row] for row in m] for m in (q, x))  # beyond what doubles add up exactly
    sums = [[sum(map(int.__mul__, r, s)) for s in b] for r in a]
    if any(abs(v) >= 1 << 63 for row in sums for v in row):
        raise OverflowError("an inner product does not fit in 64 bits")
    return np.array(sums, np.int64)


class BallTree:
    """Rows halved at the median of their widest direction until leaves hold LEAF rows; nodes know centre, radius and labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = x, label
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right; leaves have -1
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.only: list[int | None] = []  # the label of all rows, if they share one
        if len(x):
            self._build(0, len(x))
        self.centres = np.array(self.centre) if self.centre else np.zeros((0, x.shape[1]))

    def _build(self, a: int, b: int) -> int:
        rows = self.x[self.order[a:b]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        labels = self.label[self.order[a:b]]
        at = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.only.append(int(labels[0]) if (labels == labels[0]).all() else None)
        if b - a > LEAF and self.radius[at] > 0:
            far = rows[away.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            along = rows @ (other - far)
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(along, mid)]
            self.nodes[at] = (a, b, self._build(a, a + mid), self._build(a + mid, b))
        return at

    def search(self, q: np.ndarray, k: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], fits: Callable[[np.ndarray, int | None], np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) that hold each query's k best scores in [low, high], ties with the k-th included.

        wanted(queries, rows) says which pairs may be partners, fits(queries, label) which queries a one-label node may serve.
        """
        kth = np.full((len(q), k), -np.inf)
        norm = np.sqrt((q * q).sum(axis=1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(0, np.arange(len(q)))] if len(self.nodes) else []
        while stack:
            node, asked = stack.pop()
            a, b, left, right = self.nodes[node]
            asked = asked[fits(asked, self.only[node])]
            mid, spread = q[asked] @ self.centres[node], norm[asked] * self.radius[node]
            slack = 1e-9 * (np.abs(mid) + spread) + 1e-6  # above any rounding of the bounds
            asked = asked[(mid + spread + slack >= np.maximum(low[asked], kth[asked, 0])) & (mid - spread - slack <= high[asked])]
            if not len(asked):
                continue
            if left >= 0:
                nearer = q[asked].sum(axis=0) @ (self.centres[left] - self.centres[right]) >= 0
                stack += [(right, asked), (left, asked)] if nearer else [(left, asked), (right, asked)]  # the last goes first
                continue
            rows = self.order[a:b]
            for part in np.array_split(asked, math.ceil(len(asked) * len(rows) / 4e6)):
                s = products(q[part], self.x[rows])
                ok = wanted(part, rows) & (s >= low[part, None]) & (s <= high[part, None]) & (s >= kth[part, :1])
                p, r = np.nonzero(ok)
                if len(p):
                    found.append((part[p], rows[r], s[p, r]))
                    seen = np.where(ok, s, -np.inf)
                    if seen.shape[1] > k:
                        seen = np.partition(seen, -k, axis=1)[:, -k:]
                    kth[part] = np.sort(np.hstack([kth[part], seen]), axis=1)[:, -k:]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        p, r, s = (np.concatenate(v) for v in zip(*found, strict=True))
        keep = s >= kth[p, 0]
        return p[keep], r[keep], s[keep]


def best(p: np.ndarray, s: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their query: higher score, then smaller name."""
    order = np.lexsort((name, -s, p))
    p = p[order]
    return order[np.arange(len(p)) - np.searchsorted(p, p) < k]


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """u (the row's own number, in the order of vec_id, label, vector), vec_id, label, v (floor of scale times each component)."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(usable).select("vec_id", F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))
    return cut(rows.orderBy("vec_id", "label", "v").select(F.monotonically_increasing_id().alias("u"), "*"), "negatives-vectors")


def matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table[name].combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _placed(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece and dimension, and label to piece. Frequent labels have pieces of their own, rare ones share them."""
    sizes = cut(rows.groupBy("d", "label").agg(F.count("*").alias("n")), "negatives-labels")
    own = F.ceil(F.col("n") / part_rows)
    rare = sizes.where(F.col("n") * 2 < part_rows).groupBy("d").agg(F.sum("n").alias("rare"))
    shared = F.pmod(F.xxhash64("label"), F.greatest(F.ceil(F.col("rare") / part_rows), F.lit(1))).cast("int")
    plan = sizes.join(rare, "d", "left").select("d", "label", F.when(F.col("n") * 2 < part_rows, F.lit(1)).otherwise(own).cast("int").alias("salts"), F.when(F.col("n") * 2 < part_rows, F.concat(F.lit("r"), shared)).otherwise(F.concat(F.lit("l"), F.col("label"))).alias("home"))
    plan = cut(plan, "negatives-plan")
    salt = F.pmod(F.xxhash64("u"), F.col("salts")).cast("int")
    placed = rows.join(small(plan), ["d", "label"]).select("d", "u", "vec_id", "label", "v", F.concat_ws(".", "home", salt).alias("piece"))
    pieces = plan.select("d", "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "home").select("d", "label", F.concat_ws(".", "home", "salt").alias("piece"))
    return cut(placed, "negatives-placed"), cut(pieces, "negatives-pieces")


def mined(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, part_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as whole_vectors() has them.

    A negative's score lies between low % and high % of the positive's.
    """
    rows = rows.withColumn("d", F.size("v"))
    placed, pieces = _placed(rows, part_rows)
    anchors = rows.where(is_anchor).select("d", F.col("u").alias("anchor"), "label", F.col("v").alias("q"))
    blocks = F.greatest(F.ceil(F.lit(anchors.count()) / block_rows), F.lit(1))
    anchors = cut(anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), blocks).cast("int")), "negatives-anchors")

    def met(asks: DataFrame, task, schema: str) -> DataFrame:
        """Each block of asks (d, piece, block, ...) with each piece it asks for: rows of the piece go to its blocks."""
        copies = placed.join(asks.select("d", "piece", F.col("block").alias("to")).distinct(), ["d", "piece"])
        return copies.groupBy("d", "piece", "to").cogroup(asks.groupBy("d", "piece", "block")).applyInArrow(task, schema)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        x, u, label = matrix(left, "v"), left["u"].to_numpy(), left["label"].to_numpy()
        q, anchor, own = matrix(right, "q"), right["anchor"].to_numpy(), right["label"].to_numpy()
        no = np.full(len(q), np.inf)
        p, r, s = BallTree(x, label).search(q, positives, lambda a, b: (own[a][:, None] == label[b]) & (anchor[a][:, None] != u[b]), lambda a, one: own[a] == one if one is not None else np.ones(len(a), bool), -no, no)
        keep = best(p, s, u[r], positives)
        return pa.table([anchor[p[keep]], u[r[keep]], left["vec_id"].to_numpy()[r[keep]], s[keep]], names=["anchor", "positive", "positive_id", "positive_score"])

    asks = anchors.join(pieces, ["d", "label"]).select("d", "piece", "block", "anchor", "label", "q")
    found = met(asks, find_positives, "anchor long, positive long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive")
    pairs = cut(found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives), "negatives-positives")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        x, u, label = matrix(left, "v"), left["u"].to_numpy(), left["label"].to_numpy()
        windows = right["windows"].combine_chunks()
        asker = windows.value_parent_indices().to_numpy()  # of each window, its anchor's row
        field = {name: windows.flatten().field(name).to_numpy() for name in ("positive", "positive_id", "positive_score", "least", "most")}
        q, own = matrix(right, "q")[asker], right["label"].to_numpy()[asker]
        p, r, s = BallTree(x, label).search(q, negatives, lambda a, b: own[a][:, None] != label[b], lambda a, one: own[a] != one if one is not None else np.ones(len(a), bool), field["least"], field["most"])
        keep = best(p, s, u[r], negatives)
        of = p[keep]
        return pa.table([right["anchor"].to_numpy()[asker][of], field["positive"][of], field["positive_id"][of], field["positive_score"][of], u[r[keep]], left["vec_id"].to_numpy()[r[keep]], s[keep]], names=["anchor", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score"])

    # The window in whole scores: rounded inwards. Pieces that hold the anchor's label alone have no negatives for it.
    ps = F.col("positive_score").cast("decimal(38,0)")
    window = [F.ceil(ps * low / 100).cast("long").alias("least"), F.floor(ps * high / 100).cast("long").alias("most")]
    windows = pairs.select("anchor", "positive", "positive_id", "positive_score", *window).where("least <= most")
    asked = windows.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score", "least", "most")).alias("windows"))  # at most `positives`
    asked = cut(asked.join(anchors, "anchor"), "negatives-windows")
    holds = pieces.groupBy("d", "piece").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    asks = asked.join(small(holds), "d").where(~((F.col("l0") == F.col("label")) & (F.col("l1") == F.col("label")))).drop("l0", "l1")
    found = met(asks, find_negatives, "anchor long, positive long, positive_id long, positive_score long, negative long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    names = rows.where(is_anchor).select(F.col("u").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(whole_vectors(vectors.withColumn("label", label)), "vec_id % 50 = 0")


def oracle() -> str:
    return """
WITH usable AS (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.u AS anchor, a.vec_id AS anchor_id, b.u AS other, b.vec_id AS other_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.u <> b.u AND len(a.v) = len(b.v)),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5),
found AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id, n.other) AS rank
  FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score
FROM found WHERE rank <= 3"""
