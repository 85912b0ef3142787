"""Conversation prefix trie by preorder intervals.

A conversation is a path of fixed-width tokens, one a turn (a digest of role and text, and the text's word count). Equal
paths are one class. Classes are sorted by path over all partitions and numbered in that order, so a node (a distinct
prefix) covers a run of consecutive classes, from the first to the last that start with it. (first class, depth) orders
the nodes in preorder, and a node's subtree is the interval from itself to the last node that its last class brings in.
Childless nodes and saved words are summed up along this order: within a class's own nodes, over the classes of a
range partition, and over the partitions. A subtree's sums are then differences of two of these prefix sums.

Bounds: a conversation's path (40 bytes a turn) meets in one row, its texts never do. Prefix digests are carried on from
turn to turn, so long conversations cost linear time. Nodes that many conversations share (the root, a common first turn)
are summed before the shuffle. The ids that end at a node are joined in chunks of at most 8,191 and digested as a stream,
so a node where a third of all conversations end needs no row with all of them.

Edge cases: null role or text is empty; turns are ordered by turn (null first), ties by role and then by the SHA-256 of the
turn; repeated rows are repeated turns; rows without conv_id take no part; texts of any length are digested and counted
whole; an empty table has no conversation and so no node, not even the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.scale import cut

WORD = r"[^\x20\x09-\x0D]+"
DIGEST, COUNT = 32, 8  # hex digits of a turn's digest and of its word count
TOKEN = DIGEST + COUNT


def turn_tokens(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), token: the turns of each conversation in order, as fixed-width tokens."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    token = F.concat(digest, F.lower(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), COUNT, "0")))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), token.alias("token"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "token")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "token")


def prefix_digest(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:DIGEST]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, path, n, least) to a row for each prefix: node, parent, depth, words of the last text, i, n, least."""
    names = ["node", "parent", "depth", "words", "i", "n", "least"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for i, path, n, least in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            running, parent = hashlib.sha256(), None
            for depth in range(len(path) // TOKEN + 1):
                words = 0
                if depth:
                    token = path[(depth - 1) * TOKEN : depth * TOKEN]
                    running.update(token.encode())
                    words = int(token[DIGEST:], 16)
                node = running.copy().hexdigest()[:DIGEST]
                for values, v in zip(out, (node, parent, depth, words, i, n, least), strict=True):
                    values.append(v)
                parent = node
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids), sorted by node and chunk, to (node, digest of the joined ids); holds one chunk at a time."""
    now, running = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if running is not None:
                    done.append((now, running.hexdigest()))
                now, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in done], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ascending ids of the conversations that end there, comma-joined."""
    node = F.substring(F.sha2("path", 256), 1, DIGEST)
    rows = paths.select(node.alias("node"), "conv_id", F.expr("conv_id div 4096").alias("chunk"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = rows.groupBy("node", "chunk").agg(joined.alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_streamed, "node string, ends_sha256 string")


def summed_before(totals: DataFrame, at: str, values: list[str]) -> DataFrame:
    """totals with `before_v` for each v: the sum of v over all rows with a smaller `at`, which sort ids of one numbered table are.

    The upper bits of such ids name a range partition: sums run within each, and over the totals of the partitions.
    """
    part = F.shiftright(at, 33)
    within = Window.partitionBy("_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    totals = totals.withColumn("_part", part)
    parts = totals.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values]).select("_part", *[F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_{v}") for v in values])
    rows = totals.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"before_{v}") for v in values])
    return rows.join(parts, "_part").select(*[c for c in totals.columns if c != "_part"], *[(F.col(f"before_{v}") + F.col(f"_{v}")).alias(f"before_{v}") for v in values])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node; turns has conv_id, pos, token (see turn_tokens), convs every conv_id, also turnless ones.

    Returns node (digest of the prefix), parent, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the interval: first and last class.
    """
    rows = turns.select("conv_id", "pos", "token").unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("token")))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")
    paths = cut(rows.groupBy("conv_id").agg(path.alias("path")), "trie-paths")
    classes = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    classes = cut(classes.orderBy("path").select(F.monotonically_increasing_id().alias("i"), "path", "n", "least"), "trie-classes")
    found = classes.mapInArrow(_prefixes, "node string, parent string, depth long, words long, i long, n long, least long")
    nodes = found.groupBy("node", "parent", "depth", "words").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min("i").alias("first"), F.max("i").alias("last"))
    nodes = cut(nodes, "trie-nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "node", "left").join(ends(paths), "node", "left").fillna({"n_children": 0, "ends_sha256": hashlib.sha256(b"").hexdigest()})
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    own = Window.partitionBy("first").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = cut(nodes.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"own_{v}") for v in ("leaf", "saved")]), "trie-order")
    sums = cut(summed_before(nodes.groupBy("first").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "first", ["leaf", "saved"]), "trie-sums")
    start = sums.select("first", F.col("before_leaf").alias("leaf0"), F.col("before_saved").alias("saved0"))
    end = sums.select(F.col("first").alias("last"), (F.col("before_leaf") + F.col("leaf")).alias("leaf1"), (F.col("before_saved") + F.col("saved")).alias("saved1"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(start, "first").join(end, "last").join(above, "parent", "left")
    leaves, saved = F.col("leaf1") - F.col("leaf0") - F.col("own_leaf"), F.col("saved1") - F.col("saved0") - F.col("own_saved")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), "ends_sha256", "first", "last")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The turns of every conversation c after its first h are its own, the first h those of conversation c - c % family."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = turns.select("conv_id").distinct().withColumn("h", h).where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "token")
    taken = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "token")
    return turns.where(F.col("pos") > h).select("conv_id", "pos", "token").unionByName(taken)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = cut(turn_tokens(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return trie(rebuilt(turns), turns.select("conv_id").distinct()).select(*RESULT)


def oracle() -> str:
    return r"""
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, token) AS pos, role, text, token
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, b)),
      4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
rebuilt AS (
  SELECT c.conv_id, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h),
placed AS (
  SELECT conv_id, row_number() OVER w AS d, text,
         list(sha256(length(role) || ':' || role || text)) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
prefixes AS (
  SELECT conv_id, 0 AS d, '' AS node, NULL AS parent, 0 AS words FROM convs
  UNION ALL
  SELECT conv_id, d, sha256(array_to_string(path, ',')), CASE WHEN d = 1 THEN '' ELSE sha256(array_to_string(path[:d - 1], ',')) END,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM placed),
lengths AS (SELECT conv_id, max(d) AS l FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT node, parent, d, words, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = l), '') AS ends
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY node, parent, d, words),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
lines AS (SELECT DISTINCT a.node AS top, b.node AS below FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.d <= b.d),
subtrees AS (
  SELECT top AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM lines JOIN full_nodes f ON f.node = lines.below GROUP BY top)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN subtrees USING (node) LEFT JOIN full_nodes p ON p.node = n.parent"""
