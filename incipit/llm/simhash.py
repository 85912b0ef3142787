"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits by pigeonring filtering.

Fingerprints are cut in three segments on a ring. If two fingerprints differ in at most two bits, then from some segment on
the ring every chain of 1, 2, 3 consecutive segments holds at most 2/3, 4/3 and 2 differing bits, i.e. 0, 1 and 2. So a
pair is a candidate only if it agrees on a whole segment (chain of one) and differs in at most one bit of the next one
(chain of two); the latter holds only if one half of that next segment agrees too, and segment plus half is the join key
(about 32 bits). Chains are checked before the full Hamming distance.

Work is on distinct fingerprints, so groups of exact copies cost one row. A key shared by more than `pair_limit` different
fingerprints (families of near copies) is not paired: there each fingerprint is filed under itself and its 64 one-bit
neighbours, since two fingerprints lie within two bits exactly if their one-bit balls meet. That costs 65 rows a
fingerprint, loses no link, and no point is shared by more than 65 fingerprints. Components come from alternating
large-star and small-star passes, each written to the shared folder.

Edge cases: null or wordless text has fingerprint zero and is linked like any other; fewer words than the shingle give one
shingle of all words; repeated rows each get their row; null doc_id gets the component of its fingerprint's group; an empty
table gives no rows; near_duplicates() reads doc_id and text only, keep_one() keeps docs' columns, also where names clash
with its own. Texts are never cut: long ones are hashed in pieces of 65,536 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from incipit.llm.components import components
from incipit.scale import cut

#: First bit and width of the three segments; together 64 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
TAU = 2
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """Lower-cases A-Z, splits at ASCII white space, votes each bit over the XXH64 of all shingles."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounds memory for very long texts
        end = min(n, at + 65_536)
        h = np.fromiter((hash_of(join(words[k : k + shingle]), SEED) for k in range(at, end)), np.uint64, end - at)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def segment(fp, k: int):
    at, width = SEGMENTS[k % 3]
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def links(fps: DataFrame, pair_limit: int = 64) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within TAU bits; fps holds distinct values of fp."""
    fp = F.col("fp")
    keys = []
    for k in range(3):
        width = SEGMENTS[(k + 1) % 3][1]
        low = (width + 1) // 2
        for half in (0, 1):
            part = segment(fp, k + 1).bitwiseAND((1 << low) - 1) if half == 0 else F.shiftrightunsigned(segment(fp, k + 1), low)
            keys.append(F.struct(F.lit(2 * k + half).cast("tinyint").alias("chain"), F.shiftleft(segment(fp, k), 11).bitwiseOR(part).alias("key")))
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("c")).select("fp", "c.chain", "c.key")
    # A key's group holds distinct fingerprints. Only groups with a partner go on, and only up to the limit are they paired.
    sizes = filed.groupBy("chain", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(filed.join(sizes, ["chain", "key"]), "simhash-keys")
    few = shared.where(F.col("n") <= pair_limit)
    a, b = few.select("chain", "key", F.col("fp").alias("u")), few.select("chain", "key", F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    second = F.coalesce(*[F.when(F.shiftright(F.col("chain"), 1) == k, F.bit_count(segment(diff, k + 1))) for k in range(3)])
    pairs = a.join(b, ["chain", "key"]).where("u < v").where(second <= 1).where(F.bit_count(diff) <= TAU).select("u", "v").distinct()
    # Crowded keys: one-bit balls instead of pairs.
    crowded = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = crowded.select("fp", F.explode(flips).alias("point"))
    centre = balls.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(centre, "point").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    return pairs.unionByName(stars).distinct()


def grouped(prints: DataFrame, pair_limit: int = 64) -> DataFrame:
    """fp, root (the least fingerprint of its component), component_id (the smallest doc_id there), from doc_id and fp."""
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    roots = components(links(groups.select("fp"), pair_limit))  # node, root: for linked fingerprints only
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, pair_limit: int = 64) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among all that are linked, directly or not."""
    prints = cut(fingerprints(docs, shingle), "simhash-fp")
    return prints.join(grouped(prints, pair_limit).drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, pair_limit: int = 64) -> DataFrame:
    """Exactly one row of each component, with docs' columns.

    It is a row of the smallest doc_id (null last), there of the least fingerprint, and among those that are still level the
    least row by its JSON. So rows that share a doc_id but not their text are told apart, and reruns keep the same rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fps], ["doc_id", "_doc", "fp"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("_doc", docs.schema), StructField("fp", LongType())])
    rows = cut(docs.select("doc_id", "text", whole).mapInArrow(run, schema), "simhash-rows")
    prints = rows.select("doc_id", "fp")
    roots = grouped(prints, pair_limit).select("fp", "root")
    counted = prints.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(roots, "fp")
    first = counted.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "fp", "n")).alias("m")).select(F.col("m.doc_id").alias("kept_id"), F.col("m.fp").alias("kept_fp"), "m.n")
    first = cut(first, "simhash-kept")
    on = (F.col("fp") == F.col("kept_fp")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    single = rows.join(first.where("n = 1"), on, "left_semi").select("_doc.*")
    level = rows.join(first.where("n > 1"), on, "left_semi").groupBy("doc_id", "fp").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*")
    return single.unionByName(level)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
