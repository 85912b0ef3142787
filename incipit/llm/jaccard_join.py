"""N-gram Jaccard join by parity sketches: sets of word shingles are hashed to bit sketches, joined by pigeonhole, verified.

A sketch is a sparse string of bits in parts. Each shingle flips one bit, so the Hamming distance of two sketches is at most the symmetric
difference of their sets. Sizes fall in bands whose bounds grow by a half: linked sets lie in one band or in neighbouring
ones, so a set is filed in its own band's space, and in the next one's if it is large enough to link with sets there. Where
sets of a space link, their symmetric difference is at most D (from the threshold and the band's upper size), and with
D + 1 + Z parts at least Z + 1 parts agree in all bits. Parts without any bit say little and would meet in large groups: a
set with at most Z of them leaves them out, since some other part must then agree; only sets with more of them file them too.

Work is on distinct sequences of words (copies are one class). In each key all classes are first compared with one of them; what that
links is one component and needs no more pairs, so a family of near copies costs about a pair for each member. Where classes
of different components are left in a key, those of up to `pair_limit` classes are paired between components. Crowded ones (a
passage that many texts share) are compared by their rarest shingles instead: two linked sets share one of the first
n - ceil(t n) + 1 of each, in the order of document frequency. Groups by rare shingle are treated alike, and what is still
crowded and of several components is paired between them, once a pair and only where it could link: a set shares none of
the shingles that no other of the compared sets has, which rules out most pairs of near copies of near copies. Every pair is first held to the Hamming distance of two dense
sketches of some bits for each difference that is allowed, and what is left is verified by exact intersection. No link is
lost on any way.

Sets are made again from the texts for the classes that are compared, and only for those; up to `known_rows` of them reach
the scan as a broadcast of checked size, beyond that by a shuffle.

Edge cases: null or wordless text has the empty set and is linked with nothing, also not with its like; fewer words than a
shingle give one of all words; very long texts are hashed whole; repeated rows each get their row; null doc_id is no
component's name unless nothing else is in it; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.llm.components import components
from incipit.scale import arrow_rows, cut, small

SEED = 11
#: A part of a sketch has two to the power of this many bits; few are set, and only those are worked on.
PART_BITS = 20
#: Rows of a batch for Python: whole texts, and pairs with both their sets.
BATCH = 500


@dataclass(frozen=True)
class Rule:
    """Links sets whose intersection is at least num / den of their union; shingles have `words` words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def most_apart(self, sizes: int) -> int:
        """The largest symmetric difference of linked sets whose sizes add up to this."""
        return (self.den - self.num) * sizes // (self.den + self.num)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiplications and shifts)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers, one for each place in a shingle (fractions of the square roots of 2, 3, 5 and 7; more are made from them).
PLACES = (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)


class Words(dict):
    """Hashes of the words met so far."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h

    def bounded(self) -> Words:
        if len(self) > 150_000:
            self.clear()
        return self


def shingle_set(text: str | None, words: int, known: Words | None = None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    known = Words() if known is None else known.bounded()
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    h = np.full(n, min(len(found), words), np.uint64)
    for k in range(min(words, len(found))):  # the place of a word counts
        h += each[k : k + n] * np.uint64(PLACES[k % 4] + 2 * (k // 4))
    return np.unique(mixed(h))


class Bands:
    """Size bands up to a size that is met: bounds, and each space's number of parts and of bitless parts left out."""

    def __init__(self, rule: Rule):
        self.rule, self.starts = rule, [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            # Half as large again, and never so little that sets two bands apart could link.
            self.starts.append(max(self.starts[-1] * 3 // 2, self.starts[-1] * self.rule.den // self.rule.num) + 1)
        return bisect_right(self.starts, n) - 1

    def spaces(self, n: int) -> list[int]:
        own = self.of(n)
        self.of(self.starts[own + 1] + 1)  # so that the next one's bound is known
        while len(self.starts) < own + 3:
            self.of(self.starts[-1])
        return [own, own + 1] if self.rule.den * n >= self.rule.num * self.starts[own + 1] else [own]

    def dense(self, space: int) -> int:
        """Bits of a dense sketch."""
        return 8 * (self.rule.most_apart(2 * (self.starts[space + 1] - 1)) + 8)

    def parts(self, space: int) -> tuple[int, int]:
        """Parts and Z."""
        differ = self.rule.most_apart(2 * (self.starts[space + 1] - 1))
        spare = int(0.03 * differ + 2 * (0.03 * differ) ** 0.5)
        return differ + 1 + spare, spare


def bits(h: np.ndarray, parts: int) -> np.ndarray:
    """The bit of the sketch that each hash flips; the upper figures are the part's number."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)) << np.uint64(PART_BITS) | h & np.uint64((1 << PART_BITS) - 1)


def sketch(h: np.ndarray, parts: int) -> np.ndarray:
    """The parity sketch as the sorted numbers of its set bits: those that an odd number of hashes flip."""
    at, n = np.unique(bits(h, parts), return_counts=True)
    return at[n % 2 == 1]


def packed(h: np.ndarray, n_bits: int) -> bytes:
    """A dense parity sketch of n_bits bits."""
    at = ((h >> np.uint64(32)) * np.uint64(n_bits)) >> np.uint64(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=n_bits) % 2 == 1).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The Hamming distance of two packed sketches of one length: at most the symmetric difference of their sets."""
    return int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())


def keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """A 64-bit key for each filed part, in the spaces of the set.

    It is the exclusive or of a hash of each flipped bit: bits flipped twice cancel, so equal parts have equal keys.
    """
    out = []
    for space in bands.spaces(len(h)) if len(h) else ():
        parts, spare = bands.parts(space)
        flipped = bits(h, parts)
        part, hashed = (flipped >> np.uint64(PART_BITS)).astype(np.int64), mixed(flipped + np.uint64(1))
        found = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(found, part, hashed)
        at = np.arange(parts) if (found == 0).sum() > spare else np.flatnonzero(found)
        out.append(mixed(found[at] ^ mixed(np.uint64(space << 32) + at.astype(np.uint64))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def digest(text: str | None) -> bytes | None:
    """Of the sequence of words, null for none."""
    found = (text or "").encode("utf-8").lower().split()
    return hashlib.blake2b(b" ".join(found), digest_size=16).digest() if found else None


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(t.as_py()) for t in batch.column(1)], pa.binary())], ["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary")


def texts_of(docs: DataFrame, classes: DataFrame, known_rows: int = 300_000) -> DataFrame:
    """c, digest, text: the rows of the classes' doc_ids (c, digest, least, rows). Those of other words, which repeat a doc_id, are
    told by their digest; where several rows have the class's words, one of them comes with a null digest."""
    asked = small(cut(classes.select(F.col("least").alias("_least"), "c", "digest", "rows"), "jaccard-asked"), known_rows)
    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k in range(batch.num_rows) if digest(batch.column(2)[k].as_py()) == batch.column(1)[k].as_py()]
            yield batch.take(pa.array(keep, pa.int64())).select(["c", "text"])

    once = texts.where("rows = 1").select("c", "digest", "text")
    if asked.where("rows > 1").isEmpty():
        return once
    again = texts.where("rows > 1").select("c", "digest", "text").mapInArrow(run, "c long, text string").groupBy("c").agg(F.min("text").alias("text"))
    return once.unionByName(again.select("c", F.lit(None).cast("binary").alias("digest"), "text"))


def sets_of(docs: DataFrame, classes: DataFrame, rule: Rule, filed: bool = False) -> DataFrame:
    """c, h (the sorted hashes, packed) of the classes, from the texts; or, to be filed, c, n, keys, and dense sketches in the
    set's own space and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = Words(), Bands(rule)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                digests, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                keep = [k for k, d in enumerate(digests) if d is None or digest(texts[k]) == d]
                sets = [shingle_set(texts[k], rule.words, known) for k in keep]
                c = part.column(0).take(pa.array(keep, pa.int64()))
                if filed:
                    found = [keys(h, bands) for h in sets]
                    offsets = np.concatenate([[0], np.cumsum([len(k) for k in found])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
                    own = [bands.spaces(len(h))[0] for h in sets]
                    dense = [pa.array([packed(h, bands.dense(k + d)) for h, k in zip(sets, own, strict=True)], pa.binary()) for d in (0, 1)]
                    yield pa.RecordBatch.from_arrays([c, pa.array([len(h) for h in sets], pa.int64()), lists, *dense], ["c", "n", "keys", "own", "next"])
                else:
                    yield pa.RecordBatch.from_arrays([c, pa.array([h.tobytes() for h in sets], pa.binary())], ["c", "h"])

    return texts_of(docs, classes).mapInArrow(run, "c long, n long, keys array<long>, own binary, next binary" if filed else "c long, h binary")


def near(pairs: DataFrame, filed: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) whose sizes and dense sketches let them link."""
    side = lambda c: filed.select(F.col("c").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "own", "next")])
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "own_u", "own_v", "next_u", "next_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(rule)
        for batch in batches:
            keep = []
            n_u, n_v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, (a, b) in enumerate(zip(n_u, n_v, strict=True)):
                if rule.linked(a, b, min(a, b)):
                    up = bands.of(a) - bands.of(b)  # linked sizes lie at most one band apart
                    x, y = batch.column(4 if up >= 0 else 6)[k].as_py(), batch.column(5 if up <= 0 else 7)[k].as_py()
                    if apart(x, y) <= rule.most_apart(a + b):
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, filed: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) of classes that link: by sketches, then by exact intersection."""
    pairs = cut(near(pairs, filed, rule), "jaccard-pairs")
    met = pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c"))).distinct()
    sets = cut(sets_of(docs, classes.join(met, "c"), rule), "jaccard-sets")
    both = pairs.join(sets.select(F.col("c").alias("u"), F.col("h").alias("hu")), "u").join(sets.select(F.col("c").alias("v"), F.col("h").alias("hv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(j)[k].as_buffer(), np.uint64) for j in (2, 3))
                if rule.linked(len(a), len(b), min(len(a), len(b))) and rule.linked(len(a), len(b), np.intersect1d(a, b, assume_unique=True).size):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1)], ["u", "v"])

    return cut(both.select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long"), "jaccard-edges")


def several(groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The groups (key, c) that meet more than one component: key, c, root, and the group's size n and its middle, `least`: the
    class that is least `away`, where groups have that, else the smallest."""
    away = [c for c in groups.columns if c == "away"]
    groups = groups.select("key", "c", *away)
    groups = groups.withColumn("root", F.col("c")) if roots is None else groups.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    middle = F.min(F.struct("away", "c"))["c"] if away else F.min("c")
    sizes = groups.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), middle.alias("least"))
    return groups.join(sizes.where("r0 <> r1").select("key", "n", "least"), "key")


def stars(groups: DataFrame) -> DataFrame:
    """Each class of a group with the group's middle."""
    return groups.where("c <> least").select(F.col("least").alias("u"), F.col("c").alias("v")).distinct()


def across(groups: DataFrame) -> DataFrame:
    """Pairs of classes of a group that lie in different components."""
    a, b = groups.select("key", F.col("c").alias("u"), F.col("root").alias("ru")), groups.select("key", F.col("c").alias("v"), F.col("root").alias("rv"))
    return a.join(b, "key").where("u < v AND ru <> rv").select("u", "v").distinct()


def by_rare_shingles(docs: DataFrame, classes: DataFrame, crowded: DataFrame, rule: Rule) -> DataFrame:
    """key (a shingle's hash), c: the shingles among each class's rarest of which linked sets must share one; with n, the size of
    the set, and shared, how many of its shingles any other of these sets has."""
    sets = sets_of(docs, classes.join(crowded.select("c").distinct(), "c"), rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), v, np.int64)) for v in (batch.column(0)[k].as_py(), len(h))] + [pa.array(h)], ["c", "n", "key"])

    tokens = cut(sets.mapInArrow(run, "c long, n long, key long"), "jaccard-shingles")
    shared = tokens.join(tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "key")
    # Shingles of one set only are the rarest, and meet nothing: they are counted as places before the shared ones.
    of_set = Window.partitionBy("c")
    shared = shared.withColumns({"shared": F.count("*").over(of_set), "place": F.row_number().over(of_set.orderBy("df", "key"))})
    most = F.col("n") - F.ceil(F.col("n") * rule.num / rule.den) + 1
    return shared.where(F.col("place") + F.col("n") - F.col("shared") <= most).select("key", "c", "n", "shared")


def across_rare(groups: DataFrame, rare: DataFrame, rule: Rule) -> DataFrame:
    """across() for groups by rare shingle: a pair comes once, from the first shingle both have, and only if what others share of it
    would be enough."""
    facts = rare.groupBy("c").agg(F.first("n").alias("n"), F.first("shared").alias("s"), F.array_sort(F.collect_list("key")).alias("keys"))  # a class's rarest shingles
    rows = groups.select("key", "c", "root").join(facts, "c")
    a, b = (rows.select("key", F.col("c").alias(x), *[F.col(f).alias(f"{f}_{x}") for f in ("root", "n", "s", "keys")]) for x in ("u", "v"))
    both, sizes = F.least("s_u", "s_v"), F.col("n_u") + F.col("n_v")
    could = (F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & (rule.den * both >= rule.num * (sizes - both))
    first = F.array_min(F.array_intersect("keys_u", "keys_v")) == a["key"]
    return a.join(b, (a["key"] == b["key"]) & could & first).select("u", "v")


def linked_components(docs: DataFrame, classes: DataFrame, filed: DataFrame, rule: Rule, pair_limit: int) -> DataFrame:
    """node, root for the linked classes; classes as texts_of() takes them, filed is what sets_of() files of them."""
    each = filed.select("c", F.explode("keys").alias("key"))
    groups = cut(each.join(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key"), "jaccard-keys")
    edges = verified(stars(several(groups)), docs, classes, filed, rule)
    roots = cut(components(edges), "jaccard-roots")
    groups = cut(several(groups, roots), "jaccard-several")
    if groups.isEmpty():
        return roots
    crowded, pairs = groups.where(F.col("n") > pair_limit), across(groups.where(F.col("n") <= pair_limit))
    shingles = cut(by_rare_shingles(docs, classes, crowded, rule), "jaccard-rarest")
    # Of near copies of one text, the one with the fewest shingles of its own is nearest to all others: stars go from there.
    away = ((F.col("n") - F.col("shared")) / F.col("n")).alias("away")
    rare = cut(several(shingles.select("key", "c", away), roots), "jaccard-rare")
    pairs = pairs.unionByName(across(rare.where(F.col("n") <= pair_limit))).unionByName(stars(rare.where(F.col("n") > pair_limit))).distinct()
    edges = edges.unionByName(verified(pairs, docs, classes, filed, rule))
    roots = cut(components(edges), "jaccard-roots")
    rare = cut(several(rare.where(F.col("n") > pair_limit).select("key", "c", "away"), roots), "jaccard-rest")
    if rare.isEmpty():
        return roots
    return components(edges.unionByName(verified(across_rare(rare, shingles, rule), docs, classes, filed, rule)))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), pair_limit: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _components(docs, rule, pair_limit)


def _components(docs: DataFrame, rule: Rule, pair_limit: int) -> DataFrame:
    """jaccard_components(); all Python work is done when it returns."""
    prints = cut(digests(docs), "jaccard-digests")
    counted = prints.where("digest IS NOT NULL").groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "rows")).alias("m")  # the smallest doc_id, null last
    classes = counted.groupBy("digest").agg(first).select(F.monotonically_increasing_id().alias("c"), "digest", F.col("m.doc_id").alias("least"), F.col("m.rows").alias("rows"))
    classes = cut(classes, "jaccard-classes")
    filed = cut(sets_of(docs, classes, rule, filed=True), "jaccard-filed")
    roots = linked_components(docs, classes, filed, rule, pair_limit).withColumnRenamed("node", "c")
    named = classes.join(filed.select("c", "n"), "c").join(roots, "c", "left").select("digest", "least", "n", F.coalesce("root", "c").alias("root"))
    named = cut(named, "jaccard-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_words = named.join(least, "root").select("digest", F.col("n").alias("n_shingles"), "component_id")
    found = prints.where("digest IS NOT NULL").join(by_words, "digest").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(prints.where("digest IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
