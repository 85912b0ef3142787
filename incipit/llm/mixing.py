"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` times all words; a target stops
at `most` times its source's size and the excess is shared anew by weight (water filling, solved in closed form).

Drawing: a document's key is an MD5, so key order is a random permutation of its source; ranges of keys are blocks of about
equal size. A source is taken whole as often as its target allows, and the rest is a prefix of its permutation: whole
blocks by block sums, documents only in the block where the target falls, then the largest document that still fits, three
times. Blocks of all passes then go to output shards: a binary tree over the shards splits every source's exact block
count by multivariate-hypergeometric draws, leaf quotas cut the source's permuted block list into disjoint pieces, and each
shard shuffles its rows by a hash.

Scale: only block sums are sorted by source (their number is bounded by `blocks` and the number of sources), documents are
sorted only within the one block where a target falls, and everything else is partial sums and joins on (source, block),
which split hot sources. Sources may be very many: their ranks come from ranges, the level of the water from a few sums over
all of them, and the tree splits chunks of `chunk` sources (first the chunks' totals, then each chunk by itself).

Edge cases: null text has size 0; null source is a source of its own; a source without words has target 0 and nothing is
taken; rows with the same doc_id and text are numbered, so they are drawn one by one; very long texts are only counted and
hashed; empty table: no rows; mix() keeps docs' columns, whatever their names; its own column `shard` (the name is a
parameter, None leaves it out) takes the place of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.scale import cut, small

WEIGHTS = (5, 2, 1)
SEED = 8


def sized(docs: DataFrame) -> DataFrame:
    """_doc (the row), source, size (words) and key (an MD5 of doc_id and text)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    return docs.select(whole, "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), key.alias("key"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows of sized(), written, with key made unique (a row's place in its source's permutation) and h, the key's first 32 bits.

    Of rows with one key the n-th (from 0) gets the MD5 of `key|n`: numbers count up by written part, then in the part, so even
    a key that very many rows share meets in no task.
    """
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "mix-keyed")
    twins = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "mix-twins")
    part = F.shiftright("at", 33)
    same_key = rows.select("key", "at").join(small(twins), "key").withColumn("part", part)
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")
    parts = same_key.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", before.alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy("at")) - 1
    renamed = same_key.join(parts, ["key", "part"]).withColumn("number", number).where("number > 0")
    renamed = small(cut(renamed.select("at", F.md5(F.concat_ws("|", "key", "number")).alias("new_key")), "mix-numbered"))
    rows = rows.join(renamed, "at", "left").withColumn("key", F.coalesce("new_key", "key")).drop("at", "new_key")
    return rows.withColumn("h", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes (a row per source) with k: the source's rank by code point, null last. Ranges are ranked apart, then shifted."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("k", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, from a row per source."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    rows = cut(ranked(sizes).withColumns({"w": w, "cap": F.col("source_size") * most}), "mix-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    # The level of the water: sources that it would fill beyond their cap stand at the cap, and it rises for the others.
    level, full = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w") if full >= 0 else F.lit(False)
        s = rows.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count_if(over)).first()
        if s[2] == full:
            break
        full = s[2]
        level = (total * share - s[0]) / s[1] if s[1] else float("inf")
    cap = F.col("cap").cast("double")
    return rows.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(level) * F.col("w"), cap)).alias("target"))


def plan(rows: DataFrame, shards: int, blocks: int, share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is drawn, from rows (source, size, key, h): sources (with the cut), extra documents, and the shards of each block."""
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    total = max(1, sizes.agg(F.sum("source_size")).first()[0] or 0)
    s = targets(sizes, share, most).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") * blocks / total)).cast("long"))
    goal = F.round("target").cast("long")
    s = s.withColumn("full", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("int")).withColumn("rest", goal - F.col("full") * F.col("source_size"))
    sources = cut(s.withColumnRenamed("source", "src"), "mix-sources")
    near = small(sources)
    placed = rows.join(near, same("source", "src")).withColumn("block", block_of())

    sums = cut(placed.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "mix-blocks")
    order = Window.partitionBy("src").orderBy("block")
    edge = cut(
        sums.withColumn("upto", F.sum("words").over(order)).where("upto > rest").groupBy("src").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("before"))).alias("e")).select(F.col("src").alias("edge_src"), F.col("e.block").alias("edge"), "e.before"), "mix-edge"
    )
    by_key = Window.partitionBy("src").orderBy("key")
    inside = (
        placed.join(small(edge), same("src", "edge_src") & (F.col("block") == F.col("edge")))
        .withColumn("upto", F.col("before") + F.sum("size").over(by_key))
        .where("upto <= rest")
        .groupBy("src")
        .agg(F.max(F.struct("key", "upto")).alias("last"))
        .select(F.col("src").alias("in_src"), "last.key", "last.upto")
    )
    # The cut: all keys of blocks before the edge, and keys up to the last one that fits inside it.
    cuts = edge.join(inside, same("edge_src", "in_src"), "left").select("edge_src", "edge", F.coalesce("key", F.lit("")).alias("last_key"), F.coalesce("upto", "before").alias("drawn"))
    sources = cut(sources.join(cuts, same("src", "edge_src"), "left").drop("edge_src").withColumn("gap", F.coalesce(F.col("rest") - F.col("drawn"), F.lit(0))), "mix-cuts")

    # The largest document that still fits, three times: of each size only the last three keys can be taken.
    loose = rows.join(small(sources), same("source", "src")).withColumn("block", block_of()).where(~in_prefix()).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    last = Window.partitionBy("source", "size").orderBy(F.desc("key"))
    fits = cut(loose.select("source", "size", "key", F.row_number().over(last).alias("r")).where("r <= 3").drop("r"), "mix-fits")
    now, extras = sources.select("src", "gap"), None
    for _ in range(3):
        left = fits if extras is None else fits.join(small(extras), same("source", "extra_src") & (F.col("key") == F.col("extra_key")), "left_anti")
        left = left.join(small(now), same("source", "src")).where(F.col("size") <= F.col("gap"))
        pick = cut(left.groupBy("source").agg(F.max(F.struct("size", "key")).alias("m")).select(F.col("source").alias("extra_src"), F.col("m.key").alias("extra_key"), F.col("m.size").alias("extra_size")), "mix-extra")
        now = cut(now.join(pick, same("src", "extra_src"), "left").select("src", (F.col("gap") - F.coalesce("extra_size", F.lit(0))).alias("gap")), "mix-gap")
        extras = pick.drop("extra_size") if extras is None else extras.unionByName(pick.drop("extra_size"))
    extras = cut(extras, "mix-extras")

    # Units: each block in each pass over its source in which some document of it is drawn.
    units = (
        drawn(rows, sources, extras).where("copies > 0").groupBy("source", "block").agg(F.max("copies").alias("copies")).select("source", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    )
    units = cut(units.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED), "epoch", "block"), "epoch", "block"))), "mix-units")
    places = cut(units.join(small(leaf_ranks(units, shards)), same("source", "leaf_source") & (F.col("rank") == F.col("leaf_rank"))).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("p")).select(F.col("source").alias("place_source"), F.col("block").alias("place_block"), F.col("p.shard").alias("by_epoch")), "mix-places")
    return sources, extras, places


def block_of() -> Column:
    return F.shiftright(F.col("h") * F.col("n_blocks"), 32)


def in_prefix() -> Column:
    """Whether a document (with its block) lies in its source's drawn prefix."""
    return F.coalesce((F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & (F.col("key") <= F.col("last_key"))), F.lit(False))


def drawn(rows: DataFrame, sources: DataFrame, extras: DataFrame) -> DataFrame:
    """rows with source_size, target, block and copies."""
    at = rows.join(small(sources), same("source", "src")).withColumn("block", block_of())
    at = at.join(small(extras), same("source", "extra_src") & (F.col("key") == F.col("extra_key")), "left")
    copies = F.when(F.col("size") > 0, F.col("full") + (in_prefix() & (F.col("rest") > 0) | F.col("extra_key").isNotNull()).cast("int")).otherwise(0)
    return at.withColumn("copies", copies).drop("src", "extra_src", "extra_key", "full", "rest", "edge", "last_key", "drawn", "gap", "n_blocks")


def hypergeometric(total: Column, marked: Column, n: Column, u: Column) -> Column:
    """How many marked among n drawn of total, at quantile u: the distribution by its term ratio, 12 deviations around its mode."""
    total, marked, n = (c.cast("double") for c in (total, marked, n))
    mode = F.floor((n + 1) * (marked + 1) / (total + 2)).cast("long")
    sd = F.sqrt(F.greatest(n * marked / F.greatest(total, F.lit(1.0)) * (1 - marked / F.greatest(total, F.lit(1.0))) * (total - n) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0)))
    reach = (F.ceil(sd * 12) + 4).cast("long")
    low = F.greatest(mode - reach, (n - (total - marked)).cast("long"), F.lit(0).cast("long"))
    high = F.greatest(low, F.least(mode + reach, marked.cast("long"), n.cast("long")))

    def let(values: list[Column], f):
        return F.get(F.transform(F.array(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])), f), F.lit(0))

    def draw(v: Column) -> Column:
        total, marked, n, u, low, high = (v[f"v{k}"] for k in range(6))
        steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

        def ratio(x: Column) -> Column:
            return (marked - x) * (n - x) / ((x + 1) * (total - marked - n + x + 1))

        zero = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
        whole = F.aggregate(steps, zero, lambda a, x: F.struct((a["p"] * ratio(x)).alias("p"), (a["sum"] + a["p"] * ratio(x)).alias("sum")), lambda a: a["sum"])

        def found(w: Column) -> Column:
            need = u * w["v0"]
            start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), low.alias("x"))
            walk = F.aggregate(steps, start, lambda a, x: F.struct((a["p"] * ratio(x)).alias("p"), (a["sum"] + a["p"] * ratio(x)).alias("sum"), F.when(a["sum"] < need, x + 1).otherwise(a["x"]).alias("x")), lambda a: a["x"])
            return walk

        return let([whole], found)

    return let([total, marked, n, u, low, high], draw)


def split(rows: DataFrame, shards: int) -> DataFrame:
    """The tree: rows (id, names, quotas, by_shard) to leaves (shard, names, quotas).

    A node holds the shards from lo to hi. Of its units as many go left as by_shard has there; a quota's part of them is drawn
    hypergeometrically, given what the quotas before it drew.
    """
    node = rows.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    inner = F.col("hi") - F.col("lo") > 1
    plus = lambda a, x: a + x
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        n_left = F.aggregate(F.slice("by_shard", F.col("lo") + 1, F.col("mid") - F.col("lo")), F.lit(0).cast("long"), plus)
        start = F.struct(F.aggregate("quotas", F.lit(0).cast("long"), plus).alias("total"), n_left.alias("n"), F.array().cast("array<bigint>").alias("left"))

        def step(a: Column, x: Column) -> Column:
            u = (F.xxhash64(F.lit(SEED), F.col("id"), F.col("lo"), F.col("hi"), F.size(a["left"])).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
            return F.get(F.transform(F.array(hypergeometric(a["total"], x, a["n"], u)), lambda g: F.struct((a["total"] - x).alias("total"), (a["n"] - g).alias("n"), F.concat(a["left"], F.array(g)).alias("left"))), F.lit(0))

        node = node.withColumn("mid", mid).withColumn("left", F.when(inner, F.aggregate("quotas", start, step, lambda a: a["left"])))
        halves = F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("quotas")), F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        node = node.select("id", "names", "by_shard", F.explode(F.when(inner, halves).otherwise(F.array(F.struct("lo", "hi", "quotas")))).alias("h")).select("id", "names", "by_shard", "h.*")
    return node.select("id", F.col("lo").alias("shard"), "names", "quotas")


def leaf_ranks(units: DataFrame, shards: int, chunk: int = 1024) -> DataFrame:
    """leaf_source, leaf_rank, shard: which of a source's permuted blocks go to which shard, by the splitting tree."""
    counts = cut(units.groupBy("source").agg(F.count("*").alias("n")), "mix-counts")
    n_sources, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    chunks = max(1, -(-n_sources // chunk))
    grouped = counts.groupBy(F.pmod(F.xxhash64("source"), F.lit(chunks)).alias("id")).agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all"), F.sum("n").alias("n"))
    even = F.array(*[F.lit(total * (s + 1) // shards - total * s // shards).cast("long") for s in range(shards)])
    rows = grouped.select("id", F.col("all.source").alias("names"), F.col("all.n").alias("quotas"))
    if chunks == 1:
        rows = rows.withColumn("by_shard", even)
    else:  # a row of chunk totals first
        top = grouped.agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("all")).select(F.lit(-1).cast("long").alias("id"), F.col("all.id").alias("names"), F.col("all.n").alias("quotas"), even.alias("by_shard"))
        leaves = split(top, shards).select("shard", F.explode(F.arrays_zip("names", "quotas")).alias("q"))
        by_shard = leaves.groupBy(F.col("q.names").alias("id")).agg(F.array_sort(F.collect_list(F.struct("shard", F.col("q.quotas").alias("n")))).alias("s")).select("id", F.col("s.n").alias("by_shard"))
        rows = rows.join(cut(by_shard, "mix-chunks"), "id")
    leaves = cut(split(rows, shards).select("shard", F.explode(F.arrays_zip("names", "quotas")).alias("q")).select("shard", F.col("q.names").alias("leaf_source"), F.col("q.quotas").alias("quota")), "mix-leaves")
    upto = F.sum("quota").over(Window.partitionBy("leaf_source").orderBy("shard"))
    return cut(leaves.withColumn("upto", upto).where("quota > 0").select("leaf_source", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("leaf_rank")), "mix-ranks")


def placed_copies(rows: DataFrame, sources: DataFrame, extras: DataFrame, places: DataFrame) -> DataFrame:
    """rows with source_size, target and shards: one entry for each copy the mix takes, the shard it goes to."""
    at = drawn(rows, sources, extras).join(small(places), same("source", "place_source") & (F.col("block") == F.col("place_block")), "left")
    return at.withColumn("shards", F.coalesce(F.slice("by_epoch", 1, F.greatest("copies", F.lit(0))), F.array().cast("array<int>"))).drop("place_source", "place_block", "by_epoch", "copies")


def mix(docs: DataFrame, shards: int = 64, blocks_per_shard: int = 64, share: float = 1.5, most: int = 2, shard_as: str | None = "shard") -> DataFrame:
    """The mix itself: a row for each copy taken, with docs' columns and its shard; rows of a shard together, in shuffled order."""
    rows = keyed(sized(docs))
    found = plan(rows.drop("_doc"), shards, shards * blocks_per_shard, share, most)
    copies = placed_copies(rows, *found).select("_doc", "key", F.posexplode("shards").alias("epoch", "shard"))
    copies = copies.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(SEED), "shard", "epoch", "key"), "epoch", "key")
    own = [F.col("shard").alias(shard_as)] if shard_as else []
    return copies.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c != shard_as], *own)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = keyed(sized(docs.select("doc_id", "text", "source")).withColumn("_doc", F.struct("_doc.doc_id")))
    out = placed_copies(rows, *plan(rows.drop("_doc"), 64, 64 * 64))
    return out.select("_doc.doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"))


def oracle() -> str:
    extra = ""
    for k in (1, 2, 3):
        extra += f"""
    pick{k} as (select source, arg_max(key, (size, key)) as key, max(size) as size from (select l.* from loose{k} l) group by source),
    loose{k + 1} as (select l.source, l.key, l.size, l.gap - p.size as gap from loose{k} l join pick{k} p on l.source is not distinct from p.source
      where l.key <> p.key and l.size <= l.gap - p.size),"""
    cases = " ".join(f"when {k} then {w}" for k, w in enumerate(WEIGHTS))
    return f"""
    with recursive t as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
    d1 as (select rid, doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::bigint as size,
      md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || md5(text)) as key from t),
    d2 as (select *, row_number() over (partition by key order by rid) - 1 as number from d1),
    d as (select rid, doc_id, source, size, case when number = 0 then key else md5(key || '|' || number) end as key from d2),
    s0 as (select source, sum(size)::bigint as source_size from d group by source),
    s1 as (select *, row_number() over (order by source nulls last) - 1 as k from s0),
    s2 as (select *, (case k % {len(WEIGHTS)} {cases} end)::double as w, source_size * 2 as cap from s1),
    s3 as (select *, sum(source_size) over () as total, sum(cap) over (order by cap / w, k) - cap as before, sum(w) over () - sum(w) over (order by cap / w, k) + w as lft from s2),
    s4 as (select *, (total * 1.5::double - before) / lft as level from s3),
    s5 as (select *, (select arg_min(b.level * 1, b.cap / b.w) from s4 b where b.level * b.w <= b.cap) as lv from s4 a),
    s6 as (select source, source_size, case when source_size = 0 then 0 else least(coalesce(lv * w, cap::double), cap::double) end as target from s5),
    s as (select *, case when source_size > 0 then floor(round(target) / source_size) else 0 end::bigint as fl,
      round(target)::bigint - (case when source_size > 0 then floor(round(target) / source_size) else 0 end)::bigint * source_size as rest from s6),
    c as (select d.*, s.source_size, s.target, s.fl, s.rest, sum(size) over (partition by d.source order by key) as upto
      from d join s on d.source is not distinct from s.source),
    gaps as (select source, any_value(rest) - coalesce(max(upto) filter (where upto <= rest), 0) as gap from c group by source),
    loose1 as (select distinct c.source, key, size, gap from c join gaps g on c.source is not distinct from g.source where upto > rest and size > 0 and size <= gap),
    {extra.strip()}
    picks as (select source, key from pick1 union all select source, key from pick2 union all select source, key from pick3)
    select doc_id, size, source_size, target,
      case when size = 0 then 0 else size * (fl + case when (rest > 0 and upto <= rest) or exists(select 1 from picks p where p.source is not distinct from c.source and p.key = c.key) then 1 else 0 end) end::bigint as taken
    from c"""
