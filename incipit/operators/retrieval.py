"""Chunks, an inverted index with BM25 ranking, and evidence found in ranked units.

Without an index, one narrow pass makes a row of counted tokens for each document, which lengths and hits are read from; a
kept index is a postings table in buckets with bounds for each token, of which a query reads its own buckets. Gold evidence meets units through an equi-join on word trigrams, never by pairing every question with every unit. Tokens that very many
documents hold are dropped as stopwords; adaptive execution splits what is left of the skew, and sums are partial before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.scale import cut, small

CHUNK_WORDS = 200
K1, B = 1.5, 0.75
RANKED = 40
CUTS = (1, 3, 5, 10)
WORD_BUDGETS = (250, 500, 1000, 2000)
THRESHOLD, THRESHOLDS = 0.6, (0.4, 0.6, 0.8)


# ------------------------------------------------------------------- chunks


def _packed(parts: Column, target: int, glue: str) -> Column:
    """Greedy packing of strings into groups of at most target words (a longer string is alone in its group)."""
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), tx.n_words(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (a["n"] + p["n"] > target)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(a["now"], glue)))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(p["text"])).otherwise(F.concat(a["now"], F.array(p["text"]))).alias("now"),
            (F.when(full, 0).otherwise(a["n"]) + p["n"]).alias("n"),
        )

    return F.aggregate(counted, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], glue)))).otherwise(a["done"]))


def split_long(piece: Column, target: int) -> Column:
    """A piece of more than target words, cut at sentences."""
    return F.when(tx.n_words(piece) <= target, F.array(piece)).otherwise(_packed(F.split(piece, tx.SENTENCE_GAP), target, " "))


def chunk_pieces(pieces: Column, target: int = CHUNK_WORDS) -> Column:
    """Pieces (paragraphs, code) packed into chunks of about target words."""
    return _packed(F.flatten(F.transform(pieces, lambda p: split_long(p, target))), target, "\n\n")


def markdown_pieces(markdown: Column | str) -> Column:
    """Blank-line separated parts; a fenced listing with blank lines is one part."""
    parts = F.split(tx.col(markdown), r"\n\s*\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("fence"))
    fences = lambda p: F.regexp_count(p, F.lit("```"))

    def step(a: Column, p: Column) -> Column:
        inside = F.size(a["fence"]) > 0
        more = F.concat(a["fence"], F.array(p))
        closes = inside & F.rtrim(F.regexp_replace(p, r"\s+$", "")).endswith("```")
        opens = ~inside & p.rlike(r"^\s*```") & (fences(p) % 2 == 1)
        trimmed = F.regexp_replace(p, r"^\s+|\s+$", "")
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(closes, F.concat(a["done"], F.array(F.array_join(more, "\n\n")))).when(~inside & ~opens & (trimmed != ""), F.concat(a["done"], F.array(trimmed))).otherwise(a["done"]).alias("done"),
            F.when(closes, none).when(inside, more).when(opens, F.array(p)).otherwise(none).alias("fence"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["fence"]) > 0, F.concat(a["done"], F.array(F.array_join(a["fence"], "\n\n")))).otherwise(a["done"]))


def chunk_sections(sections: DataFrame, target: int = CHUNK_WORDS) -> DataFrame:
    """chapter, section, uid, text, words; sections has chapter, section (title or ""), pieces (array, title not included)."""
    titled = F.when(F.col("section") != "", F.concat(F.array("section"), F.filter("pieces", lambda p: F.trim(p) != ""))).otherwise(F.filter("pieces", lambda p: F.trim(p) != ""))
    rows = sections.select("chapter", "section", F.posexplode(chunk_pieces(titled, target)).alias("i", "text"))
    label = F.when(F.col("section") == "", "intro").otherwise(F.col("section"))
    return rows.select("chapter", "section", "i", F.concat_ws("/", "chapter", label, "i").alias("uid"), "text", tx.n_words("text").alias("words"))


def chunk_markdown(files: DataFrame, target: int = CHUNK_WORDS) -> DataFrame:
    """The same for reference files (chapter, markdown), packed across headings."""
    rows = files.select("chapter", F.posexplode(chunk_pieces(markdown_pieces("markdown"), target)).alias("i", "text"))
    return rows.select("chapter", F.lit("").alias("section"), "i", F.concat_ws("/", "chapter", "i").alias("uid"), "text", tx.n_words("text").alias("words"))


def whole_files(files: DataFrame) -> DataFrame:
    return files.select("chapter", F.lit("").alias("section"), F.lit(0).alias("i"), F.concat("chapter", F.lit("/file")).alias("uid"), F.col("markdown").alias("text"), tx.n_words("markdown").alias("words"))


# --------------------------------------------------------------------- BM25


def term_rows(docs: DataFrame) -> DataFrame:
    """doc, len, terms (array of tok and tf), in one narrow pass: sorted tokens are cut where a new one begins."""
    rows = docs.select("doc", F.sort_array(F.coalesce(tx.tokenize("text"), F.array().cast("array<string>"))).alias("s"))
    begins = F.filter(F.transform("s", lambda t, k: F.when((k == 0) | (t != F.get("s", k - 1)), k)), lambda k: k.isNotNull())
    term = lambda at: lambda k, j: F.struct(F.get("s", k).alias("tok"), (F.coalesce(F.get(at, j + 1), F.size("s")) - k).cast("long").alias("tf"))
    return rows.select("doc", F.size("s").alias("len"), tx.let(begins, lambda at: F.transform(at, term(at))).alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """doc, tok, tf, len. Documents without tokens have one row with a null token, so that counts and the mean length hold them."""
    return term_rows(docs).select("doc", F.explode_outer("terms").alias("t"), "len").select("doc", "t.tok", F.coalesce("t.tf", F.lit(0).cast("long")).alias("tf"), "len")


def weighed(tf: Column, length: Column, average: float, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def bm25_scores(queries: DataFrame, docs: DataFrame | None, k1: float = K1, b: float = B, index: DataFrame | None = None) -> DataFrame:
    """qid, doc, score for every document with a query token, from docs (doc, text) or from a kept postings table."""
    asked = queries.select("qid", F.explode(tx.tokenize("query")).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qf"))
    asked = small(cut(asked, "bm25-queries"))
    words = small(cut(asked.select("tok").distinct(), "bm25-words"))
    if index is None:
        rows = cut(term_rows(docs), "bm25-terms")
        lengths = rows.select("len")
        hit = lambda rows: rows.select("doc", "len", F.explode("terms").alias("t")).select("doc", "len", "t.tok", "t.tf")
    else:
        rows, hit = cut(index.join(words, "tok", "left_semi"), "bm25-hits"), lambda rows: rows
        lengths = index.groupBy("doc").agg(F.first("len").alias("len"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    n, avg = totals.n, totals.avg or 1.0
    idf = hit(rows).join(words, "tok").groupBy("tok").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df")
    weights = small(cut(asked.join(idf, "tok").select("tok", "qid", (F.col("qf") * F.col("idf")).alias("factor")), "bm25-weights"))
    part = F.col("factor") * weighed(F.col("tf"), F.col("len"), avg, k1, b)
    # Rows are dealt by document before they meet the questions, so the sums need no shuffle of a row a question and document.
    return hit(rows.repartition("doc")).join(weights, "tok").groupBy("qid", "doc").agg(F.sum(part).alias("score"))


def bm25_topk(queries: DataFrame, docs: DataFrame | None, k: int = 10, k1: float = K1, b: float = B, index: DataFrame | None = None) -> DataFrame:
    """qid, rank, doc, score; queries (qid, query), docs (doc, text), doc unique; ties (to 9 digits) go to the smaller doc."""
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc")
    return bm25_scores(queries, docs, k1, b, index).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "doc", "score")


def kept_index(docs: DataFrame, path: str, buckets: int = 64, k1: float = K1, b: float = B) -> None:
    """Write an index of docs (doc, text): postings by bucket of the token (tok, doc, weight), words (tok, idf, most: the largest
    weight), so that a search reads the buckets of its own words and knows what each of them can add at most."""
    rows = cut(term_rows(docs), "index-terms")
    totals = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    n, avg = totals.n, totals.avg or 1.0
    posts = rows.select("doc", "len", F.explode("terms").alias("t")).select("t.tok", "doc", weighed(F.col("t.tf"), F.col("len"), avg, k1, b).alias("weight"))
    bucket = F.pmod(F.xxhash64("tok"), F.lit(buckets)).cast("int")
    # A word that very many documents have is dealt over several tasks by its documents.
    posts.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(4))).sortWithinPartitions("bucket", "tok").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = rows.sparkSession.read.parquet(f"{path}/postings")
    words = written.groupBy("tok", "bucket").agg(F.count("*").alias("df"), F.max("weight").alias("most"))
    words.select("tok", "bucket", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "most").write.mode("overwrite").parquet(f"{path}/words")


def indexed_topk(queries: DataFrame, path: str, k: int = 10) -> DataFrame:
    """bm25_topk from a kept index, without scoring documents that cannot be among the k best.

    A query's words are taken by what they add at most, largest first. The k-th best score of documents by the words that add
    most bounds the k-th best of all from below. Words whose largest sums together stay beneath it cannot bring a document
    in by themselves: only documents of the other words are candidates, and the rest is added up for those alone.
    """
    spark = queries.sparkSession
    asked = cut(queries.select("qid", F.explode(tx.tokenize("query")).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qf")), "search-queries")
    words = spark.read.parquet(f"{path}/words").join(small(asked), "tok").select("qid", "tok", "bucket", (F.col("qf") * F.col("idf")).alias("factor"), (F.col("qf") * F.col("idf") * F.col("most")).alias("most"))
    down = Window.partitionBy("qid").orderBy(F.desc("most"), "tok")
    rest = F.sum("most").over(down.rowsBetween(1, Window.unboundedFollowing))
    words = cut(words.withColumns({"place": F.row_number().over(down), "rest": F.coalesce(rest, F.lit(0.0))}), "search-words")
    stored = spark.read.parquet(f"{path}/postings")

    def scored(some: DataFrame) -> DataFrame:
        buckets = [r.bucket for r in some.select("bucket").distinct().collect()]  # at most as many as the index has
        hits = stored.where(F.col("bucket").isin(buckets)).join(small(some.select("qid", "tok", "factor")), "tok")
        return hits.groupBy("qid", "doc").agg(F.sum(F.col("factor") * F.col("weight")).alias("score"))

    best = Window.partitionBy("qid").orderBy(F.desc("score"))
    floor = scored(words.where("place <= 2")).withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("qid", F.col("score").alias("floor"))
    # Scores are sums in any order: a little slack keeps documents that tie with the k-th.
    words = cut(words.join(floor, "qid", "left").withColumn("brings", F.coalesce(F.col("rest") + F.col("most") >= F.col("floor") - 1e-6, F.lit(True))), "search-bounds")
    first = cut(scored(words.where("brings")), "search-first")
    late = words.where("NOT brings")
    candidates = first.join(floor, "qid", "left").join(late.groupBy("qid").agg(F.sum("most").alias("more")), "qid", "left")
    candidates = cut(candidates.where(F.coalesce(F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.col("floor") - 1e-6, F.lit(True))).select("qid", "doc", "score"), "search-candidates")
    buckets = [r.bucket for r in late.select("bucket").distinct().collect()]
    added = stored.where(F.col("bucket").isin(buckets)).join(small(late.select("qid", "tok", "factor")), "tok").join(candidates.select("qid", "doc"), ["qid", "doc"], "left_semi").select("qid", "doc", (F.col("factor") * F.col("weight")).alias("score"))
    total = candidates.unionByName(added).groupBy("qid", "doc").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "doc", "score")


# ----------------------------------------------------------------- evidence


def evidence(golds: DataFrame) -> DataFrame:
    """qid, sent, gram, n: the trigrams of each acceptable sentence; golds has qid, evidence array<string>."""
    rows = golds.select("qid", F.posexplode("evidence").alias("sent", "s")).select("qid", "sent", tx.gram_set("s").alias("g"))
    return rows.select("qid", "sent", F.size("g").alias("n"), F.explode("g").alias("gram"))


def coverages(gold: DataFrame, units: DataFrame) -> DataFrame:
    """qid, doc, coverage: the best share of a sentence's trigrams that the unit has, where it has any; units (doc, text)."""
    grams = units.select("doc", F.explode(tx.gram_set("text")).alias("gram"))
    common = grams.join(small(gold), "gram").groupBy("qid", "sent", "n", "doc").agg(F.count("*").alias("k"))
    return common.groupBy("qid", "doc").agg(F.max(F.col("k") / F.col("n")).alias("coverage"))


def evidence_found(golds: DataFrame, units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """qid, sent, doc, coverage of the units that hold at least the threshold of a gold sentence's trigrams; units (doc, text), doc unique.

    A unit that holds k of a sentence's n grams lacks n - k, so it has one of any n - k + 1 of them: only the rarest of each
    sentence (by the units that hold them) look for units, and candidates alone are counted in full.
    """
    gold = cut(evidence(golds), "gold")
    grams = cut(units.select("doc", tx.gram_set("text").alias("g")), "unit-grams")
    wanted = small(cut(gold.select("gram").distinct(), "gold-grams"))
    held = grams.select("doc", F.explode("g").alias("gram")).join(wanted, "gram")
    often = cut(held.groupBy("gram").agg(F.count("*").alias("df")), "gram-df")
    rare = Window.partitionBy("qid", "sent").orderBy(F.coalesce("df", F.lit(0)), "gram")
    least = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    first = gold.join(often, "gram", "left").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= F.col("n") - least + 1).where("df > 0")
    candidates = grams.select("doc", F.explode("g").alias("gram")).join(small(cut(first.select("qid", "sent", "gram"), "gram-first")), "gram").select("qid", "sent", "doc").distinct()
    sentences = gold.groupBy("qid", "sent").agg(F.collect_list("gram").alias("goal"))  # a sentence's grams
    counted = candidates.join(grams, "doc").join(sentences, ["qid", "sent"]).select("qid", "sent", "doc", (F.size(F.array_intersect("goal", "g")) / F.size("goal")).alias("coverage"))
    return counted.where(F.col("coverage") >= threshold)


def best_coverage(golds: DataFrame, units: DataFrame) -> DataFrame:
    """qid, best: over all units, 0 where none shares a trigram."""
    found = coverages(cut(evidence(golds), "gold"), units).groupBy("qid").agg(F.max("coverage").alias("best"))
    return golds.select("qid").join(found, "qid", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def ranked_hits(golds: DataFrame, ranked: DataFrame, units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """ranked (qid, rank, doc) with text, words and found: whether the unit holds the question's evidence."""
    gold = cut(evidence(golds), "gold")
    hits = ranked.join(units.select("doc", "text"), "doc")
    grams = hits.select("qid", "doc", F.explode(tx.gram_set("text")).alias("gram"))
    found = grams.join(gold, ["qid", "gram"]).groupBy("qid", "doc", "sent", "n").agg(F.count("*").alias("k")).where(F.col("k") >= threshold * F.col("n")).select("qid", "doc").distinct().withColumn("found", F.lit(True))
    return hits.join(found, ["qid", "doc"], "left").select("qid", "rank", "doc", "text", tx.n_words("text").alias("words"), F.coalesce("found", F.lit(False)).alias("found"))


def recall_at(golds: DataFrame, hits: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """k, recall over all questions of golds (qid); one without any ranked unit counts as not found."""
    first = hits.where("found").groupBy("qid").agg(F.min("rank").alias("first"))
    means = golds.select("qid").join(first, "qid", "left").agg(*[F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))).alias(f"r{k}") for k in cuts])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in cuts])).alias("x")).select("x.k", "x.recall")


def budget_hits(golds: DataFrame, hits: DataFrame, budgets: tuple[int, ...] = WORD_BUDGETS, threshold: float = THRESHOLD) -> DataFrame:
    """qid, budget, found: is evidence within the first `budget` words, read in rank order, the crossing unit cut short?"""
    upto = F.sum("words").over(Window.partitionBy("qid").orderBy("rank"))
    rows = hits.withColumn("upto", upto).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    before = F.col("upto") - F.col("words")
    whole = rows.where(F.col("found") & (F.col("upto") <= F.col("budget"))).select("qid", "budget")
    cross = rows.where((before < F.col("budget")) & (F.col("upto") > F.col("budget")))
    head = F.array_join(F.slice(tx.words("text"), 1, F.greatest(F.col("budget") - before, F.lit(0)).cast("int")), " ")
    grams = cross.select("qid", "budget", F.explode(tx.gram_set(head)).alias("gram"))
    part = grams.join(evidence(golds), ["qid", "gram"]).groupBy("qid", "budget", "sent", "n").agg(F.count("*").alias("k")).where(F.col("k") >= threshold * F.col("n")).select("qid", "budget")
    found = whole.unionByName(part).distinct().withColumn("found", F.lit(True))
    every = golds.select("qid").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return every.join(found, ["qid", "budget"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def paired(facts: DataFrame, base: str) -> DataFrame:
    """corpus, pairs, diff: mean difference of `value` to the base corpus over the questions that both have."""
    other = facts.where(F.col("corpus") == base).select("qid", F.col("value").alias("base_value"))
    return facts.where(F.col("corpus") != base).join(other, "qid").groupBy("corpus").agg(F.count("*").alias("pairs"), F.avg(F.col("value") - F.col("base_value")).alias("diff"))
