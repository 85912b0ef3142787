"""Same-budget controls, forward anchors and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.operators import stats
from incipit.scale import cut


def random_control(sentences: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """grp, sent, sentence: sentences in hash order until the words reach the group's budget (the last one may overshoot).

    sentences (grp, sent, sentence), budgets (grp, budget). A group is a chapter; the order is that of an MD5, so any engine can
    repeat it.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "grp", "sent"))
    rows = sentences.join(budgets, "grp").withColumn("h", h).withColumn("n", tx.n_words("sentence"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("h", "sent")) - F.col("n")
    return rows.withColumn("before", before).where(F.col("before") < F.col("budget")).select("grp", "sent", "sentence")


def control_comparison(kept: DataFrame) -> DataFrame:
    """variant, kept, control mean, sd, min, max, diff, chapters; kept (variant, seed (null for the extract), qid, chapter, kept)."""
    rate = F.avg(F.col("kept").cast("int"))
    own = kept.where("seed is null").groupBy("variant").agg(rate.alias("kept"), F.countDistinct("chapter").alias("chapters"))
    seeds = kept.where("seed is not null").groupBy("variant", "seed").agg(rate.alias("r")).groupBy("variant").agg(F.avg("r").alias("control"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"), F.min("r").alias("low"), F.max("r").alias("high"))
    return own.join(seeds, "variant").withColumn("diff", F.col("kept") - F.col("control"))


def summary(kept: DataFrame) -> DataFrame:
    """control_comparison() with n, the interval of the rate kept, and that of kept minus control by question and by chapter."""
    own = kept.where("seed is null").select("variant", "qid", "chapter", F.col("kept").cast("double").alias("value"))
    chance = kept.where("seed is not null").groupBy("variant", "qid").agg(F.avg(F.col("kept").cast("int")).alias("chance"))
    diff = cut(own.join(chance, ["variant", "qid"]).select("variant", "qid", "chapter", "value", (F.col("value") - F.col("chance")).alias("diff")), "controls")
    ends = lambda name, rows, cluster=None: stats.bootstrap_counts(rows, "variant", cluster).select("variant", F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
    moved = diff.select("variant", "chapter", F.col("diff").alias("value"))
    out = control_comparison(kept).join(diff.groupBy("variant").agg(F.count("*").alias("n")), "variant")
    return out.join(ends("kept", diff), "variant").join(ends("diff", moved), "variant").join(ends("diff_by_chapter", moved, "chapter"), "variant")


def forward_anchors(blocks: DataFrame, pattern: str, least_words: int = 5) -> DataFrame:
    """chapter, block_no, entry, paragraph: each marked entry with its own block's prose, or that of the next block with prose.

    blocks (chapter, block_no, raw, prose)."""
    good = F.when(tx.n_words("prose") >= least_words, F.col("prose"))
    # The next is the last one seen from the end: a frame that grows is read once, one that shrinks anew for every row.
    w = Window.partitionBy("chapter").orderBy(F.desc("block_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = blocks.withColumn("paragraph", F.last(good, ignorenulls=True).over(w))
    return at.where("paragraph is not null").select("chapter", "block_no", "paragraph", F.posexplode(F.regexp_extract_all("raw", F.lit(pattern), F.lit(1))).alias("k", "entry")).select("chapter", "block_no", "k", "entry", "paragraph")


def items_from_anchors(anchors: DataFrame, book: str, glossary: DataFrame) -> DataFrame:
    """A question for each distinct term, in the chapter of its first anchor, with its paragraphs' sentences as evidence.

    anchors (ord, term, chapter, chapter_title, paragraph), glossary (term, lower case). Numbers count terms without evidence
    too, which then go."""
    key = F.lower("term")
    a = anchors.where("term <> ''").withColumn("key", key)
    first = a.groupBy("key").agg(F.min(F.struct("ord", "term", "chapter", "chapter_title")).alias("f"))
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy("f.ord")) - 1)
    paras = a.join(first.select("key", F.col("f.chapter").alias("home")), "key").where(F.col("chapter") == F.col("home")).groupBy("key", "paragraph").agg(F.min("ord").alias("o"))
    sents = paras.select("key", F.struct("o", F.col("paragraph").alias("p")).alias("p")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["p"]).alias("paragraphs"))
    out = numbered.join(sents, "key").withColumn("evidence", F.flatten(F.transform("paragraphs", lambda p: tx.index_sentences(p)))).where(F.size("evidence") > 0)
    in_glossary = out.select("key", F.explode(tx.index_variants(F.col("key"))).alias("term")).join(glossary, "term", "left_semi").select("key").distinct().withColumn("in_glossary", F.lit(True))
    out = out.join(in_glossary, "key", "left")
    return out.select(
        F.concat(F.lit(f"{book}-idx-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("qid"), F.lit(book).alias("book"), "f.chapter", "f.chapter_title", "f.term", F.lit("").alias("definition"), F.array_join("paragraphs", "\n\n").alias("gold_passage"),
        F.get("evidence", F.lit(0)).alias("gold_sentence"), "evidence", F.lit("index").alias("kind"), tx.split_of(F.lit(book), F.col("f.term")).alias("split"), F.coalesce("in_glossary", F.lit(False)).alias("in_glossary"),
    )


def glossary_items(glossary: DataFrame, paragraphs: DataFrame, book: str) -> DataFrame:
    """A question for each glossary term whose chapter sets it in bold; the first such paragraph is the gold passage.

    glossary (chapter, chapter_title, k, term, definition), paragraphs (chapter, p, raw LaTeX)."""
    bold = r"\{\\bf\s+([^{}]*)\}"
    marks = paragraphs.select("chapter", "p", "raw", F.posexplode(F.regexp_extract_all("raw", F.lit(bold), F.lit(1))).alias("b", "mark")).withColumn("mark", tx.detex("mark")).withColumn("variant", F.lower(F.trim("mark")))
    wanted = glossary.select("*", F.explode(tx.term_variants("term")).alias("variant"))
    hit = wanted.join(marks, ["chapter", "variant"]).withColumn("r", F.row_number().over(Window.partitionBy("chapter", "k").orderBy("p", "b"))).where("r = 1").withColumn("gold_passage", tx.detex("raw"))
    qid = F.concat(F.lit(book + "-"), F.lpad(F.col("chapter").cast("string"), 2, "0"), F.lit("-"), F.lpad(F.col("k").cast("string"), 2, "0"))
    sentence = tx.sentence_with("gold_passage", "mark")
    return hit.select(qid.alias("qid"), F.lit(book).alias("book"), F.col("chapter").cast("string").alias("chapter"), "chapter_title", "term", "definition", "gold_passage", sentence.alias("gold_sentence"), F.array(sentence).alias("evidence"), F.lit("glossary").alias("kind"), F.lit("").alias("split"), F.lit(False).alias("in_glossary"))
