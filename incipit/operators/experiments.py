"""Whole runs over books: conversion, question sets, corpora, evaluation and summaries.

A run is a list of named stages, each a Parquet table in one folder that driver and executors share. A stage whose table was
finished is read, not made again, so a run over many books that stops, or loses its driver, goes on where it was. Spark
writes a table's success mark last, so half a table is never taken for one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incipit.functions import text as tx
from incipit.operators import controls, evaluation, layout, skill, structure
from incipit.scale import cut, exists
from incipit.sources import markup, results

RANDOM_SEEDS = 20


class Stages:
    """Named tables of a run below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}/_SUCCESS")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made if it is not there yet."""
        path = f"{self.folder}/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def check_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raises FileNotFoundError naming every input that is not there."""
    missing = [f"{name} ({path})" for name, path in paths.items() if not exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def convert(lines: DataFrame, metadata: DataFrame, opts: layout.RepairOptions = layout.RepairOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structure of the books (see structure.detect), their titles, and the report of the repairs; metadata (book, title, stem)."""
    blocks, report = layout.build_blocks(lines, opts)
    blocks = cut(blocks, "converted")
    return structure.detect(blocks), structure.book_title(blocks, metadata), report


def glossary_gold(sources: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """Glossary questions of a LaTeX book (book, tex), and their counts."""
    return markup.glossary_questions(sources, book)


def index_gold(book: str, glossary: DataFrame, tex: DataFrame | None = None, files: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """Index questions from a LaTeX source (book, tex), or from an Asciidoc edition's files (path, text) and top files (book, path, text).

    glossary holds the glossary questions: their terms flag index questions of the same name.
    """
    if tex is not None:
        anchors = markup.latex_anchors(tex)
    else:
        chapters = cut(markup.chapter_files(tops.where(F.col("book") == book)), "chapter-files")
        texts = markup.expanded(files, chapters.select("path"))
        anchors = markup.asciidoc_anchors(chapters.join(texts, "path").select(F.col("number").alias("chapter"), "text"))
    return controls.items_from_anchors(cut(anchors, "anchors"), book, glossary.select(F.lower("term").alias("term")).distinct())


@dataclass(frozen=True)
class Book:
    """What a run needs of one book: positioned lines (see layout.group_lines), its title, and its questions.

    items as controls.items_from_anchors() and glossary_items() make them; an edition adds the extraction and structure
    experiments: ranges (book, number, start, end), refs (book, number, title, text, code_blocks, sections).
    """

    key: str
    title: str
    lines: DataFrame
    items: DataFrame
    ranges: DataFrame | None = None
    refs: DataFrame | None = None


def rule_facts(items: DataFrame, refs: DataFrame) -> DataFrame:
    """qid, matching (a gold sentence is a defining one), in_definitions (the extract's definitions hold the evidence)."""
    defining = items.select("qid", F.exists("evidence", lambda s: tx.defines(s)).alias("matching"))
    part = F.get(F.split(F.get(F.split("markdown", "## Key definitions"), F.lit(1)), "## Worked examples"), F.lit(0))
    files = refs.select(F.lit("definitions").alias("variant"), F.lit(None).cast("int").alias("seed"), "chapter", F.coalesce(part, F.lit("")).alias("markdown"))
    kept = evaluation.kept_facts(items, files).select("qid", F.col("kept").alias("in_definitions"))
    return defining.join(kept, "qid", "left").withColumn("in_definitions", F.coalesce("in_definitions", F.lit(False)))


def evaluate(stages: Stages, name: str, items: DataFrame, found: DataFrame, raw_found: DataFrame, variants: DataFrame, seeds: int = RANDOM_SEEDS) -> dict[str, DataFrame]:
    """The facts of one question set of one book: outcomes of every corpus, best coverage, what each variant and each random
    extract of its length keeps, and how the defining rule meets the gold."""
    items = stages.once(f"{name}/items", lambda: items)
    units = {c: stages.once(f"{name}/units-{c}", lambda u=u: u) for c, u in evaluation.corpora(found, raw_found, variants).items()}
    search = stages.once(f"{name}/search", lambda: evaluation.search_facts(items, units))
    one = lambda c, u: evaluation.retrieval.best_coverage(items.select("qid", "evidence"), u.select("doc", "text")).withColumn("corpus", F.lit(c))

    def kept() -> DataFrame:
        files = variants.select("variant", F.lit(None).cast("int").alias("seed"), "chapter", "markdown")
        for v in [r.variant for r in variants.select("variant").distinct().collect()]:  # a handful
            refs = variants.where(F.col("variant") == v)
            for seed in range(seeds):
                files = files.unionByName(evaluation.control_files(found, refs, seed).select(F.lit(v).alias("variant"), F.lit(seed).alias("seed"), "chapter", "markdown"))
        return evaluation.kept_facts(items, files)

    return {
        "items": items,
        "outcomes": stages.once(f"{name}/outcomes", lambda: evaluation.outcomes(items, search, list(units))),
        "best": stages.once(f"{name}/best", lambda: reduce(DataFrame.unionByName, [one(c, u) for c, u in units.items()])),
        "kept": stages.once(f"{name}/kept", kept),
        "rule": stages.once(f"{name}/rule", lambda: rule_facts(items, variants.where("variant = 'skill'"))),
        "sentences": stages.once(f"{name}/sentences", lambda: book_sentences(found)),
    }


def book_sentences(found: DataFrame) -> DataFrame:
    """sentences, matching: those of numbered chapters, and those of them that define."""
    numbered = structure.chapters(found).where("number <> ''").select("book", "chapter_no")
    s = skill.paragraph_sentences(structure.content(found, evaluation.HOLDOUT).join(numbered, ["book", "chapter_no"], "left_semi"))
    return s.agg(F.count("*").alias("sentences"), F.coalesce(F.sum(tx.defines("sentence").cast("int")), F.lit(0)).alias("matching"))


def rule_summary(kept: DataFrame, rule: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The defining rule: how often gold and book sentences match it (enrichment is the ratio), and the control comparison of the
    extract on questions whose gold matches and on the others (variant skill_on_matching, skill_on_not_matching)."""
    gold = rule.agg(F.count("*").alias("gold"), F.coalesce(F.sum(F.col("matching").cast("int")), F.lit(0)).alias("gold_matching"), F.avg(F.col("in_definitions").cast("int")).alias("definitions_section_keeps"))
    own = sentences.agg(F.sum("sentences").alias("n"), F.sum("matching").alias("m"))
    rates = gold.join(own, F.lit(True)).select(
        "gold", "gold_matching", F.round(F.try_divide("gold_matching", "gold"), 4).alias("gold_match_rate"), F.round(F.col("m") / F.greatest("n", F.lit(1)), 4).alias("book_sentence_match_rate"),
        F.round(F.try_divide(F.try_divide("gold_matching", "gold"), F.try_divide("m", "n")), 1).alias("enrichment"), F.round("definitions_section_keeps", 4).alias("definitions_section_keeps"),
    )
    split = kept.where("variant = 'skill'").join(rule.select("qid", "matching"), "qid").withColumn("variant", F.when(F.col("matching"), "skill_on_matching").otherwise("skill_on_not_matching")).drop("matching")
    return rates, controls.summary(cut(split, "rule-kept"))


def pooled(runs: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The facts of several books as one: questions and chapters carry their book's key."""
    named = lambda key, df: df.withColumns({c: F.concat(F.lit(key + "/"), F.col(c)) for c in ("qid", "chapter") if c in df.columns})
    names = next(iter(runs.values()))
    return {n: reduce(lambda a, b: a.unionByName(b), [named(key, r[n]) for key, r in runs.items()]) for n in names}


def summarise(stages: Stages, name: str, facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Summary tables by view (all, dev, test, without glossary terms): retrieval, differences, retained, controls; and the rule's."""
    seen = cut(evaluation.views(facts["items"]), "views")
    by_view: dict[str, list[DataFrame]] = {}
    for v in [r.view for r in seen.select("view").distinct().orderBy("view").collect()]:  # at most five
        some = seen.where(F.col("view") == v).select("qid")
        only = {n: df.join(some, "qid", "left_semi") for n, df in facts.items() if "qid" in df.columns}
        thresholds = [F.coalesce(F.sum((F.col("best") >= t).cast("int")), F.lit(0)).alias(f"at_{int(t * 100)}") for t in evaluation.retrieval.THRESHOLDS]
        tables = {
            "retrieval": evaluation.retrieval_summary(only["outcomes"]), "differences": evaluation.paired_differences(only["outcomes"]),
            "retained": only["best"].groupBy("corpus").agg(F.count("*").alias("questions"), *thresholds), "controls": controls.summary(cut(only["kept"], "view-kept")),
        }
        for n, t in tables.items():
            by_view.setdefault(n, []).append(t.withColumn("view", F.lit(v)))
    out = {n: stages.once(f"{name}/summary-{n}", lambda ts=ts: reduce(DataFrame.unionByName, ts)) for n, ts in by_view.items()}
    rates, split = rule_summary(facts["kept"], facts["rule"], facts["sentences"])
    return out | {"rule": stages.once(f"{name}/summary-rule", lambda: rates), "rule_controls": stages.once(f"{name}/summary-rule-controls", lambda: split)}


def run_book(stages: Stages, book: Book, seeds: int = RANDOM_SEEDS) -> dict[str, DataFrame]:
    """Everything about one book: repairs, structure, extracts, the experiments against its edition, and the facts of its questions."""
    at = lambda name: f"{book.key}/{name}"
    made = layout.Repairs(book.lines)
    off = layout.ablations()["no_repairs"]
    blocks, raw = (stages.once(at(n), lambda o=o: made.blocks(o)[0]) for n, o in (("blocks", layout.RepairOptions()), ("raw-blocks", off)))
    found, raw_found = (stages.once(at(n), lambda b=b: structure.detect(b)) for n, b in (("structure", blocks), ("raw-structure", raw)))
    variants = stages.once(at("variants"), lambda: skill.variants(found))
    out = {
        "report": stages.once(at("report"), lambda: made.report(layout.RepairOptions())),
        "skill": stages.once(at("skill"), lambda: skill_stats(found, variants)),
    }
    if book.refs is not None and book.ranges is not None:
        out["extraction"] = stages.once(at("extraction"), lambda: evaluation.extraction_experiment(book.lines, layout.plain_page_texts(book.lines), book.ranges, book.refs))
        gold = book.refs.select("book", F.col("title").alias("chapter"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "sections")).alias("section"))
        heads = lambda f: structure.chapters(f).where("number <> ''").select("book", "chapter_no", F.col("title").alias("chapter"))
        titles = lambda f: heads(f).select("book", "chapter", F.lit(None).cast("string").alias("section")).unionByName(heads(f).join(structure.sections(f).select("book", "chapter_no", F.col("title").alias("section")), ["book", "chapter_no"]).select("book", "chapter", "section"))
        out["structure_scores"] = stages.once(at("structure-scores"), lambda: structure.scores(titles(found), gold).withColumn("system", F.lit("repaired")).unionByName(structure.scores(titles(raw_found), gold).withColumn("system", F.lit("no_repairs"))))
    text = structure.content(found, evaluation.HOLDOUT).join(structure.chapters(found).where("number <> ''").select("book", "chapter_no", F.col("number").alias("chapter")), ["book", "chapter_no"])
    present = stages.once(at("questions"), lambda: evaluation.filter_to_text(book.items, text.select("chapter", "text")))
    out["counts"] = stages.once(at("counts"), lambda: book.items.agg(F.count("*").alias("terms")).join(present.agg(F.count("*").alias("questions"), F.coalesce(F.sum((F.col("split") == "test").cast("int")), F.lit(0)).alias("test"), F.coalesce(F.sum(F.col("in_glossary").cast("int")), F.lit(0)).alias("also_glossary_terms")), F.lit(True)).withColumn("not_in_text", F.col("terms") - F.col("questions")))
    return out | {f"facts/{n}": df for n, df in evaluate(stages, at("eval"), present, found, raw_found, variants, seeds).items()}


def skill_stats(found: DataFrame, variants: DataFrame) -> DataFrame:
    """book, reference_words, reference_prose_words, book_words, listings and those kept."""
    refs = variants.where("variant = 'skill'")
    words = refs.groupBy("book").agg(F.sum("words").alias("reference_words"), F.sum("prose_words").alias("reference_prose_words"))
    own = structure.content(found).groupBy("book").agg(F.sum(tx.n_words("text")).alias("book_words"))
    return own.join(words, "book", "left").join(skill.code_retention(found, refs), "book", "left").fillna(0)


def run_all(spark: SparkSession, books: list[Book], folder: str, seeds: int = RANDOM_SEEDS) -> dict[str, DataFrame]:
    """Every book, then all of them pooled; summaries are also written as JSON lines below folder/results."""
    stages = Stages(spark, folder)
    runs = {b.key: run_book(stages, b, seeds) for b in books}
    facts = {key: {n.removeprefix("facts/"): df for n, df in r.items() if n.startswith("facts/")} for key, r in runs.items()}
    whole = summarise(stages, "pooled", pooled(facts))
    for n, df in whole.items():
        results.write_lines(df, f"{stages.folder}/results/{n}", "overwrite")
    return {f"{key}/{n}": df for key, r in runs.items() for n, df in r.items()} | {f"pooled/{n}": df for n, df in whole.items()}
