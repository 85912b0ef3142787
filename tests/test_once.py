"""Work that is done once for a row, not anew for each of its parts."""
import re

from pyspark.sql import functions as F

from incipit.operators import controls, retrieval, skill, stats
from incipit.plans import text_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_anchors_frame_grows(spark):
    """A frame up to the end of a chapter is summed anew for every block."""
    rows = [("a", 0, "((x))", "few"), ("a", 1, "", "one two three four five"), ("a", 2, "((y))", "one two three four six"), ("a", 3, "((z))", "few")]
    at = controls.forward_anchors(spark.createDataFrame(rows, "chapter string, block_no int, raw string, prose string"), r"\(\(([^()]*)\)\)")
    assert "unboundedfollowing" not in plan(at)
    assert sorted((r.entry, r.paragraph) for r in at.collect()) == [("x", "one two three four five"), ("y", "one two three four six")]


def test_term_found_once(spark, tmp_path):
    """The term is read from the text once, not for every sentence."""
    spark.createDataFrame([(1, "Ab cd. Ef gh. Ij cd.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert not re.search(r"contains\(lower\([^()]*\), lower\(", plan(text_queries.sentence_with_term(spark, str(tmp_path))))


def test_scores_meet_by_document(spark):
    """A row a question and document went through a shuffle before it was summed, many times the postings."""
    docs = spark.createDataFrame([(1, "red apples and a red pear"), (2, "pears"), (3, None), (4, "the and")], "doc long, text string")
    asked = spark.createDataFrame([(7, "red pears"), (8, "apples")], "qid long, query string")
    scores = retrieval.bm25_scores(asked, docs)
    assert not re.search(r"exchange hashpartitioning\(qid#\d+l?, doc#", scores._jdf.queryExecution().executedPlan().toString().lower())
    assert sorted((r.qid, r.doc) for r in scores.collect()) == [(7, 1), (7, 2), (8, 1)]
    rows = {r.doc: (r.len, [(t.tok, t.tf) for t in r.terms]) for r in retrieval.term_rows(docs).collect()}
    assert rows == {1: (4, [("apple", 1), ("pear", 1), ("red", 2)]), 2: (1, [("pear", 1)]), 3: (0, []), 4: (0, [])}


def test_terms_counted_by_chapter(spark):
    """Terms went through a shuffle by chapter and term, and again to get their book's name; paragraphs are dealt by chapter now."""
    rows = [("b", 1, "paragraph", "sorted trees, sorted trees and sorted trees"), ("b", 1, "code", "heap heap heap"), ("b", 2, "paragraph", "heap heap heap"), ("b", 2, "paragraph", "and trees"), ("c", 1, "paragraph", None)]
    rows = spark.createDataFrame(rows, "book string, chapter_no int, kind string, text string")
    p = rows.where("kind = 'paragraph'").select("book", "chapter_no", "text")
    counts = stats.term_counts(p.repartition("book", "chapter_no"), "book", "chapter_no")
    assert counts._jdf.queryExecution().executedPlan().toString().lower().count("exchange hashpartitioning") == 1
    assert {(r.book, r.chapter_no, r.term): r.tf for r in counts.collect()}["b", 2, "heap"] == 3
    assert sorted((r.book, r.chapter_no, r.topics) for r in skill.topics(rows).collect()) == [("b", 1, ["sorted trees"]), ("b", 2, ["heap"])]


def test_systems_against_one_reference(spark):
    """Tokens of every system and of as many copies of the reference were shuffled; a text's lines were made for each of its listings."""
    texts = spark.createDataFrame([("b", 1, "x", "a b b c", "b b a d"), ("b", 1, "y", "", "b b a d"), ("b", 2, "x", "q", "q q"), ("b", 2, "y", "q q q", "q q")], "book string, number int, system string, text string, reference string")
    tokens = lambda c: texts.select("system", "book", "number", F.explode(F.split(c, " ")).alias("token")).where("token <> ''")
    want = {r.system: r for r in stats.prf(tokens("text"), tokens("reference"), ["book", "number", "token"], ["system"]).collect()}
    got = {r.system: r for r in stats.prf_texts(texts, ["book", "number"], "system", ["x", "y"]).collect()}
    assert {k: (r.tp, r.predicted, r.gold, r.precision, r.recall, r.f1) for k, r in got.items()} == {k: (r.tp, r.predicted, r.gold, r.precision, r.recall, r.f1) for k, r in want.items()}
    codes = spark.createDataFrame([("x", "if a:\n    b\nc\nd", ["if a:\n    b", "c\nd", "c\ne", "one"]), ("y", "z", ["c"])], "id string, extracted string, codes array<string>")
    assert [tuple(r) for r in stats.code_shares(codes).collect()] == [("x", 3, 1, 0.6667, 1.0)]
