"""Costly expressions stand once in a plan, not in every use and in the filters that the optimizer infers."""
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from incipit.functions import text as tx
from incipit.operators import evaluation, stats, structure
from incipit.plans import book_queries, text_queries
from incipit.sources import markup

TEXT = "The Red fox.\nA brown dog ran  home, and the cat slept. Old Tom saw three-fold the Big bird fly.\ninclude me"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, TEXT, "en", f"s{k % 2}") for k in range(4)] + [(9, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_glossary_text_read_once(spark, sf):
    """F19."""
    found = text_queries.latex_glossaries(spark, sf)
    assert plan(found).count("regexp_replace(text") == 1
    assert [(r.chapter, r.k, r.term, r.definition) for r in found.where("book = 1").orderBy("k").collect()] == [
        (1, 0, "Red", "Red fox is it."), (1, 1, "Tom", "Tom saw is it."), (1, 2, "Big", "Big bird is it."),
    ]


def test_index_entries_read_once(spark, sf):
    """F21."""
    assert plan(text_queries.index_terms(spark, sf)).count("regexp_extract_all(text") == 1


def test_markup_base_made_once(spark, sf):
    """F27."""
    assert plan(text_queries.markup_texts(spark, sf)).count("regexp_replace(text") == 1


def test_rules_passed_over(spark):
    """Rules that are passed over would have changed nothing."""
    odd = ["plain  words", "a\\index{b{c}d}e~\\ref{x} 5\\% -- it's ``so'' --- \\ldots", "\\lab\\index{q}el{x}y", "50% gone\nleft \\verb|a b| \\tt x", "\\dots{}$a$", "a\t b\n\nc ", "'' \\", "", None]
    t = spark.createDataFrame([(x,) for x in odd], "t string")
    all_rules = lambda x, rules: F.trim(F.regexp_replace(reduce(lambda y, r: F.regexp_replace(y, *r), rules, x), r"\s+", " "))
    for r in t.select(tx.detex("t").alias("a"), all_rules(F.regexp_replace("t", r"(?<!\\)%[^\n]*", ""), tx.TEX_RULES).alias("b")).collect():
        assert r.a == r.b
    marks = spark.createDataFrame([(x,) for x in ["a *b* __c__ d*e", "((x)) (((y))) footnote:[z] http://a.b[c] <<d,e>> <<f>>", "kbd:[q] \"`r`\" '`s`' ``t`` {nbsp}u +"]], "t string")
    for r in marks.select(tx.asciidoc_text("t").alias("a"), all_rules(F.col("t"), tx.ASCIIDOC_RULES).alias("b")).collect():
        assert r.a == r.b


def test_closing_brace(spark):
    parts = ["one} two", "a {b} c} d", "a {b {c} d} e} f", "{a", "", "}", "a" + "{x}" * 80 + "} z"]
    at = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "k int, p string")
    assert [r.e for r in at.select("k", markup.closing(at.p).alias("e")).orderBy("k").collect()] == [3, 7, 13, 2, 0, 0, 241]


def test_title_keys_made_once(spark):
    """F22."""
    rows = spark.createDataFrame([("b", "Über “One”—two", None), ("b", "Über “One”—two", "Sec 1")], "book string, chapter string, section string")
    found = structure.scores(rows, rows)
    assert "lower(" not in plan(found)
    assert [r.section_f1 for r in found.collect()] == [1.0]
    assert rows.select(tx.title_key("chapter").alias("k")).first().k == "beronetwo"


def test_terms_read_once(spark):
    """F23, F25."""
    rows = spark.createDataFrame([("g", "Sorted trees and sorted trees, the old-time heap"), ("g", None)], "grp string, text string")
    counts = stats.term_counts(rows)
    assert len(re.findall(r"\binset\b|\bin \(", plan(counts))) == 1  # stopwords are looked up once a word
    assert {r.term: r.tf for r in counts.collect()} == {"sorted": 2, "trees": 2, "sorted trees": 2, "old-time": 1, "heap": 1, "old-time heap": 1}


def test_defects_read_once(spark):
    """F24."""
    vocab = spark.createDataFrame([("broken",), ("alpha",), ("beta",)], "word string")
    texts = spark.createDataFrame([(1, "ﬁ bro- ken Bro-\nken alphabeta ALPHABETA betabeta alphagamma"), (2, ""), (3, None), (4, "xbro- ken Kalphabeta ")], "id long, text string")
    found = stats.defects(texts, vocab)
    assert "regexp_extract_all" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 2, 3), (2, 0, 0, 0), (3, None, 0, 0), (4, 0, 0, 0)]


def test_only_asked_grams_are_shuffled(spark):
    """F28."""
    items = spark.createDataFrame([(1, "all", "index", ["one two three four", "not in it at all"], "x")], "qid long, chapter string, kind string, evidence array<string>, gold_sentence string")
    found = evaluation.filter_to_text(items, spark.createDataFrame([("all", "zero one two three four five"), ("all", None)], "chapter string, text string"))
    assert "leftsemi" in plan(found)
    assert [(r.qid, r.evidence, r.gold_sentence) for r in found.collect()] == [(1, ["one two three four"], "one two three four")]


def test_book_text_read_once(spark, sf):
    """F31."""
    assert plan(book_queries.book_blocks(spark, sf)).count("regexp_replace(text") == 1


def test_texts_between_includes_are_one_piece(spark):
    """F32: every line was a piece, and all pieces went through a shuffle in every round."""
    files = spark.createDataFrame([("a.asc", "x\ny\ninclude::b.asc[] tail\nz\r\ninclude::no.asc[]"), ("b.asc", "include::a.asc[]\nB\n include::b.asc[]")], "path string, text string")
    assert {r.path: r.n for r in files.select("path", F.size(markup._pieces(files.text)).alias("n")).collect()} == {"a.asc": 5, "b.asc": 2}
    assert {r.path: r.text for r in markup.expanded(files, files.select("path")).collect()} == {"a.asc": "x\ny\n\nB\n include::b.asc[] tail\nz\r\n", "b.asc": "x\ny\n tail\nz\r\n\nB\n include::b.asc[]"}


def test_composed_once(spark, sf):
    """ten thousand texts at a time were strings of Python, in pandas' series (200); Arrow's arrays (250) are walked in small parts."""
    found = text_queries.composed_texts(spark, sf)
    assert re.findall(r"arrowevalpython.*, (\d+)\n", plan(found)) == ["250"]
    texts = spark.createDataFrame([("e\u0301",), ("plain",), (None,), ("\u1112\u1161\u11ab",)], "t string")
    assert [r.t for r in texts.select(tx.nfc("t").alias("t")).collect()] == ["\u00e9", "plain", None, "\ud55c"]
