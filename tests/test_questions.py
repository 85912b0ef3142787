"""Gold questions from LaTeX and Asciidoc, evaluation facts, the model arm and streaming, on small fixtures."""
from pyspark.sql import functions as F

from incipit.operators import controls, evaluation, model_arm, retrieval
from incipit.scale import cut, shared_path
from incipit.sources import markup
from incipit.streaming.ingest import ingest

TEX = r"""
front \mainmatter
\chapter{The {\em way}}
\index{way!long} A {\bf variable} is a name that refers to a value. It is short.

\begin{verbatim}
{\bf code} x
\end{verbatim}

\index{Pro@{\tt pro}}

The prose that follows has at least five words.
\section{Glossary}
\begin{description}
\item[variable:] A name for a value.
\item[ghost:] Never seen in the body.
\end{description}
\appendix
\chapter{Gone}
"""


def test_latex(spark):
    src = spark.createDataFrame([("demo", TEX)], "book string, tex string")
    items, counts = markup.glossary_questions(src, "demo")
    r = items.collect()
    assert [(x.qid, x.term, x.gold_sentence) for x in r] == [("demo-01-00", "variable", "A variable is a name that refers to a value.")]
    assert tuple(counts.first()) == (2, 1)
    a = markup.latex_anchors(src).orderBy("ord").collect()
    assert [(x.term, x.chapter, x.chapter_title) for x in a] == [("long way", "1", "The way"), ("pro", "1", "The way")]
    assert a[1].paragraph == "The prose that follows has at least five words."


def test_asciidoc(spark):
    files = {"ch.asc": "== Basics\n\ninclude::a.asc[]\n", "a.asc": "(((git commands, add)))(((staging)))\nYou stage files with `git add` before a commit.\n\n----\n(((not,this)))\n----\n"}
    made = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r.path: r.text for r in markup.expanded(made, spark.createDataFrame([("ch.asc",), ("missing.asc",)], "path string")).collect()}
    text = got["ch.asc"]
    assert text == files["ch.asc"].replace("include::a.asc[]", files["a.asc"]) and "missing.asc" not in got
    a = markup.asciidoc_anchors(spark.createDataFrame([("2", text)], "chapter string, text string")).orderBy("ord").collect()
    assert [(x.term, x.chapter_title) for x in a] == [("git add", "Basics"), ("staging", "Basics")]
    assert a[0].paragraph == "You stage files with git add before a commit."


def test_includes(spark):
    """Against a recursion in Python: nested, repeated, up and down folders, missing, outside the edition, and in a circle."""
    import posixpath
    import re

    files = {
        "book/top.asc": "a\ninclude::ch/one.asc[] tail\ninclude::ch/one.asc[]\n include::ch/two.asc[]\ninclude::../shared/x.asc[]\n", "book/ch/one.asc": "one\ninclude::../../shared/x.asc[]\nend", "book/ch/two.asc": "two", "shared/x.asc": "x\ninclude::/abs.asc[]\ninclude::gone.asc[]\n",
        "abs.asc": "never", "out.asc": "include::../../etc/passwd[]after\ninclude::./a/../shared/./x.asc[]", "circle.asc": "c\ninclude::round.asc[]\n", "round.asc": "r\ninclude::circle.asc[]\ninclude::round.asc[]z", "empty.asc": "",
    }

    def whole(name, within=()):
        def one(m):
            at = posixpath.normpath(posixpath.join(posixpath.dirname(name), m[1]))
            return whole(at, (*within, name)) if at in files and at not in (*within, name) and not m[1].startswith("/") else ""

        return re.sub(r"(?m)^include::([^\[]+)\[\]", one, files[name])

    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r.path: r.text for r in markup.expanded(df, df.select("path")).collect()}
    assert got == {name: whole(name) for name in files}
    tops = spark.createDataFrame([("b", "book/top.asc", "include::ch01-a.asc[]\ninclude::x/ch12-b.asc[]\ninclude::A-app.asc[]\ninclude::intro.asc[]\ninclude::../../ch9-z.asc[]")], "book string, path string, text string")
    assert [(r.number, r.path) for r in markup.chapter_files(tops).orderBy("ord").collect()] == [("1", "book/ch01-a.asc"), ("12", "book/x/ch12-b.asc"), ("A", "book/A-app.asc")]


def test_composed_form(spark):
    """Against Python's, over every character alone, after a letter, and before marks."""
    import unicodedata

    from incipit.functions import text as tx

    marks = "\u0301\u0308\u0323\u0345\u3099\u1161\u11a8"
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c} a{c}|" for c in chars[k : k + 64]) for k in range(0, len(chars), 64)] + [f"{c}{m}" for c in chars[0x40:0x3100] for m in marks[:2]] + [c + marks for c in chars[0x40:0x250]] + ["", None, "plain"]
    # A text of its own for each character whose composed form differs.
    texts += [c for c in chars if unicodedata.normalize("NFC", c) != c]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", tx.nfc("t").alias("t")).collect():
        assert r.t == (None if texts[r.k] is None else unicodedata.normalize("NFC", texts[r.k])), texts[r.k]


def test_filter_and_kept(spark):
    items = spark.createDataFrame([("q1", "1", "index", ["alpha beta gamma delta", "not in the text at all"], "alpha beta gamma delta"), ("q2", "1", "index", ["nothing of this here"], "nothing of this here")], "qid string, chapter string, kind string, evidence array<string>, gold_sentence string")
    got = evaluation.filter_to_text(items, spark.createDataFrame([("1", "x alpha beta gamma delta y")], "chapter string, text string")).collect()
    assert [(r.qid, r.evidence) for r in got] == [("q1", ["alpha beta gamma delta"])]
    files = spark.createDataFrame([("skill", None, "1", "alpha beta gamma delta"), ("skill", 0, "1", "none"), ("skill", 1, "1", "say alpha beta gamma delta")], "variant string, seed int, chapter string, markdown string")
    facts = cut(evaluation.kept_facts(items, files))
    assert {(r.seed, r.qid): r.kept for r in facts.collect()} == {(None, "q1"): True, (None, "q2"): False, (0, "q1"): False, (0, "q2"): False, (1, "q1"): True, (1, "q2"): False}
    c = controls.control_comparison(facts).first()
    assert (c.kept, c.control, c["diff"]) == (0.5, 0.25, 0.25)


def test_model_arm(spark):
    cache = shared_path(spark, "llm-cache")
    requests = spark.createDataFrame([("m", "s", "p1", '{"t": 0}'), ("m", "s", "p2", '{"t": 0}'), ("m", "s", "p1", '{"t": 0}')], "model string, system string, prompt string, options string")
    shout = lambda model, system, prompt, options: prompt.upper()
    first = model_arm.generate(requests, cache, shout).collect()
    assert sorted((r.response, r.hit) for r in first) == [("P1", False), ("P1", False), ("P2", False)]
    again = model_arm.generate(requests, cache, shout).collect()
    assert all(r.hit for r in again) and len(again) == 3
    assert model_arm.cache_key("m", "", "p", "{}") != model_arm.cache_key("n", "", "p", "{}")
    assert model_arm.calls(35, 289, 2, 1)["total"] == 4081 and model_arm.calls(35, 289, 2, 2)["per_question"] == 20
    o = spark.createDataFrame([(0, "q", "v", "rag", False, 0.0, True, True), (1, "q", "v", "skill", False, 0.5, True, True), (2, "q", "v", "skill", True, 0.5, True, False)], "ord int, qid string, skill_variant string, condition string, correct boolean, f1 double, routed_ok boolean, routed_to_gold_chapter boolean")
    s = {r.condition: r for r in model_arm.outcomes_summary(o).collect()}
    assert (s["skill"].n, s["skill"].accuracy, s["skill"].diff_rag) == (1, 1.0, 1.0)


def test_stream(spark, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc long, text string").write.parquet(docs)
    q = ingest(spark.readStream.schema("doc long, text string").parquet(docs), str(tmp_path / "index"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    index = spark.read.parquet(str(tmp_path / "index"))
    ask = spark.createDataFrame([("q", "beta")], "qid string, query string")
    assert [r.doc for r in retrieval.bm25_topk(ask, None, 3, index=index.drop("batch")).collect()] == [1]
    assert index.where(F.col("tok") == "alpha").count() == 2


def test_extraction_scores(spark):
    systems = spark.createDataFrame([("good", "1", "one two three four"), ("good", "2", "five six"), ("bad", "1", "one two"), ("bad", "2", "some- thing else ﬁ")], "system string, chapter string, text string")
    refs = spark.createDataFrame([("1", "one two three four"), ("2", "five six"), ("3", "never extracted")], "chapter string, text string")
    got = {r.system: r for r in evaluation.extraction_scores(systems, refs, spark.createDataFrame([("something",)], "word string")).collect()}
    assert (got["good"].chapters, got["good"].f1, got["good"].broken_hyphenations) == (2, 1.0, 0)
    # Of the six tokens of the references two are found, among seven of its own (a hyphen is one).
    assert (round(got["bad"].precision, 6), round(got["bad"].recall, 6), got["bad"].broken_hyphenations, got["bad"].ligature_glyphs) == (round(2 / 7, 6), round(2 / 6, 6), 1, 1)
