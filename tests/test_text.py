"""Known answers of the text functions, chunking, ranking and evidence."""
import hashlib

from pyspark.sql import functions as F

from incipit.functions import text as tx
from incipit.operators import controls, retrieval, stats
from incipit.scale import cut
from incipit.sources import html


def each(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.c for r in df.select("i", make(F.col("x")).alias("c")).orderBy("i").collect()]


def test_tokens_and_names(spark):
    assert each(spark, tx.stem, "variables", "classes", "dictionaries", "this", "running", "focus", "flies", "red") == ["variable", "class", "dictionary", "this", "runn", "focus", "flie", "red"]
    assert each(spark, tx.tokenize, "What is the Variable?", None, "") == [["variable"], [], []]
    assert each(spark, tx.expand_ligatures, "ﬁrst ﬂoat eﬃcient") == ["first float efficient"] and each(spark, tx.ligature_count, "ﬁrst ﬂoat eﬃcient") == [3]
    assert each(spark, tx.roman_to_int, "xxii", "iv", "mcm", "ab", "iiii") == [22, 4, 1900, None, 4]
    got = [r and tuple(r) for r in each(spark, tx.edge_number, "12 Chapter 2. Variables", "vii", "② callout", "", "page 7")]
    assert got == [("arabic", 12), ("roman", 7), None, None, ("arabic", 7)]
    assert each(spark, tx.title_key, "Case study: word play", "Case Study - Word Play") == ["casestudywordplay"] * 2
    assert each(spark, tx.slugify, "Hello, World!", "---") == ["hello-world", "untitled"]
    assert each(spark, lambda x: tx.reference_file_name(x, F.lit("Variables & more")), "3", "12", "A") == [f"references/ch{n}-variables-more.md" for n in ("03", "12", "A")]
    terms = [f"term {k}" for k in range(60)]
    want = ["test" if int(hashlib.sha256(f"b\0{t}".encode()).hexdigest(), 16) % 5 == 0 else "dev" for t in terms]
    assert each(spark, lambda x: tx.split_of(F.lit("b"), F.upper(x)), *terms) == want
    assert each(spark, tx.junk_title, "thesis.dvi", "main.tex", "Microsoft Word - x", "Untitled", "12345", "Think Python", "Pro Git") == [True] * 5 + [False] * 2


def test_markup(spark):
    assert each(spark, tx.latex_term, "statement!assignment", r"join@{\tt join}", "recursion|see{x}", r"{\tt 1}") == ["assignment statement", "join", "recursion", ""]
    assert each(spark, tx.asciidoc_term, "git commands, add", "version control,local", " ") == ["git add", "local version control", ""]
    assert each(spark, tx.detex, r"50\% of \emph{it}~now % c") == ["50% of it now"]
    assert each(spark, tx.asciidoc_text, "[NOTE]\n====\nRun `git add` to stage a file(((git commands, add))), see <<_x,Git Basics>> and the https://a.org[site].\n====") == ["Run git add to stage a file, see Git Basics and the site."]
    assert each(spark, tx.prose_words, "# h\n\n- one two\n```\ncode\n```\nSource pages 1-2 of\n| t |\nFrom *S*: lead here") == [4]
    assert each(spark, tx.says_correct, "CORRECT", "correct.", "INCORRECT", "", "Yes") == [True, True, False, False, False]
    routes = each(spark, lambda x: tx.routed(x, F.array(F.lit("references/a.md"), F.lit("references/b.md"))), "open b.md", "none")
    assert [tuple(r) for r in routes] == [("references/b.md", True), ("references/a.md", False)]


def test_evidence(spark):
    assert each(spark, lambda x: tx.coverage(F.lit("A variable is a name"), x), "A variable is a name.", "variable is", "", "other words here") == [1.0, 1.0, 0.0, 0.0]
    golds = spark.createDataFrame([("q", ["too short", "alpha beta gamma delta."])], "qid string, evidence array<string>")
    assert retrieval.evidence(golds).select("sent").distinct().count() == 1
    units = spark.createDataFrame([(0, " ".join(["filler"] * 100)), (1, "Intro words here. Alpha beta gamma delta.")], "doc long, text string")
    ranked = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "qid string, rank int, doc long")
    hits = cut(retrieval.ranked_hits(golds, ranked, units))
    assert [r.found for r in hits.orderBy("rank").collect()] == [False, True]
    assert {r.budget: r.found for r in retrieval.budget_hits(golds, hits, (100, 103, 115)).collect()} == {100: False, 103: False, 115: True}
    assert {r.k: r.recall for r in retrieval.recall_at(golds, hits, (1, 3)).collect()} == {1: 0.0, 3: 1.0}
    asked = golds.unionByName(spark.createDataFrame([("nothing ranked", ["x"])], golds.schema))
    assert {r.k: r.recall for r in retrieval.recall_at(asked, hits, (1, 3)).collect()} == {1: 0.0, 3: 0.5}


def test_token_f1(spark):
    """Against multisets of the same tokens; a text of 30,000 words takes no quadratic time."""
    import random
    from collections import Counter

    r = random.Random(2)
    words = ["alpha", "alphas", "beta", "be", "gamma", "1", "11", "b", "bb"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(text(r.randrange(30)), text(r.randrange(30))) for _ in range(40)] + [("", "alpha"), ("", ""), (text(30_000), text(20_000))]
    df = spark.createDataFrame(rows, "a string, b string")
    for x in stats.token_f1(df.withColumns({"ta": tx.tokenize("a"), "tb": tx.tokenize("b")}), "a", "b").collect():
        n = sum((Counter(x.ta) & Counter(x.tb)).values())
        want = 2 * n / (len(x.ta) + len(x.tb)) if n else 0.0
        assert abs(x.f1 - want) < 1e-12


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "alpha"), (1, "alpha"), (2, "beta"), (3, None)], "doc long, text string")
    q = spark.createDataFrame([("q", "alpha"), ("z", "zeta"), ("r", "alpha beta")], "qid string, query string")
    got = {(r.qid, r["rank"]): r.doc for r in retrieval.bm25_topk(q, docs, 2).collect()}
    assert got == {("q", 1): 0, ("q", 2): 1, ("r", 1): 2, ("r", 2): 0}


def test_chunks(spark):
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.array(F.concat(F.lit("# h"), k.cast("string")), F.repeat(F.lit("w "), 60))))
    sizes = [r.n for r in spark.range(1).select(F.explode(retrieval.chunk_pieces(pieces)).alias("c")).select(tx.n_words("c").alias("n")).collect()]
    assert len(sizes) == 4 and all(150 <= n <= 200 for n in sizes[:3])
    assert each(spark, retrieval.markdown_pieces, "a\n\nb\n\n```\nx\n\ny\n```\n\nc\n\n```\nopen") == [["a", "b", "```\nx\n\ny\n```", "c", "```\nopen"]]
    assert each(spark, lambda x: retrieval.split_long(x, 4), "One two three. Four five. Six") == [["One two three.", "Four five. Six"]]


def test_stats(spark):
    one = lambda rows: spark.createDataFrame([(x,) for x in rows], "k string")
    r = stats.prf(one("aab"), one("abc"), ["k"]).first()
    assert (r.tp, r.predicted, r.gold) == (2, 3, 3)
    k = stats.kappa(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean"), "a", "b").first()
    assert (k.agreement, k.kappa) == (0.5, 0.0)
    f = stats.fidelity(spark.createDataFrame([(1, "a b", "a b c d"), (2, "“x”", '"x"'), (3, "", "x")], "id int, extracted string, reference string"))
    assert {r.id: (r.precision, r.recall) for r in f.collect()} == {1: (1.0, 0.5), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    d = stats.defects(spark.createDataFrame([(1, "ﬁrst expres- sion printfunction")], "id int, text string"), one(["expression", "print", "function"]).withColumnRenamed("k", "word")).first()
    assert (d.ligature_glyphs, d.broken_hyphenations, d.glued_words) == (1, 1, 1)
    code = stats.code_recovery(spark.createDataFrame([(1, "x\nif a:\n    b\nz\nc\nd", "if a:\n    b"), (1, "x\nif a:\n    b\nz", "  q\n  r")], "id int, extracted string, code string")).first()
    assert (code.blocks, code.indented_blocks, code.exact, code.exact_indented) == (2, 1, 0.5, 1.0)
    b = stats.bootstrap(spark.createDataFrame([("g", 1.0, "x"), ("g", 1.0, "y")], "grp string, value double, c string"), "grp", "c", 100).first()
    assert (b.low, b.high) == (1.0, 1.0)
    scored = spark.createDataFrame([("g", "tuple", 5, 3.0), ("g", "tuple assignment", 4, 2.0), ("g", "card", 3, 1.5), ("g", "cards", 3, 1.0)], "grp string, term string, tf int, score double")
    assert stats.topics(scored).first().topics == ["tuple assignment", "card"]


def test_items_from_anchors(spark):
    a = spark.createDataFrame([(0, "Tuple", "1", "One", "A tuple is a sequence of values."), (1, "tuple", "2", "Two", "Elsewhere a tuple is mentioned once more."), (2, "list", "1", "One", "short one"), (3, "tuple", "1", "One", "Tuples: Here they come again now.")], "ord int, term string, chapter string, chapter_title string, paragraph string")
    got = controls.items_from_anchors(a, "demo", spark.createDataFrame([("tuples",)], "term string")).collect()
    assert [(r.qid, r.term, len(r.evidence), r.in_glossary) for r in got] == [("demo-idx-0000", "Tuple", 2, True)]


def test_forward_anchor(spark):
    b = spark.createDataFrame([("1", 0, "((x)) ", "x"), ("1", 1, "code", ""), ("1", 2, "((y)) prose", "five words are in here"), ("1", 3, "((z))", "")], "chapter string, block_no int, raw string, prose string")
    assert [(r.entry, r.paragraph) for r in controls.forward_anchors(b, r"\(\(([^()]*)\)\)").orderBy("block_no").collect()] == [("x", "five words are in here"), ("y", "five words are in here")]


def test_html(spark):
    page = '<h1>Chapter 1  Way</h1><p>Text <a href="http://amzn.to/x">buy</a> here</p><pre>\na\n  b\n</pre><h2>1.1 First</h2><p>more</p><h4>end</h4><p>gone</p>'
    r = html.chapters(spark.createDataFrame([(1, page), (2, None)], "doc int, html string"), html.HEVEA).collect()
    assert len(r) == 1 and (r[0].number, r[0].title, r[0].code_blocks, r[0].sections[0].title) == ("1", "Way", ["a\n  b"], "First")
    assert "buy" not in r[0].text and "gone" not in r[0].text and r[0].text.startswith("Chapter 1\nWay")
    other = """<body class='x'><p>before</p><h2 id="ch03-x">T<br>t</h2><div>a &amp; b<br/>c &lt;<script>var x = "<p>";</script></div><!-- <p>no</p> --><h3>3.2 S&nbsp;s</h3>x < y
      <pre>one &gt; two</pre><h2 id='A-y' data-q=">">Last</h2>end<div id="footer">gone</div><h2>never</h2>"""
    rows = html.chapters(spark.createDataFrame([(7, other), (7, other), (8, "")], "doc int, html string"), html.ASCIIDOCTOR).orderBy("chapter_no").collect()
    assert [(r.doc, r.chapter_no, r.number, r.title) for r in rows] == [(7, 0, "3", "Tt")] * 2 + [(7, 1, "A", "Last")] * 2
    assert rows[0].text == "Tt\n\na & b\n\nc <\n\n3.2 S s\nx < y \none > two" and rows[0].code_blocks == ["one > two"]
    assert [tuple(x) for x in rows[0].sections] == [("3.2", "S s")] and rows[2].text == "Last\nend"


def test_entry_without_training_operators(tmp_path):
    """A copy of the repository without the training-data folders still offers every other query, and no pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "incipit", tmp_path / "incipit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    names = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    for _ in range(2):  # with corpus_pipeline.py left behind, then without it
        out = subprocess.run([sys.executable, "-c", names], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout.splitlines()
        assert "bm25_topk" in out[0].split() and set(out[1].split()) <= set(out[0].split())
        assert not [x for x in out[0].split() if x.startswith("op") or x == "pipeline"]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_small_and_cuts(spark):
    """Broadcast only under both bounds; a cut is there until it is dropped."""
    from incipit import scale

    df = spark.range(100).selectExpr("id", "repeat('x', 1000) as `a.b`")
    marked = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert marked(scale.small(df)) and not marked(scale.small(df, rows=99)) and not marked(scale.small(df, size=50_000))
    assert marked(scale.small(df.limit(0)))
    kept, path = scale.written(df)
    assert kept.count() == 100 and scale.shared_dir(spark) in path
    scale.dropped(spark, path)
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()


def test_fidelity_turns(spark, tmp_path):
    """Whole texts of more than ten words, reordered too, against difflib."""
    import re
    from difflib import SequenceMatcher

    from incipit.plans.queries import fidelity_turns

    one = " ".join(f"w{k % 17}" for k in range(60))
    turns = [("c", 0, one), ("c", 1, " ".join(one.split()[30:] + one.split()[:30])), ("c", 2, one + ", and more."), ("d", 0, "x"), ("d", 1, "")]
    spark.createDataFrame(turns, "conv_id string, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: (r.ref_tokens, r.out_tokens, round(r.precision, 9), round(r.recall, 9)) for r in fidelity_turns(spark, str(tmp_path)).collect()}
    want = {}
    for (c, n, t), (d, _, u) in zip(turns, turns[1:]):
        if c == d:
            b, a = (re.findall(r"\w+|[^\w\s]", x) for x in (t, u))
            same = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            want[f"{c}/{n}"] = (len(b), len(a), round(same / max(len(a), 1), 9), round(same / max(len(b), 1), 9))
    assert got == want and want["c/0"][0] == 60


def test_bootstrap_counts(spark):
    """Beside the generator form of as many resamples; any partitions give the same rows; clusters are wider."""
    rows = [("a" if k % 3 else None, float(k % 7 == 0), k // 10 % 20, k) for k in range(600)] + [("one", 1.0, 0, 0)] * 3
    df = spark.createDataFrame(rows, "grp string, value double, c int, ord int")
    for cluster in (None, "c"):
        got = {r.grp: r for r in stats.bootstrap_counts(df, "grp", cluster).collect()}
        want = {r.grp: r for r in stats.bootstrap(df, "grp", cluster).collect()}
        assert {g: (round(r["mean"], 9), r.n) for g, r in got.items()} == {g: (round(r["mean"], 9), r.n) for g, r in want.items()}
        assert all(abs(got[g].low - want[g].low) < 0.012 and abs(got[g].high - want[g].high) < 0.012 for g in want)
        assert got["one"].low == got["one"].high == 1.0
    again = stats.bootstrap_counts(df.repartition(7), "grp", "c").collect()
    assert {r.grp: r for r in again} == got


def test_topics_in_rounds(spark):
    rows = [("a", t, s) for t, s in (("alpha", 9.0), ("alpha beta", 8.0), ("beta", 7.0), ("gamma", 6.0), ("gammas", 5.0), ("delta", 4.0))] + [("b", "alpha", 1.0)]
    scored = spark.createDataFrame(rows, "grp string, term string, score double")
    want = {"a": ["alpha beta", "gamma", "delta"], "b": ["alpha"]}
    for candidates in (1, 2, 3, 2000):
        assert {r.grp: r.topics for r in stats.topics(scored, 3, candidates).collect()} == want
