"""Whole runs on the synthetic book: stages that go on after a stop, ten extraction systems, and the model arm with a fake transport."""
import difflib
import re

import pytest
from pyspark.sql import functions as F

from incipit.operators import evaluation, experiments, layout, model_arm, skill
from incipit.plans import fixtures as books
from incipit.scale import cut, shared_path

ITEM = "qid string, book string, chapter string, chapter_title string, term string, definition string, gold_passage string, gold_sentence string, evidence array<string>, kind string, split string, in_glossary boolean"
ITEMS = [
    ("q1", "b", "1", "Getting Started", "variable", "", "A variable is called a name that refers to a value in memory.", "A variable is called a name that refers to a value in memory.", ["A variable is called a name that refers to a value in memory."], "index", "test", False),
    ("q2", "b", "2", "Next Steps", "tuple", "", "", "", ["Tuples are sequences of values which cannot be changed once made."], "index", "dev", True),
    ("q3", "b", "2", "Next Steps", "unicorn", "", "", "", ["Nothing in this book says a word of it."], "index", "dev", False),
]
REFS = [
    ("b", "1", "Getting Started", "Getting Started\nEvery line of this paragraph is long enough to count as body text, it goes on about assignments and a function that is well-known to readers.\nLook at the code:\ndef double(x):\n    return 2 * x\n", ["def double(x):\n    return 2 * x\n"], ["First Section", "Second Section"]),
    ("b", "2", "Next Steps", "Next Steps\nTuples are sequences of values which cannot be changed once made. The first float is efficient.", [], ["More", "Last"]),
]


@pytest.fixture(scope="module")
def lines(spark):
    runs = spark.createDataFrame(books.tiny_book(), books.RUN_SCHEMA)
    fonts = spark.createDataFrame(books.FONTS, books.FONT_SCHEMA)
    return cut(layout.group_lines(layout.measured(runs, fonts)))


@pytest.fixture(scope="module")
def book(spark, lines):
    refs = spark.createDataFrame(REFS, "book string, number string, title string, text string, code_blocks array<string>, sections array<string>")
    ranges = spark.createDataFrame([("b", "1", 2, 4), ("b", "2", 4, 6)], "book string, number string, start int, end int")
    return experiments.Book("b", "A Tiny Book", lines, spark.createDataFrame(ITEMS, ITEM), ranges, refs)


def tokens(text):
    return re.findall(r"\w+|[^\w\s]", text)


def test_ten_systems_against_difflib(spark, book):
    plain = layout.plain_page_texts(book.lines)
    got = {r.system: r for r in evaluation.extraction_experiment(book.lines, plain, book.ranges, book.refs).collect()}
    assert len(got) == 10 and all(r.chapters == 2 for r in got.values())
    blocks = layout.ablated_blocks(book.lines, layout.ablations())
    texts = evaluation.chapter_texts(plain.withColumn("system", F.lit("plain")).select("system", "book", "page", "text"), book.ranges, ["page"], "\n").unionByName(evaluation.chapter_texts(blocks, book.ranges, ["block_no"])).collect()
    gold = {(b, n): t for b, n, _, t, *_ in REFS}
    for system, r in got.items():
        same = out = ref = 0
        for t in texts:
            if t.system == system:
                a, b = tokens(t.text), tokens(gold[t.book, t.number])
                same += sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
                out, ref = out + len(a), ref + len(b)
        assert (r.tokens_out, r.tokens_ref) == (out, ref)
        assert abs(r.precision - same / out) < 1e-9 and abs(r.recall - same / ref) < 1e-9
    assert got["repaired"].f1 > got["no_repairs"].f1 and got["repaired"].exact == 1.0 and got["without_code"].exact == 0.0
    assert got["without_dehyphenate"].broken_hyphenations > 0 == got["repaired"].broken_hyphenations and got["without_ligatures"].ligature_glyphs == 3


def test_shared_repairs_equal_single_ones(lines):
    some = {n: layout.ablations()[n] for n in ("repaired", "without_headers", "without_dehyphenate", "no_repairs")}
    every = {(r.system, r.block_no): (r.kind, r.text, r.page) for r in layout.ablated_blocks(lines, some).collect()}
    for name, opts in some.items():
        alone = {(name, r.block_no): (r.kind, r.text, r.page) for r in layout.build_blocks(lines, opts)[0].collect()}
        assert alone == {k: v for k, v in every.items() if k[0] == name}


def test_run_goes_on_after_a_stop(spark, book, monkeypatch):
    folder = shared_path(spark, "run")
    made = []
    plain, search = skill.variants, evaluation.search_facts
    monkeypatch.setattr(skill, "variants", lambda f: made.append("variants") or plain(f))

    def stops(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(evaluation, "search_facts", stops)
    with pytest.raises(RuntimeError, match="lost"):
        experiments.run_all(spark, [book], folder, seeds=2)
    assert made == ["variants"] and experiments.Stages(spark, folder).done("b/variants") and not experiments.Stages(spark, folder).done("b/eval/search")
    monkeypatch.setattr(evaluation, "search_facts", search)
    out = experiments.run_all(spark, [book], folder, seeds=2)
    assert made == ["variants"]  # read, not made again
    counts = out["b/counts"].first()
    assert (counts.terms, counts.questions, counts.test, counts.also_glossary_terms, counts.not_in_text) == (3, 2, 1, 1, 1)
    r = {(x.corpus, x.metric): x.mean for x in out["pooled/retrieval"].where("view = 'all'").collect()}
    assert r["book_chunks", "recall@10"] == 1.0 and len({c for c, _ in r}) == 6
    assert {x.view for x in out["pooled/controls"].select("view").collect()} == {"all", "dev", "test", "not_glossary", "test_not_glossary"}
    rule = out["pooled/rule"].first()
    assert (rule.gold, rule.gold_matching, rule.gold_match_rate) == (2, 1, 0.5) and rule.enrichment > 1
    assert {x.variant for x in out["pooled/rule_controls"].collect()} == {"skill_on_matching", "skill_on_not_matching"}
    scores = {x.system: x for x in out["b/structure_scores"].collect()}
    assert scores["repaired"].chapter_f1 == 1.0 and scores["repaired"].section_parent_accuracy == 1.0
    assert spark.read.json(f"{folder}/results/rule").count() == 1


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "here").write_text("x")
    with pytest.raises(FileNotFoundError, match=r"tex \(.*gone\)"):
        experiments.check_inputs(spark, {"pdf": str(tmp_path / "here"), "tex": str(tmp_path / "gone")})


def test_model_arm_run(spark):
    cache = shared_path(spark, "arm")
    items = spark.createDataFrame([("q1", "1", "variable", "a name for a value"), ("q2", "2", "tuple", "a sequence")], "qid string, chapter string, term string, definition string")
    units = spark.createDataFrame([(0, "A variable is a name for a value."), (1, "A tuple is a sequence."), (2, "Nothing.")], "doc long, text string")
    parts = spark.createDataFrame([("1", "Names", 0, "A variable is a name for a value."), ("1", "Names", 1, "more " * 30), ("2", "Rows", 0, "A tuple is a sequence.")], "chapter string, title string, ord int, text string")

    def transport(model, system, prompt, options):
        if prompt.startswith("Write"):
            return "## When to use\n## Sections\n## Key definitions\n" + prompt[-30:]
        if prompt.startswith("Which"):
            return "references/ch02.md" if "tuple" in prompt.split("Question:")[1] else "no idea"
        if prompt.startswith("Does"):
            return "CORRECT" if "a sequence" in prompt.split("Answer:")[1] or model == "kind" else "Incorrect."
        return "It is a sequence." if "tuple is a sequence" in prompt else "I do not know."

    ask, second = model_arm.asking("m", cache, transport), model_arm.asking("kind", cache, transport)
    made, report = model_arm.written_skill(parts, spark.createDataFrame([("1", 5)], "chapter string, budget int"), ask, most_words=20)
    rep = {r.chapter: r for r in report.collect()}
    assert (rep["1"].truncated, rep["1"].kept_words, rep["1"].budget, rep["2"].budget) == (True, 8, 5, 600) and rep["1"].missing_headings == ["Worked examples"] and made.count() == 2
    skills = made.select(F.lit("llm").alias("skill_variant"), "chapter", F.col("chapter").cast("int").alias("ord"), F.concat(F.lit("references/ch0"), "chapter", F.lit(".md")).alias("file"), "markdown")
    skills = cut(skills.unionByName(skills.withColumn("skill_variant", F.lit("extractive"))))
    indexes = spark.createDataFrame([("llm", "index"), ("extractive", "other index")], "skill_variant string, markdown string")
    run = lambda: {(r.qid, r.skill_variant, r.condition): r for r in model_arm.run_items(items, units, skills, indexes, ask, [ask, second], 1).collect()}
    got = run()
    assert len(got) == 2 * (2 + 2 * 2) and {c for *_, c in got} == {"closed_book", "rag", "skill", "both"}
    assert got["q2", "-", "rag"].correct and not got["q2", "-", "closed_book"].correct and got["q2", "-", "closed_book"].correct_second_judge
    assert (got["q2", "llm", "skill"].routed_file, got["q2", "llm", "skill"].routed_ok, got["q2", "llm", "skill"].routed_to_gold_chapter) == ("references/ch02.md", True, True)
    assert (got["q1", "llm", "skill"].routed_file, got["q1", "llm", "skill"].routed_ok, got["q1", "llm", "skill"].routed_to_gold_chapter) == ("references/ch01.md", False, True)
    assert got["q2", "-", "rag"].f1 > got["q1", "-", "closed_book"].f1 == 0.0
    n = spark.read.parquet(cache).count()
    assert run() == got and spark.read.parquet(cache).count() == n  # everything from the cache


def test_two_runs_at_once_agree(spark):
    """Both ask for the same reply before either has written: both end with the reply that was committed first."""
    cache = shared_path(spark, "race")
    asked = spark.createDataFrame([("m", "", "p", "{}")], "model string, system string, prompt string, options string")
    inner = []

    def outer(model, system, prompt, options):
        return "outer"

    plain = model_arm.cached

    def racing(s, c, keys):
        seen = plain(s, c, keys)
        if not inner:  # another run comes between looking and writing
            inner.append("running")
            inner.append([r.response for r in model_arm.generate(asked, cache, lambda *a: "inner").collect()])
        return seen

    model_arm.cached = racing
    try:
        mine = [r.response for r in model_arm.generate(asked, cache, outer).collect()]
    finally:
        model_arm.cached = plain
    assert mine == inner[1] == ["inner"]
    assert [(r.response, r.hit) for r in model_arm.generate(asked, cache, outer).collect()] == [("inner", True)]
