"""A compact extract of each chapter, and an index over the extracts: leads, definitions, examples, topics.

Selections are windows and semi-joins over sentences; each chapter's markdown is an ordered aggregation of a chapter's
selected lines, never of its whole text.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.operators import stats, structure
from incipit.scale import cut

KEY = ["book", "chapter_no"]
DESCRIPTION = 1024


def paragraph_sentences(rows: DataFrame) -> DataFrame:
    """Content rows (paragraphs) to sentences: + sent_no, sentence."""
    return rows.where("kind = 'paragraph'").select(*KEY, "section_no", "section", "block_no", F.posexplode(tx.sentences("text")).alias("sent_no", "sentence"))


def leads(rows: DataFrame, n: int = 2) -> DataFrame:
    """The first sentences of each section's first paragraph; in a section, those that the chapter had before are left out."""
    first = Window.partitionBy(*KEY, "section_no").orderBy("block_no")
    opening = rows.where("kind = 'paragraph'").withColumn("k", F.row_number().over(first)).where("k = 1")
    s = paragraph_sentences(opening).where(F.col("sent_no") < n)
    before = F.min(F.struct("section_no", "sent_no")).over(Window.partitionBy(*KEY, "sentence"))
    s = s.withColumn("first_section", before["section_no"])
    return s.where((F.col("section_no") == 0) | (F.col("first_section") == F.col("section_no"))).drop("first_section")


def definitions(rows: DataFrame, lead: DataFrame, limit: int = 12) -> DataFrame:
    """Distinct defining sentences of 6 to 45 words, in order, that no lead has; at most `limit` a chapter."""
    n = tx.n_words("sentence")
    s = paragraph_sentences(rows).where(tx.defines("sentence") & (n >= 6) & (n <= 45)).join(lead.select(*KEY, "sentence").distinct(), [*KEY, "sentence"], "left_anti")
    s = s.groupBy(*KEY, "sentence").agg(F.min(F.struct("block_no", "sent_no")).alias("at"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))).where(F.col("k") <= limit).select(*KEY, "k", "sentence")


def examples(rows: DataFrame, used: DataFrame, limit: int = 4, most_lines: int = 12) -> DataFrame:
    """The first listing of two lines or more of each section, after the last sentence before it unless the extract has that already."""
    w = Window.partitionBy(*KEY, "section_no").orderBy("block_no")
    at = rows.where("section_no > 0").withColumn("before", F.last(F.when(F.col("kind") == "paragraph", F.col("text")), ignorenulls=True).over(w))
    code = at.where((F.col("kind") == "code") & F.contains("text", F.lit("\n"))).withColumn("k", F.row_number().over(w)).where("k = 1")
    code = code.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("section_no"))).where(F.col("n") <= limit)
    code = code.withColumn("sentence", F.try_element_at(tx.sentences("before"), F.lit(-1)))
    seen = used.select(*KEY, "sentence").distinct().withColumn("seen", F.lit(True))
    code = code.join(seen, [*KEY, "sentence"], "left")
    label = F.concat(F.lit("From *"), "section", F.lit("*:"), F.when(F.col("seen").isNull() & F.col("sentence").isNotNull(), F.concat(F.lit(" "), "sentence")).otherwise(""))
    body = F.array_join(F.slice(F.split("text", "\n"), 1, most_lines), "\n")
    return code.select(*KEY, "n", F.concat(label, F.lit("\n\n```\n"), body, F.lit("\n```")).alias("md"))


def topics(rows: DataFrame, n: int = 8) -> DataFrame:
    """book, chapter_no, topics: distinctive terms of each chapter against the other chapters of its book."""
    p = rows.where("kind = 'paragraph'").select(*KEY, "text")
    # Paragraphs are dealt by chapter before they become terms: a chapter's terms are counted where they lie, without a shuffle of them.
    counts = cut(stats.term_counts(p.repartition(*KEY), *KEY), "skill-terms")
    total = rows.groupBy("book").agg(F.countDistinct("chapter_no").alias("chapters"))
    df = counts.groupBy("book", "term").agg(F.count("*").alias("df"))
    grp = F.to_json(F.struct("book", "chapter_no")).alias("grp")
    scored = counts.where("tf >= 3").join(df, ["book", "term"]).join(total, "book").select(grp, "term", "tf", (F.col("tf") * F.log(F.col("chapters") / F.col("df"))).alias("score"))
    picked = stats.topics(scored, n)
    return picked.select(F.from_json("grp", "book string, chapter_no int").alias("g"), "topics").select("g.book", F.col("g.chapter_no").alias("chapter_no"), "topics")


def references(found: DataFrame, exclude: tuple[str, ...] = ("Glossary",), most_definitions: int = 12) -> DataFrame:
    """book, chapter_no, chapter (number), title, topics, file, markdown, words, prose_words: an extract of each numbered chapter."""
    numbered = cut(structure.chapters(found).where("number <> ''"), "skill-chapters")
    rows = cut(structure.content(found, exclude).join(numbered.select(*KEY), KEY, "left_semi"), "skill-rows")
    lead = cut(leads(rows), "skill-leads")
    defs = cut(definitions(rows, lead, most_definitions), "skill-definitions")
    ex = examples(rows, lead.select(*KEY, "sentence").unionByName(defs.select(*KEY, "sentence")))
    line = lambda part, k, md: F.struct(F.lit(part).alias("part"), k.cast("long").alias("k"), md.alias("md"))

    def section_md(s: DataFrame) -> DataFrame:
        said = lead.where("section_no > 0").groupBy(*KEY, "section_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x["sentence"]), " ").alias("lead"))
        head = F.concat(F.lit("### "), F.when(F.col("number") != "", F.concat("number", F.lit(" "))).otherwise(""), "title")
        return s.join(said, [*KEY, "section_no"], "left").select(*KEY, line(1, F.col("section_no"), F.concat(head, F.coalesce(F.concat(F.lit("\n\n"), "lead"), F.lit("")))).alias("l"))

    secs = structure.sections(found).join(numbered.select(*KEY), KEY, "left_semi")
    secs = secs.where(~F.lower("title").isin(*[e.lower() for e in exclude])) if exclude else secs
    intro = lead.where("section_no = 0").groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x["sentence"]), " ").alias("t")).select(*KEY, line(0, F.lit(0), F.col("t")).alias("l"))
    d = defs.groupBy(*KEY).agg(F.concat(F.lit("## Key definitions\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "sentence"))), lambda x: F.concat(F.lit("- "), x["sentence"])), "\n")).alias("t")).select(*KEY, line(2, F.lit(0), F.col("t")).alias("l"))
    e = ex.groupBy(*KEY).agg(F.concat(F.lit("## Worked examples\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "md"))), lambda x: x["md"]), "\n\n")).alias("t")).select(*KEY, line(3, F.lit(0), F.col("t")).alias("l"))
    body = intro.unionByName(section_md(secs)).unionByName(d).unionByName(e).groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["md"]), "\n\n").alias("body"))
    out = numbered.join(topics(rows), KEY, "left").join(body, KEY, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    head = F.concat(
        F.lit("# Chapter "), "number", F.lit(": "), "title", F.lit("\n\nSource pages "), F.col("page") + 1, F.lit("-"), F.col("last_page") + 1, F.lit(" of the PDF.\n\n## When to use\n\nOpen this file for questions about: "),
        F.array_join("topics", ", "), F.lit(".\n\n## Sections"), F.coalesce(F.concat(F.lit("\n\n"), "body"), F.lit("")), F.lit("\n"),
    )
    out = out.withColumn("markdown", head).select(*KEY, F.col("number").alias("chapter"), "title", "topics", tx.reference_file_name("number", "title").alias("file"), "markdown")
    out = cut(out, "skill-references")
    return out.withColumn("words", tx.n_words("markdown")).withColumn("prose_words", tx.prose_words("markdown"))


def variants(found: DataFrame) -> DataFrame:
    """The extracts with and without definitions, by a variant column."""
    full = references(found).withColumn("variant", F.lit("skill"))
    return full.unionByName(references(found, most_definitions=0).withColumn("variant", F.lit("skill_without_definitions")))


def quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def index(refs: DataFrame, titles: DataFrame, source: str | None = None) -> DataFrame:
    """book, name, markdown: frontmatter and a row for each chapter; titles (book, title)."""
    row = F.concat(F.lit("| "), "chapter", F.lit(". "), "title", F.lit(" | "), F.array_join("topics", ", "), F.lit(" | `"), "file", F.lit("` |"))
    by = refs.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("chapter_no", F.col("title").alias("t"), row.alias("row")))).alias("c")).join(titles, "book")
    names = F.array_join(F.transform("c", lambda x: x["t"]), "; ")
    whole = F.concat(F.lit('Knowledge from the book "'), "title", F.lit('": '), names, F.lit(". Use when a task needs the book's definitions, explanations or worked examples on these topics."))
    short = F.concat(F.regexp_replace(F.substring(whole, 1, DESCRIPTION - 4), "(?s);[^;]*$", ""), F.lit(" ..."))
    text = F.when(F.length(whole) > DESCRIPTION, short).otherwise(whole)
    licence = F.lit(f"license: {json.dumps(source, ensure_ascii=False)}\n" if source else "")
    credit = F.concat(F.lit("Extracted from *"), "title", F.lit(f"*: {source}.\n\n")) if source else F.lit("")
    how = "Each chapter of the book has a reference file with its sections, key definitions and worked examples. Find the chapter below whose topics match the task, then read only that file."
    name = tx.skill_name("title")
    md = F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), quoted(text), F.lit("\n"), licence, F.lit("---\n\n# "), "title", F.lit("\n\n"), credit, F.lit(how + "\n\n| Chapter | Topics | File |\n|---|---|---|\n"), F.array_join(F.transform("c", lambda x: x["row"]), "\n"), F.lit("\n"))
    return by.select("book", name.alias("name"), md.alias("markdown"))


def write(name: str, index_md: str, files: dict[str, str], out_dir: str | Path) -> Path:
    """Write one book's package below out_dir/name and remove reference files that it no longer has; other files stay."""
    if len(name) > 64 or not re.fullmatch("[a-z0-9]+(?:-[a-z0-9]+)*", name):
        raise ValueError(f"not a usable package name: {name!r}")
    root = Path(out_dir) / name
    (root / "references").mkdir(parents=True, exist_ok=True)
    keep = {Path(f).name for f in files}
    for old in (root / "references").glob("*.md"):
        if old.name not in keep:
            old.unlink()
    for file, text in {"SKILL.md": index_md, **files}.items():
        (root / file).write_bytes(text.encode())
    return root


def code_retention(found: DataFrame, refs: DataFrame) -> DataFrame:
    """book, kept, listings: multi-line listings of numbered chapters that stand verbatim in their chapter's extract."""
    code = structure.content(found).where((F.col("kind") == "code") & F.contains("text", F.lit("\n"))).join(refs.select(*KEY, "markdown"), KEY)
    return code.groupBy("book").agg(F.sum(F.contains("markdown", "text").cast("int")).alias("kept"), F.count("*").alias("listings"))
