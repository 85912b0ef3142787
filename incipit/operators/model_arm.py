"""The optional model arm: prompts, a cached and injectable transport, answers, verdicts and their summary.

Replies are a table keyed by a hash of the request; a left-anti join finds the requests without a reply, and only those
meet the transport, in the tasks. No transport is built in: the caller passes a function.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.operators import retrieval, stats
from incipit.scale import cut, exists

CONDITIONS = ("closed_book", "rag", "skill", "both")
REPLY = "key string, model string, system string, prompt string, options string, response string"


def cache_key(model: str, system: str, prompt: str, options: str) -> str:
    """SHA-256 of the request as JSON with sorted keys; options is JSON itself."""
    body = {"model": model, "system": system, "prompt": prompt, "options": json.loads(options)}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def keyed(requests: DataFrame) -> DataFrame:
    """requests (model, system, prompt, options) with key."""

    @F.pandas_udf("string")
    def key(m: pd.Series, s: pd.Series, p: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([cache_key(*r) for r in zip(m, s, p, o, strict=True)])

    return requests.withColumn("key", key("model", "system", "prompt", "options"))


def cached(spark, cache: str, keys: DataFrame) -> DataFrame:
    """key, response of those keys that the cache has; of several replies to one request the first that was committed counts."""
    if not exists(spark, f"{cache}/_SUCCESS"):
        return spark.createDataFrame([], "key string, response string")
    known = spark.read.schema(REPLY + ", at string, shard string").parquet(cache).join(keys.select("key"), "key", "left_semi")
    return known.groupBy("key").agg(F.min(F.struct("at", "response")).alias("m")).select("key", "m.response")


def generate(requests: DataFrame, cache: str, transport: Callable[[str, str, str, dict], str]) -> DataFrame:
    """requests with response and hit (was it cached?). New replies go to the cache, a Parquet table by the key's first digits.

    transport(model, system, prompt, options) runs in the tasks; what it raises fails the job, and replies of finished runs
    stay. Two runs at once may both ask for a reply; both then return, and every later run too, the one of the first.
    """
    spark = requests.sparkSession
    asked = cut(keyed(requests), "requests")
    keys = cut(asked.select("key").distinct(), "keys")
    seen = cut(cached(spark, cache, keys), "cached")
    misses = asked.select("key", "model", "system", "prompt", "options").dropDuplicates(["key"]).join(seen.select("key"), "key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(response=[transport(r.model, r.system, r.prompt, json.loads(r.options)) for r in pdf.itertuples()])

    fresh = cut(misses.mapInPandas(call, REPLY), "replies")
    at = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # of this run: orders runs, and tells them apart
    fresh.withColumns({"at": F.lit(at), "shard": F.substring("key", 1, 2)}).write.mode("append").partitionBy("shard").parquet(cache)
    replies = cut(cached(spark, cache, keys), "merged")
    return asked.join(replies, "key").join(seen.select("key", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def chapter_prompt(title: Column, text: Column, budget: int) -> Column:
    return F.concat(F.lit(f"Write a reference file of about {budget} words in Markdown for an agent that has not read the chapter. Headings: When to use, Sections, Key definitions, Worked examples. Use only the text.\n\nChapter: "), title, F.lit("\n\n"), text)


def route_prompt(index: Column, question: Column) -> Column:
    return F.concat(F.lit("Which one file of this index answers the question? Reply with its path only.\n\n"), index, F.lit("\n\nQuestion: "), question)


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.when(context == "", "").otherwise(F.concat(F.lit("Use this text:\n\n"), context, F.lit("\n\n"))), F.lit("Answer in one or two sentences.\n\nQuestion: "), question)


def judge_prompt(question: Column, reference: Column, answer: Column) -> Column:
    return F.concat(F.lit("Does the answer say the same as the reference? Reply CORRECT or INCORRECT.\n\nQuestion: "), question, F.lit("\nReference: "), reference, F.lit("\nAnswer: "), answer)


def truncated_chapters(parts: DataFrame, most_words: int = 9000) -> DataFrame:
    """chapter, text, words, kept_words, truncated: parts (chapter, ord, text) in order until the words go over the limit."""
    w = Window.partitionBy("chapter").orderBy("ord")
    rows = parts.withColumn("n", tx.n_words("text")).withColumn("upto", F.sum("n").over(w))
    fits = F.col("upto") <= most_words
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(fits, F.struct("ord", "text")))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("chapter").agg(text.alias("text"), F.sum("n").alias("words"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("kept_words")).withColumn("truncated", F.col("kept_words") < F.col("words"))


def rag_context(ranked: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """qid, context: the k best units, in rank order."""
    rows = ranked.where(F.col("rank") <= k).join(units.select("doc", "text"), "doc")
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("context"))


HEADINGS = ("When to use", "Sections", "Key definitions", "Worked examples")
Ask = Callable[[DataFrame], DataFrame]


def asking(model: str, cache: str, transport: Callable[[str, str, str, dict], str], system: str = "", options: str = "{}") -> Ask:
    """A function from prompts (with any other columns) to the same rows with reply, through the cache."""

    def ask(prompts: DataFrame) -> DataFrame:
        rows = prompts.withColumns({"model": F.lit(model), "system": F.lit(system), "options": F.lit(options)})
        return cut(generate(rows, cache, transport).withColumn("reply", F.trim("response")).drop("key", "response", "hit", "model", "system", "options", "prompt"), "asked")

    return ask


def written_skill(parts: DataFrame, budgets: DataFrame, ask: Ask, most_words: int = 9000) -> tuple[DataFrame, DataFrame]:
    """A reference file of each chapter by a model: (chapter, title, markdown), and a report (words, budget, missing headings, truncation).

    parts (chapter, title, ord, text) in order, budgets (chapter, budget).
    """
    titles = parts.select("chapter", "title").distinct()
    cut_texts = truncated_chapters(parts.select("chapter", "ord", "text"), most_words)
    rows = cut_texts.join(titles, "chapter").join(budgets, "chapter", "left").withColumn("budget", F.coalesce("budget", F.lit(600)))
    prompt = F.concat(F.lit("Write a reference file of about "), F.col("budget").cast("string"), F.lit(" words in Markdown for an agent that has not read the chapter. Headings: " + ", ".join(HEADINGS) + ". Use only the text.\n\nChapter: "), "title", F.lit("\n\n"), "text")
    made = ask(rows.withColumn("prompt", prompt).drop("text"))
    missing = F.filter(F.array(*map(F.lit, HEADINGS)), lambda h: ~F.contains(F.col("reply"), h))
    report = made.select("chapter", tx.n_words("reply").alias("words"), "budget", missing.alias("missing_headings"), "truncated", "kept_words", F.col("words").alias("chapter_words"))
    return made.select("chapter", "title", F.concat("reply", F.lit("\n")).alias("markdown")), report


def run_items(items: DataFrame, units: DataFrame, skills: DataFrame, indexes: DataFrame, ask: Ask, judges: list[Ask], k: int = 5) -> DataFrame:
    """Every question under every condition, graded: outcomes as outcomes_summary() takes them, with answer and routed_file.

    items (qid, chapter, term, definition), units (doc, text), skills (skill_variant, chapter, ord, file, markdown), indexes
    (skill_variant, markdown). Closed book and retrieval do not depend on a skill and are asked once, under the variant "-".
    The prompts of a step go out as one table, so a step is one pass through the cache and the tasks.
    """
    items = cut(items.select("qid", "chapter", "term", "definition", tx.reader_question("term").alias("question")), "arm-items")
    top = retrieval.bm25_topk(items.select("qid", F.col("question").alias("query")), units, k)
    context = cut(items.select("qid").join(rag_context(top, units, k), "qid", "left").fillna("", ["context"]), "arm-contexts")
    files = skills.groupBy("skill_variant").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "file"))), lambda x: x["file"]).alias("files"))
    asked = items.join(indexes.join(files, "skill_variant"), F.lit(True))  # questions by variants, a few
    routes = ask(asked.select("qid", "chapter", "skill_variant", "files", route_prompt(F.col("markdown"), F.col("question")).alias("prompt")))
    routes = routes.withColumn("r", tx.routed("reply", F.col("files"))).select("qid", "chapter", "skill_variant", F.col("r.file").alias("file"), F.col("r.ok").alias("routed_ok"))
    opened = routes.join(skills.select("skill_variant", "file", "markdown", F.col("chapter").alias("of")), ["skill_variant", "file"]).join(context, "qid")
    gold = F.coalesce(F.col("of") == F.col("chapter"), F.lit(False))
    both = F.concat("markdown", F.lit("\n\n---\n\n"), "context")
    row = lambda n, c, text: F.struct(F.lit(n).alias("n"), F.lit(c).alias("condition"), text.alias("text"))
    by_skill = opened.select("qid", "skill_variant", "file", "routed_ok", gold.alias("routed_to_gold_chapter"), F.explode(F.array(row(2, "skill", F.col("markdown")), row(3, "both", both))).alias("c"))
    alone = context.select("qid", F.lit("-").alias("skill_variant"), F.lit("").alias("file"), F.lit(True).alias("routed_ok"), F.lit(False).alias("routed_to_gold_chapter"), F.explode(F.array(row(0, "closed_book", F.lit("")), row(1, "rag", F.col("context")))).alias("c"))
    todo = alone.unionByName(by_skill).select("qid", "skill_variant", "file", "routed_ok", "routed_to_gold_chapter", "c.*").join(items.drop("chapter"), "qid")
    answers = ask(todo.withColumn("prompt", answer_prompt(F.col("text"), F.col("question"))).drop("text")).withColumnRenamed("reply", "answer")
    graded = stats.token_f1(answers, "answer", "definition")
    for n, judge in enumerate(judges):
        said = judge(graded.withColumn("prompt", judge_prompt(F.col("question"), F.col("definition"), F.col("answer"))))
        graded = said.withColumn("correct" if n == 0 else "correct_second_judge", tx.says_correct("reply")).drop("reply")
    if len(judges) < 2:
        graded = graded.withColumn("correct_second_judge", F.lit(None).cast("boolean"))
    return graded.select(F.col("n").cast("long").alias("ord"), "qid", "skill_variant", "condition", "answer", "correct", "f1", F.col("file").alias("routed_file"), "routed_ok", "routed_to_gold_chapter", "correct_second_judge")


def calls(chapters: int, questions: int, variants: int = 2, judges: int = 2) -> dict[str, int]:
    """Planned requests: a chapter once, and for each question closed book and retrieval, and route and two answers a variant, all judged."""
    per = (2 + 3 * variants) + (2 + 2 * variants) * judges
    return {"chapters": chapters, "questions": questions, "per_question": per, "total": chapters + questions * per}


def call_plan(books: DataFrame, variants: int = 2, judges: int = 2) -> DataFrame:
    """books (book, chapters, questions) with per_question and total, as calls() counts them."""
    per = calls(0, 0, variants, judges)["per_question"]
    return books.withColumn("per_question", F.lit(per).cast("long")).withColumn("total", F.col("chapters") + F.col("questions") * F.col("per_question"))


def term_mentioned(items: DataFrame, refs: DataFrame) -> DataFrame:
    """qid, mentioned: does the chapter's file hold the term at the start of a word?"""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(F.lower("term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    return items.join(refs.select("chapter", "markdown"), "chapter", "left").select("qid", F.coalesce(F.regexp_like(F.lower("markdown"), quoted), F.lit(False)).alias("mentioned"))


def outcomes_summary(outcomes: DataFrame) -> DataFrame:
    """skill_variant, condition, n, accuracy, f1, route rates, and accuracy against rag on the questions both have; of repeated questions the last counts.

    outcomes (ord, qid, skill_variant, condition, correct, f1, routed_ok, routed_to_gold_chapter)."""
    last = Window.partitionBy("skill_variant", "condition", "qid").orderBy(F.desc("ord"))
    o = outcomes.withColumn("k", F.row_number().over(last)).where("k = 1").withColumn("c", F.col("correct").cast("int"))
    rag = o.where("condition = 'rag'").groupBy("qid").agg(F.max(F.struct("ord", "c"))["c"].alias("rag"))
    return o.join(rag, "qid", "left").groupBy("skill_variant", "condition").agg(
        F.count("*").alias("n"), F.avg("c").alias("accuracy"), F.avg("f1").alias("f1"), F.avg(F.col("routed_ok").cast("int")).alias("routed_ok"), F.avg(F.col("routed_to_gold_chapter").cast("int")).alias("routed_to_gold"), F.avg(F.col("c") - F.col("rag")).alias("diff_rag"),
    )
