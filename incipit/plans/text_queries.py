"""Text functions, markup, questions and the model arm over the standard tables, each with SQL that must give the same rows.

Where the tables hold no markup, a rule writes it into whole texts, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.operators import controls, evaluation, model_arm, retrieval, skill, stats, structure
from incipit.plans.queries import NW, SLUG, STOP, sql_grams, sql_sentences, sql_tokens, table
from incipit.scale import cut, shared_path
from incipit.sources import markup

SQL_LINE1 = "string_split(text, chr(10))[1]"


def line1() -> Column:
    return F.get(F.split("text", "\n"), F.lit(0))


def ascii_words(text: str = "text") -> Column:
    return tx.matches(F.col(text), "[A-Za-z]+")


def sql_parts(text: str, ends: str, starts: str) -> str:
    return f"string_split(regexp_replace({text}, '([{ends}])\\s+([{starts}])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def sql_rules(text: str, rules: list[tuple[str, str]]) -> str:
    """Rules of text.py as nested SQL; the pattern language of SQL has no back references or look-around."""
    for pattern, to in rules:
        if "(.*?)\\1" in pattern:
            continue
        if "(?<!" in pattern:
            pattern, to = r"(^|\W)[*_]{1,2}([^*_\n]+?)[*_]{1,2}(\W|$)", r"\1\2\3"
        else:
            to = to.replace(r"\$", "$") if to == r"\$" else to.replace("$1", r"\1").replace("$2", r"\2")
        quote = lambda s: s.replace("'", "''")
        text = f"regexp_replace({text}, '{quote(pattern)}', '{quote(to)}', 'g')"
    return text


def sql_squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def index_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", tx.index_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def sentence_with_term(spark, sf):
    """The sentence of each document's last word."""
    d = table(spark, sf, "documents").withColumn("term", F.try_element_at(ascii_words(), F.lit(-1)))
    return d.select("doc_id", F.md5(tx.sentence_with("text", "term")).alias("digest"))


def fidelity_tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", tx.fidelity_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


BASE = "[^\\p{Alnum}.,\\n ]+"
THREE = "([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)"


def markup_texts(spark, sf):
    """LaTeX and Asciidoc written into every document, and read back as plain text."""
    base = table(spark, sf, "documents").select("doc_id", tx.once(F.regexp_replace("text", BASE, " ")).alias("base"))
    tex = F.regexp_replace("base", THREE, r"\\emph{$1} {\\bf $2}\\index{$3!a}~``$3''--x\\_y\\footnote{$1} % gone $2" + "\n")
    asc = F.regexp_replace("base", THREE, r"*$1* `$2` <<there,$3>>(((a,$2))) footnote:[$1]")
    return base.select("doc_id", F.md5(tx.detex(tex)).alias("tex"), F.md5(tx.asciidoc_text(asc)).alias("asciidoc"))


SQL_BASE = "regexp_replace(text, '[^A-Za-z0-9.,\\n ]+', ' ', 'g')"
SQL_TEX = f"regexp_replace({SQL_BASE}, '{THREE}', '\\\\emph{{\\1}} {{\\\\bf \\2}}\\\\index{{\\3!a}}~``\\3''''--x\\\\_y\\\\footnote{{\\1}} % gone \\2' || chr(10), 'g')"
SQL_ASC = f"regexp_replace({SQL_BASE}, '{THREE}', '*\\1* `\\2` <<there,\\3>>(((a,\\2))) footnote:[\\1]', 'g')"
SQL_DETEX = sql_squeezed(sql_rules(f"regexp_replace({SQL_TEX}, '%[^\\n]*', '', 'g')", tx.TEX_RULES))
SQL_ASCLINES = f"list_filter(list_transform(string_split({SQL_ASC}, chr(10)), lambda s: trim(s)), lambda s: s <> '' and not regexp_matches(s, '^(\\[|image::|include::|//|=|:|\\|===)') and not regexp_matches(s, '^\\.[A-Za-z]'))"
SQL_ASCTEXT = sql_squeezed(sql_rules(f"array_to_string(list_transform({SQL_ASCLINES}, lambda s: regexp_replace(s, '^[*.]+\\s+', '')), ' ')", tx.ASCIIDOC_RULES))


#: Letters to what they are taken apart into: marks in and out of order, letters of Korean, and one that composes with nothing.
APART = {"é": "e\u0301", "ü": "u\u0308", "ä": "a\u0308", "ñ": "n\u0303", "ß": "ß\u0323\u0307", "the": "th\u1ebf\u0323", "en": "\u1112\u1161\u11ab", "ing": "i\u0307\u0323ng"}


def index_terms(spark, sf):
    """Index entries made of every three words of each document, and the spellings that are looked up."""
    w = table(spark, sf, "documents").select("doc_id", tx.once(ascii_words()).alias("w")).where(F.size("w") >= 3)
    at = F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)
    w = w.select("doc_id", "w", F.explode(at).alias("k")).select("doc_id", "k", *[F.get("w", 3 * F.col("k") + j).alias(f"w{j + 1}") for j in range(3)])
    entry = F.concat("w1", F.lit("!k@{\\bf "), "w2", F.lit("}|see{"), "w3", F.lit("}"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return w.select("doc_id", "k", tx.latex_term(entry).alias("latex"), tx.asciidoc_term(F.concat_ws(", ", "w1", "w2")).alias("asciidoc"), joined(tx.index_variants("w1")).alias("index_variants"), joined(tx.term_variants("w1")).alias("term_variants"))


def heading_numbers(spark, sf):
    d = table(spark, sf, "documents").withColumn("line", line1())
    h = tx.hevea_chapter(F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise("Chapter "), "doc_id", F.lit("  "), "line"))
    a = tx.asciidoctor_chapter(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ch0"), "doc_id", F.lit("-x"))).otherwise("B-x"), F.col("line"))
    return d.select("doc_id", h["number"].alias("hevea"), h["title"].alias("hevea_title"), a["number"].alias("asciidoctor"), a["title"].alias("asciidoctor_title"))


def names(spark, sf):
    """Names of packages and reference files, questions and titles that are not titles."""
    d = table(spark, sf, "documents").withColumn("line", line1()).withColumn("n", F.when(F.col("doc_id") % 7 == 0, "A").otherwise((F.col("doc_id") % 30).cast("string")))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat("n", F.lit(".PDF"))).otherwise(F.col("line"))
    return d.select("doc_id", tx.skill_name("line").alias("package"), tx.reference_file_name("n", "line").alias("file"), tx.reader_question("n").alias("question"), tx.junk_title(made).alias("junk"))


def search_questions(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "index").otherwise("glossary").alias("kind"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("term"), "text")
    return b.select("item_id", F.explode(tx.search_queries(F.col("kind"), F.col("term"), F.col("text"))).alias("q")).select("item_id", "q.qtype", "q.query")


FILES = ("references/ch01-user.md", "references/ch02-la.md", "references/ch03-x.md")


def replies(spark, sf):
    """Verdicts and routes read from replies."""
    said = F.concat(F.when(F.col("turn") % 2 == 0, "Correct: ").otherwise("in"), "text", F.element_at(F.array(F.lit(" ch02-la.md"), F.lit(""), F.lit(" references/ch03-x.md")), (F.col("turn") % 3 + 1).cast("int")))
    r = table(spark, sf, "conversations").withColumn("said", said).withColumn("r", tx.routed("said", F.array(*map(F.lit, FILES))))
    return r.select("conv_id", "turn", tx.says_correct("said").alias("correct"), F.col("r.file").alias("file"), F.col("r.ok").alias("ok"))


def prompts(spark, sf):
    """Digests of the model arm's prompts over consecutive turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    made = {"answer": model_arm.answer_prompt(F.col("next"), F.col("text")), "route": model_arm.route_prompt(F.col("next"), F.col("text")), "judge": model_arm.judge_prompt(F.col("role"), F.col("text"), F.col("next"))}
    return c.select("conv_id", "turn", *[F.md5(v).alias(k) for k, v in made.items()])


def markdown_parts(spark, sf):
    """Conversations as Markdown, replies as listings with blank lines: read back, a part is a turn."""
    flat = F.trim(F.regexp_replace("text", r"[^\p{Alnum}.,]+", " "))
    fence = F.lit("```")
    part = F.when(F.col("role") == "assistant", F.concat(fence, F.lit("\n"), flat, F.lit("\n\nx\n\n"), flat, F.lit("\n"), fence)).otherwise(flat)
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("md"))
    return c.select("conv_id", F.posexplode(retrieval.markdown_pieces("md")).alias("part", "text")).select("conv_id", "part", F.md5("text").alias("digest"))


def latex_glossaries(spark, sf):
    """A LaTeX book of every document, its glossary naming the first word of each sentence; read back by chapter."""
    w = tx.matches(F.regexp_replace("text", "[^\\p{Alnum}. ]+", " "), "[A-Z][a-z]+ [a-z]+")
    items = F.array_join(F.transform("w", lambda x: F.concat(F.lit("\\item["), F.split(x, " ")[0], F.lit(":] {\\em "), x, F.lit("} is it.\n"))), "")
    tex = F.concat(F.lit("front \\chapter{No}\\mainmatter \\chapter{The {\\em one} "), "doc_id", F.lit("} body\n\\section{Glossary}\\begin{description}\n"), items, F.lit("\\end{description}\n\\section{Exercises} \\item[no] none\n\\appendix \\chapter{Gone}"))
    src = table(spark, sf, "documents").select("doc_id", tx.once(w).alias("w")).where(F.size("w") > 0).select(F.col("doc_id").alias("book"), tex.alias("tex"))
    return markup.glossary(markup.latex_chapters(src)).select("book", F.col("chapter").cast("long").alias("chapter"), "chapter_title", F.col("k").cast("long").alias("k"), "term", "definition")


def asciidoc_index(spark, sf):
    """Index questions of a book whose chapters are sources and whose paragraphs are documents that name their first words."""
    clean = tx.squeezed(F.regexp_replace("text", "[^\\p{Alnum}., ]+", " "))
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), clean.alias("t")).withColumn("w", F.slice(tx.matches(F.col("t"), "[A-Za-z]{3,}"), 1, 2)).where(F.size("w") == 2)
    rows = d.select(F.col("source").alias("chapter"), F.concat(F.lit("On "), "source").alias("chapter_title"), F.col("doc_id").alias("block_no"), F.concat(F.lit("((("), F.array_join("w", ","), F.lit(")))"), "t").alias("raw"), F.col("t").alias("prose"))
    items = controls.items_from_anchors(markup.anchored(rows, markup.ASCIIDOC_INDEX, tx.asciidoc_term), "b", table(spark, sf, "benchmark").select(F.explode(F.transform(ascii_words(), F.lower)).alias("term")).distinct())
    return items.select("qid", "chapter", "chapter_title", "term", F.size("evidence").cast("long").alias("evidence"), F.md5(F.array_join("evidence", "|")).alias("digest"), "in_glossary", "split")


def defect_counts(spark, sf):
    """Broken and glued words, written into every document, against the words of the benchmark."""
    broken = F.regexp_replace("text", "([a-z]{3,}+) ([a-z]{3,}+)", "$1$2")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.once(broken).alias("broken"))
    texts = docs.select("id", F.concat(F.regexp_replace("broken", "([A-Za-z]{3})([a-z]{3,})", "$1- $2"), F.lit(" ﬁ "), "broken").alias("text"))
    vocab = cut(table(spark, sf, "benchmark").select(F.explode(tx.vocabulary("text")).alias("word")).distinct(), "vocabulary")
    return stats.defects(texts, vocab).select("id", "ligature_glyphs", "broken_hyphenations", "glued_words")


def code_found(spark, sf):
    """Lines of every document as an indented listing, backwards in every third: found verbatim?"""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    body = F.when(F.col("doc_id") % 3 == 0, F.reverse(lines)).otherwise(lines)
    code = F.array_join(F.transform(body, lambda x, k: F.concat(F.when(k % 2 == 1, "        ").otherwise("    "), x, F.lit("  "))), "\n")
    whole = F.array_join(F.transform(lines, lambda x, k: F.concat(F.when(k % 2 == 1, "    ").otherwise(""), x)), "\n")
    return stats.code_recovery(table(spark, sf, "documents").select(F.col("lang").alias("id"), whole.alias("extracted"), code.alias("code")))


def answers_summary(spark, sf):
    """Conversations as outcomes of the model arm: turns are conditions, four by four, every outcome is given twice."""
    c = table(spark, sf, "conversations").where("text is not null and turn is not null")
    o = c.select(F.col("turn").alias("ord"), (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 4)).alias("qid"), F.lit("skill").alias("skill_variant"), F.element_at(F.array(*map(F.lit, model_arm.CONDITIONS)), (F.col("turn") % 4 + 1).cast("int")).alias("condition"), (F.length("text") % 2 == 0).alias("correct"), ((F.length("text") % 8) / 8).alias("f1"), (F.length("text") % 3 == 0).alias("routed_ok"), (F.length("text") % 5 == 0).alias("routed_to_gold_chapter"))
    twice = o.withColumn("ord", F.col("ord") - 1000).withColumn("correct", ~F.col("correct")).unionByName(o)
    return model_arm.outcomes_summary(twice).select("condition", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "routed_ok", "routed_to_gold", "diff_rag")])


def cached_replies(spark, sf):
    """A transport that turns prompts round, asked twice: the second time all replies come from the cache."""
    asked = table(spark, sf, "benchmark").where("text is not null").select(F.lit("m").alias("model"), F.lit("").alias("system"), F.col("text").alias("prompt"), F.lit("{}").alias("options"), "item_id")
    cache = shared_path(spark, "replies")
    first, again = (cut(model_arm.generate(asked, cache, lambda model, system, prompt, options: prompt[::-1]), "answers") for _ in range(2))
    return first.select("item_id", "response", "hit").unionByName(again.select("item_id", "response", "hit"))


def chapters_cut(spark, sf):
    return model_arm.truncated_chapters(table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text")), 60).select("chapter", F.md5("text").alias("digest"), "words", "kept_words", "truncated")


def term_said(spark, sf):
    """Does each document say the first word of the one before it (of its source)?"""
    d = table(spark, sf, "documents").select("doc_id", "text", F.lag(F.get(ascii_words(), F.lit(0))).over(Window.partitionBy("source").orderBy("doc_id")).alias("term"))
    items = d.where("term is not null").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("chapter"), "term")
    return model_arm.term_mentioned(items, d.select(F.col("doc_id").alias("chapter"), F.col("text").alias("markdown")))


def call_plan(spark, sf):
    """Conversations as chapters of a book for each last digit, turns as its questions."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("book"), "conv_id")
    return model_arm.call_plan(c.groupBy("book").agg(F.countDistinct("conv_id").alias("chapters"), F.count("*").alias("questions")))


def included_files(spark, sf):
    """Documents as files of an edition, of which every fourth line includes another: in other folders, missing, outside, or itself."""
    d = table(spark, sf, "documents").where("text is not null")
    name = lambda i: F.concat(F.lit("part"), i % 5, F.lit("/"), i, F.lit(".asc"))
    target = lambda k: F.when((k + F.col("doc_id")) % 7 == 0, F.concat(F.col("doc_id"), F.lit(".asc"))).when(k % 3 == 0, F.concat(F.lit("../"), name(3 * F.col("doc_id") + 1 + k % 2))).when(k % 3 == 1, F.lit("../../outside.asc")).otherwise(F.concat(F.lit("./../part0/../"), name(3 * F.col("doc_id") + 2)))
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 4 == 1, F.concat(F.lit("include::"), target(k), F.lit("[] "), x)).otherwise(x)), "\n")
    files = cut(d.select(name(F.col("doc_id")).alias("path"), text.alias("text")), "files")
    return markup.expanded(files, files.select("path")).select("path", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def composed_texts(spark, sf):
    """Documents with letters taken apart, marks out of order among them, in composed form."""
    t = F.col("text")
    for a, b in APART.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf, "documents").select("doc_id", tx.nfc(t).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


def rag_contexts(spark, sf):
    """Conversation turns as ranked units: the five first, joined."""
    c = table(spark, sf, "conversations").where("text is not null").withColumn("doc", F.col("conv_id") * 1000 + F.col("turn"))
    return model_arm.rag_context(c.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), "doc"), c.select("doc", "text")).select("qid", F.md5("context").alias("digest"))


QUERIES = {f.__name__: f for f in (
    index_sentences, sentence_with_term, fidelity_tokens, markup_texts, index_terms, heading_numbers, names, search_questions, replies, prompts, markdown_parts, latex_glossaries, asciidoc_index, defect_counts, code_found, answers_summary, cached_replies,
    chapters_cut, term_said, call_plan, rag_contexts, included_files, composed_texts,
)}

def apart_sql(text: str) -> str:
    for a, b in APART.items():
        text = f"replace({text}, '{a}', '{b}')"
    return text


W3 = "(select doc_id, k, w[3 * k + 1] as w1, w[3 * k + 2] as w2, w[3 * k + 3] as w3 from (select doc_id, w, unnest(range(len(w) // 3)) as k from (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as w from documents)))"
SQL_SLUG64 = f"case when regexp_replace({SLUG}[1:64], '-+$', '') = '' then 'untitled' else regexp_replace({SLUG}[1:64], '-+$', '') end"
SQL_SLUG40 = SQL_SLUG64.replace("1:64", "1:40")
SQL_PIECE = "trim(regexp_replace(text, '[^A-Za-z0-9.,]+', ' ', 'g'))"
SQL_GAPS = "list_filter(list_transform({}, lambda x: trim(x)), lambda x: x <> '')"
SQL_CLEAN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9., ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
DIGITS = "list_sum(list_transform(string_split(sha256('b' || chr(0) || lower(term)), ''), lambda c: strpos('0123456789abcdef', c) - 1))"

ORACLES = {
    "index_sentences": f"""with s as (select doc_id, list_filter({SQL_GAPS.format(sql_parts("text", ".?!:", "A-Z\"''(`"))}, lambda x: {NW.format('x').replace('lambda x: x', 'lambda y: y')} >= 5) as s from documents)
      select doc_id, len(s)::bigint as n, md5(array_to_string(s, '|')) as digest from s""",
    "sentence_with_term": f"""with d as (select *, lower(regexp_extract_all(text, '[A-Za-z]+')[-1]) as term from documents)
      select doc_id, md5(coalesce(list_filter({sql_parts("text", ".?!:", "A-Z\"(")}, lambda s: contains(lower(s), term))[1], text)) as digest from d""",
    "fidelity_tokens": """with t as (select doc_id, regexp_extract_all(translate(text, '‘’“”–—−' || chr(160) || '•', '''''""---  '), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]') as t from documents)
      select doc_id, len(t)::bigint as n, md5(array_to_string(t, ' ')) as digest from t""",
    "markup_texts": f"select doc_id, md5({SQL_DETEX}) as tex, md5({SQL_ASCTEXT}) as asciidoc from documents",
    "index_terms": f"""select doc_id, k::int as k, case when regexp_matches(w2 || ' ' || w1, '[A-Za-z]{{2}}') then w2 || ' ' || w1 else '' end as latex, w2 || ' ' || w1 as asciidoc,
      array_to_string(list_sort(list_distinct([lower(w1), regexp_replace(lower(w1), 's+$', ''), lower(w1) || 's'] || case when ends_with(lower(w1), 'ies') then [regexp_replace(lower(w1), 'ies$', 'y')] else [] end)), ',') as index_variants,
      array_to_string(list_sort([lower(w1), lower(w1) || 's', lower(w1) || 'es'] || case when ends_with(lower(w1), 'y') then [regexp_replace(lower(w1), 'y$', 'ies')] else [] end), ',') as term_variants from {W3}""",
    "heading_numbers": f"""with d as (select doc_id, {SQL_LINE1} as line from documents) select doc_id, case when doc_id % 3 = 0 then '' else doc_id::varchar end as hevea, case when doc_id % 3 = 0 then doc_id || '  ' || line else trim(regexp_replace(line, '^\\s+', '')) end as hevea_title,
      case when doc_id % 2 = 0 then doc_id::varchar else 'B' end as asciidoctor, line as asciidoctor_title from d""",
    "names": f"""with d as (select doc_id, {SQL_LINE1} as line, case when doc_id % 7 = 0 then 'A' else (doc_id % 30)::varchar end as n from documents)
      select doc_id, {SQL_SLUG64} as package, 'references/ch' || case when length(n) = 1 and n <> 'A' then '0' || n else n end || '-' || {SQL_SLUG40} || '.md' as file, 'In the book, what is meant by "' || n || '"?' as question,
      doc_id % 3 = 0 or line is null or trim(line) = '' or not regexp_matches(line, '[A-Za-z]{{2}}') or regexp_matches(line, '(?i)^\\s*(microsoft word|untitled|document\\d*$|powerpoint)') as junk from d""",
    "search_questions": """with b as (select item_id, text, regexp_extract(text, '[A-Za-z]+') as term from benchmark)
      select item_id, 'term' as qtype, case when item_id % 2 = 0 then 'Where does the book explain ' || term || '?' else 'What is ' || term || '?' end as query from b union all select item_id, 'definition', text from b where item_id % 2 <> 0""",
    "replies": f"""with s as (select conv_id, turn, case when turn % 2 = 0 then 'Correct: ' else 'in' end || text || case turn % 3 when 0 then ' ch02-la.md' when 1 then '' else ' references/ch03-x.md' end as said from conversations),
      h as (select *, list_filter([{', '.join(f"'{f}'" for f in FILES)}], lambda f: contains(said, split_part(f, '/', 2)))[1] as hit from s)
      select conv_id, turn, regexp_extract(upper(said), '[A-Z]+') = 'CORRECT' as correct, coalesce(hit, '{FILES[0]}') as file, hit is not null as ok from h""",
    "prompts": """with c as (select *, coalesce(lead(text) over (partition by conv_id order by turn), '') as nxt, chr(10) as nl from conversations)
      select conv_id, turn, md5(case when nxt = '' then '' else 'Use this text:' || nl || nl || nxt || nl || nl end || 'Answer in one or two sentences.' || nl || nl || 'Question: ' || text) as answer,
      md5('Which one file of this index answers the question? Reply with its path only.' || nl || nl || nxt || nl || nl || 'Question: ' || text) as route,
      md5('Does the answer say the same as the reference? Reply CORRECT or INCORRECT.' || nl || nl || 'Question: ' || role || nl || 'Reference: ' || text || nl || 'Answer: ' || nxt) as judge from c""",
    "markdown_parts": f"""with p as (select conv_id, turn, case when role = 'assistant' then '```' || chr(10) || {SQL_PIECE} || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || {SQL_PIECE} || chr(10) || '```' else {SQL_PIECE} end as t from conversations)
      select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as part, md5(t) as digest from p where t <> ''""",
    "latex_glossaries": """with w as (select doc_id, regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9. ]+', ' ', 'g'), '[A-Z][a-z]+ [a-z]+') as w from documents), u as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w)
      select doc_id as book, 1::bigint as chapter, 'The one ' || doc_id as chapter_title, i - 1 as k, split_part(w[i], ' ', 1) as term, w[i] || ' is it.' as definition from u""",
    "asciidoc_index": f"""with d as (select doc_id, coalesce(source, '-') as source, {SQL_CLEAN} as t from documents), w as (select *, regexp_extract_all(t, '[A-Za-z]{{3,}}')[1:2] as w from d), e as (select doc_id, source, w[2] || ' ' || w[1] as term, lower(w[2] || ' ' || w[1]) as key, first_value(case when {NW.format('t')} >= 5 then t end ignore nulls) over (partition by source order by doc_id rows between current row and unbounded following) as t from w where len(w) = 2),
      f as (select *, row_number() over (partition by key order by source, doc_id) as r, first_value(source) over (partition by key order by source, doc_id) as home from e where t is not null), n as (select *, row_number() over (order by source, doc_id) - 1 as n from f where r = 1),
      p as (select distinct on (key, t) key, t, doc_id as o from f where source = home order by key, t, doc_id), g as (select key, flatten(list(list_filter({SQL_GAPS.format(sql_parts("t", ".?!:", "A-Z\"''(`"))}, lambda x: {NW.format('x').replace('lambda x: x', 'lambda y: y')} >= 5) order by o)) as ev from p group by 1),
      v as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as v from benchmark)
      select 'b-idx-' || lpad(n::varchar, 4, '0') as qid, source as chapter, 'On ' || source as chapter_title, term, len(ev)::bigint as evidence, md5(array_to_string(ev, '|')) as digest, exists(select 1 from v where v = key or v = regexp_replace(key, 's+$', '') or v = key || 's') as in_glossary, case when {DIGITS} % 5 = 0 then 'test' else 'dev' end as split from n join g using (key) where len(ev) > 0""",
    "defect_counts": """with b as (select doc_id, regexp_replace(text, '([a-z]{3,}) ([a-z]{3,})', '\\1\\2', 'g') as b from documents), t as (select doc_id as id, regexp_replace(b, '([A-Za-z]{3})([a-z]{3,})', '\\1- \\2', 'g') || ' ﬁ ' || b as t from b),
      v as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from benchmark), h as (select id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+-\\s+[\\p{L}\\p{N}_]+')) as m from t),
      x as (select id, count(*) as broken from h where regexp_matches(m, '^[A-Za-z]{2,}-\\s+[a-z]{2,}$') and lower(regexp_replace(m, '-\\s+', '')) in (select word from v) group by 1),
      l as (select id, w as word, count(*) as times from (select id, unnest(regexp_extract_all(lower(t), '[a-z]+')) as w from t) where length(w) >= 7 and w not in (select word from v) group by all),
      c as (select distinct id, word, times from (select *, unnest(range(3, length(word) - 2)) as k from l) where word[1:k] in (select word from v) and word[k + 1:] in (select word from v)), g as (select id, sum(times)::bigint as glued from c group by 1)
      select id, 1::bigint as ligature_glyphs, coalesce(broken, 0) as broken_hyphenations, coalesce(glued, 0)::bigint as glued_words from t left join x using (id) left join g using (id)""",
    "answers_summary": """with o as (select conv_id * 1000 + turn // 4 as conv_id, turn % 4 as turn, length(text) as n from conversations where text is not null and turn is not null), r as (select conv_id, (n % 2 = 0)::int as r from o where turn = 1)
      select ['closed_book', 'rag', 'skill', 'both'][turn + 1] as condition, count(*) as n, round(avg((n % 2 = 0)::int), 6) as accuracy, round(avg((n % 8) / 8), 6) as f1, round(avg((n % 3 = 0)::int), 6) as routed_ok, round(avg((n % 5 = 0)::int), 6) as routed_to_gold, round(avg((n % 2 = 0)::int - r), 6) as diff_rag from o left join r using (conv_id) group by 1""",
    "cached_replies": "select item_id, reverse(text) as response, hit from benchmark, (select unnest([false, true]) as hit) where text is not null",
    "chapters_cut": f"""with c as (select conv_id, turn, coalesce(text, '') as t, {NW.format("coalesce(text, '')")} as n from conversations), u as (select *, sum(n) over (partition by conv_id order by turn) <= 60 as fits from c)
      select conv_id as chapter, md5(coalesce(string_agg(t, chr(10) || chr(10) order by turn) filter (where fits), '')) as digest, sum(n)::bigint as words, coalesce(sum(n) filter (where fits), 0)::bigint as kept_words, coalesce(sum(n) filter (where fits), 0) < sum(n) as truncated from u group by 1""",
    "term_said": """with d as (select doc_id, text, lag(regexp_extract_all(text, '[A-Za-z]+')[1]) over (partition by source order by doc_id) as term from documents)
      select doc_id as qid, coalesce(regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || lower(term)), false) as mentioned from d where term is not null""",
    "call_plan": "select conv_id % 10 as book, count(distinct conv_id) as chapters, count(*) as questions, 20::bigint as per_question, count(distinct conv_id) + 20 * count(*) as total from conversations group by 1",
    "included_files": """
with recursive lines as (select doc_id, k, l[k + 1] as x, k = len(l) - 1 as last from (select doc_id, l, unnest(range(0, len(l))) as k from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))),
 inc as (select *, k % 4 = 1 as has, case when k % 4 <> 1 then null when (k + doc_id) % 7 = 0 then doc_id when k % 3 = 0 then 3 * doc_id + 1 + k % 2 when k % 3 = 1 then null else 3 * doc_id + 2 end as target from lines),
 r as (select doc_id as top, doc_id as file, [doc_id] as within, []::bigint[] as place from documents where text is not null
   union all select r.top, i.target, list_append(r.within, i.target), list_append(list_append(r.place, i.k::bigint), 0) from r join inc i on i.doc_id = r.file join documents d on d.doc_id = i.target where d.text is not null and not list_contains(r.within, i.target)),
 t as (select r.top, list_append(list_append(r.place, i.k::bigint), 1) as place, case when has then ' ' else '' end || x || case when last then '' else chr(10) end as t from r join inc i on i.doc_id = r.file)
 select 'part' || (top % 5) || '/' || top || '.asc' as path, length(string_agg(t, '' order by place))::int as chars, md5(string_agg(t, '' order by place)) as digest from t group by top""",
    "composed_texts": "select doc_id, md5(nfc_normalize(t)) as digest, length(nfc_normalize(t))::int as chars from (select doc_id, " + apart_sql("text") + " as t from documents)",
    "rag_contexts": "select conv_id as qid, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn)) as digest from conversations where text is not null and turn < 5 group by 1",
    "code_found": """with l as (select doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents), m as (select lang, doc_id % 3 <> 0 or len(list_distinct(l)) = 1 or (l = list_reverse(l)) as found from l where len(l) > 1)
      select lang as id, count(*) as blocks, count(*) as indented_blocks, round(avg(found::int), 4) as exact, round(avg(found::int), 4) as exact_indented from m group by 1""",
}
