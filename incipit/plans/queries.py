"""Queries over the standard tables, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.operators import controls, retrieval, stats
from incipit.scale import cut, shared_path
from incipit.sources import html


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------- SQL of the functions

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
STEM = """case when ends_with(t, 'ies') and length(t) >= 6 then left(t, length(t) - 3) || 'y' when ends_with(t, 'sses') and length(t) >= 7 then left(t, length(t) - 2)
 when ends_with(t, 'es') and length(t) >= 5 then left(t, length(t) - 1) when ends_with(t, 's') and length(t) >= 4 and not (ends_with(t, 'ss') or ends_with(t, 'us') or ends_with(t, 'is')) then left(t, length(t) - 1)
 when ends_with(t, 'ing') and length(t) >= 7 then left(t, length(t) - 3) when ends_with(t, 'ed') and length(t) >= 6 then left(t, length(t) - 2) else t end"""


def sql_tokens(source: str, key: str, text: str) -> str:
    """key, tok: a row a token."""
    return f"select {key}, {STEM} as tok from (select {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as t from {source}) where t not in ({STOP})"


def sql_parts(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.?!])\\s+([A-Z(\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def sql_sentences(text: str) -> str:
    return f"list_filter(list_transform({sql_parts(text)}, lambda x: trim(x)), lambda x: x <> '')"


PLAIN = "translate({}, '‘’“”–—−' || chr(160) || '•', '''''\"\"---  ')"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({PLAIN.format(text)}), '[a-z0-9]+')"


def sql_grams(source: str, key: str, text: str) -> str:
    """key, gram: distinct trigrams."""
    return f"""select distinct {key}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from (select {key}, w, unnest(range(1, len(w) - 1)) as i from (select {key}, {sql_words(text)} as w from {source}) where len(w) >= 3)"""


BM25 = f"""
 dt as ({sql_tokens('documents', 'doc_id', 'text')}), qt as ({sql_tokens('benchmark', 'item_id', 'text')}),
 tf as (select doc_id, tok, count(*) as tf from dt group by all), qf as (select item_id, tok, count(*) as qf from qt group by all),
 dl as (select d.doc_id, count(dt.tok) as len from documents d left join dt using (doc_id) group by 1),
 n as (select count(*) as n, avg(len) as avg from dl), df as (select tok, count(*) as df from tf group by 1),
 sc as (select item_id as qid, doc_id as doc, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg))) as score
   from qf join tf using (tok) join df using (tok) join dl using (doc_id), n group by 1, 2),
 ranked as (select qid, row_number() over (partition by qid order by round(score, 9) desc, doc) as rank, doc, score from sc)"""


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


def _questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _golds(spark, sf) -> DataFrame:
    """Every sentence of a passage is acceptable evidence."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), tx.sentences("text").alias("evidence"))


GOLD = f"""
 gs as (select item_id as qid, unnest(range(1, len(s) + 1)) as sent, s from (select item_id, {sql_sentences('text')} as s from benchmark)),
 g1 as (select qid, sent, s[sent] as sentence from gs), gg as ({sql_grams('g1', 'qid, sent', 'sentence')}),
 gold as (select *, count(*) over (partition by qid, sent) as n from gg)"""


def bm25_topk(spark, sf):
    out = retrieval.bm25_topk(_questions(spark, sf), _docs(spark, sf), 10)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "doc", F.round("score", 4).alias("score"))


def tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", tx.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", tx.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def defining_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("k", "s"))
    return s.groupBy("doc_id").agg(F.sum(tx.defines("s").cast("int")).alias("defining"), F.count("*").alias("n"))


def evidence_coverage(spark, sf):
    out = retrieval.coverages(cut(retrieval.evidence(_golds(spark, sf)), "gold"), _docs(spark, sf))
    return out.select("qid", "doc", F.round("coverage", 6).alias("coverage"))


def evidence_thresholds(spark, sf):
    best = cut(retrieval.best_coverage(_golds(spark, sf), _docs(spark, sf)), "best")
    return best.agg(F.count("*").alias("n"), *[F.sum((F.col("best") >= t).cast("int")).alias(f"at_{int(t * 100)}") for t in retrieval.THRESHOLDS])


def _hits(spark, sf):
    docs = _docs(spark, sf)
    golds = _golds(spark, sf)
    ranked = retrieval.bm25_topk(_questions(spark, sf), docs, retrieval.RANKED)
    return golds, cut(retrieval.ranked_hits(golds, ranked, docs), "hits")


def bm25_indexed(spark, sf):
    """The ten best documents of every passage from an index that is written first and kept."""
    path = shared_path(spark, "index")
    retrieval.kept_index(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), path)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return retrieval.indexed_topk(queries, path).select("qid", "rank", "doc", F.round("score", 4).alias("score"))


def evidence_found(spark, sf):
    """Documents that hold at least three fifths of a passage's sentence."""
    golds = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), tx.sentences("text").alias("evidence"))
    found = retrieval.evidence_found(golds, table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return found.select("qid", F.col("sent").cast("long").alias("sent"), "doc", F.round("coverage", 6).alias("coverage"))


def recall_at_k(spark, sf):
    golds, hits = _hits(spark, sf)
    return retrieval.recall_at(golds, hits).select("k", F.round("recall", 6).alias("recall"))


def recall_at_words(spark, sf):
    golds, hits = _hits(spark, sf)
    return retrieval.budget_hits(golds, hits).groupBy("budget").agg(F.round(F.avg(F.col("found").cast("int")), 6).alias("recall"))


HITS = f"""{BM25}, {GOLD}, top as (select * from ranked where rank <= 40),
 du as (select doc_id as doc, text from documents where doc_id in (select doc from top)), ug as ({sql_grams('du', 'doc', 'text')}),
 hit as (select distinct qid, doc from (select t.qid, t.doc, g.sent, any_value(g.n) as n, count(*) as k from top t join gold g on g.qid = t.qid join ug u on u.doc = t.doc and u.gram = g.gram group by 1, 2, 3) where k >= 0.6 * n),
 hits as (select t.qid, t.rank, t.doc, d.text, list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> '') as w, h.doc is not null as found from top t join documents d on d.doc_id = t.doc left join hit h on h.qid = t.qid and h.doc = t.doc)"""


def chunk_pack(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", retrieval.chunk_pieces(F.split("text", "\n")).alias("c"))
    return pieces.select("doc_id", F.posexplode("c").alias("chunk", "text")).select("doc_id", "chunk", tx.n_words("text").alias("words"), F.md5("text").alias("digest"))


def tfidf_terms(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws("-", "lang", "source").alias("grp"), "text")
    return stats.tfidf(docs).select("grp", "term", F.col("tf").cast("long").alias("tf"), F.round("score", 6).alias("score"))


def distinctive_topics(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws("-", "lang", "source").alias("grp"), "text")
    return stats.topics(cut(stats.tfidf(docs), "tfidf")).select("grp", F.array_join("topics", ", ").alias("topics"))


def vocab_df(spark, sf):
    return stats.vocabulary_df(table(spark, sf, "documents"))


def token_f1(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf, "conversations").withColumn("reply", F.lead("text").over(w)).where("reply is not null").select("conv_id", "turn", "text", "reply")
    return stats.token_f1(pairs, "text", "reply").select("conv_id", "turn", F.round("f1", 6).alias("f1"))


def prf_words(spark, sf):
    words = lambda name: table(spark, sf, name).select(F.explode(tx.matches(F.lower("text"), "[a-z0-9]+")).alias("w"))
    out = stats.prf(words("documents"), words("benchmark"), ["w"])
    return out.select("tp", "predicted", "gold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def kappa_labels(spark, sf):
    pairs = table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return stats.kappa(pairs, "a", "b").select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "chance", "kappa")])


def split_hash(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct().select("source", "lang", tx.split_of("source", "lang").alias("split"))


def slugs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return d.select("doc_id", tx.slugify("line").alias("slug"), tx.title_key("line").alias("title_key"))


def prose_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.prose_words("text").cast("long").alias("n"), F.md5(tx.prose_text("text")).alias("digest"))


def random_control(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("grp"), F.posexplode(tx.sentences("text")).alias("sent", "sentence"))
    budgets = table(spark, sf, "documents").select(F.col("doc_id").alias("grp"), F.floor(F.size(tx.words("text")) / 5).cast("int").alias("budget"))
    return controls.random_control(docs, budgets, 3).groupBy("grp").agg(F.count("*").alias("n"), F.sum(tx.n_words("sentence")).cast("long").alias("words"), F.sum("sent").cast("long").alias("positions"))


def repeated_edge_lines(spark, sf):
    """First and last lines of documents, digits masked, that four or more share."""
    lines = F.split("text", "\n")
    edges = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.array(F.element_at(lines, 1), F.element_at(lines, -1)))).alias("line"))
    return edges.select(F.regexp_replace("line", r"\d+", "#").alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where("n >= 4")


def html_chapters(spark, sf):
    ch = html.chapters(table(spark, sf, "pages").select(F.col("page_id").alias("doc"), "html"), html.SIMPLE)
    return ch.select("doc", "chapter_no", "number", "title", F.length("text").alias("chars"), F.size("sections").alias("sections"))


def fidelity_turns(spark, sf):
    """Order-aware overlap of the whole texts of consecutive turns, the later as extracted."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    later = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("extracted"))
    return stats.fidelity(t.join(later, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("id"), "extracted", F.col("text").alias("reference")))


def bootstrap_labels(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").cast("double").alias("value"))
    return stats.bootstrap_counts(rows, "lang")


QUERIES = {f.__name__: f for f in (
    bm25_topk, tokens, sentence_split, defining_sentences, evidence_coverage, evidence_thresholds, recall_at_k, recall_at_words, chunk_pack, tfidf_terms, distinctive_topics, vocab_df, token_f1, prf_words, kappa_labels, split_hash, slugs,
    prose_words, random_control, repeated_edge_lines, html_chapters, fidelity_turns, bootstrap_labels, bm25_indexed, evidence_found,
)}

SENTS = f"select doc_id, unnest(range(1, len(s) + 1)) as i, s from (select doc_id, {sql_sentences('text')} as s from documents)"
NW = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
TERMS = f"""d as (select concat_ws('-', lang, source) as grp, regexp_extract_all(lower(text), '[a-z][a-z-]{{2,}}') as w from documents),
 one as (select grp, unnest(w) as term from d), pos as (select grp, w, unnest(range(1, len(w))) as i from d),
 two as (select grp, w[i] as a, w[i + 1] as b from pos),
 t as (select grp, term from one where length(term) >= 4 and term not in ({STOP}) union all select grp, a || ' ' || b from two where a not in ({STOP}) and b not in ({STOP})),
 tf as (select grp, term, count(*) as tf from t group by all), df as (select term, count(*) as df from tf group by 1)"""
SLUG = "regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
BARE = "regexp_replace(text, '(?sm)^```.*?^```[ \\t]*$', '', 'g')"
LINE = "regexp_replace(regexp_replace(x, '^From \\*[^*\\n]+\\*:\\s*', ''), '^\\s*(?:[-*+]|\\d+[.)])\\s+', '')"
PROSE = f"list_transform(list_filter(list_transform(string_split({BARE}, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '^(#|\\||Source pages |Open this file for questions about:)')), lambda x: {LINE})"


ORACLES = {
    "bm25_topk": f"with {BM25} select qid, rank, doc, round(score, 4) as score from ranked where rank <= 10",
    "bm25_indexed": f"with {BM25} select qid, rank, doc, round(score, 4) as score from ranked where rank <= 10",
    "evidence_found": f"with {GOLD}, ug as ({sql_grams('documents', 'doc_id', 'text')}) select qid, sent - 1 as sent, doc_id as doc, round(k / n, 6) as coverage from (select qid, sent, n, doc_id, count(*)::double as k from gold join ug using (gram) group by all) where k >= 0.6 * n",
    "tokens": f"with t as ({sql_tokens('documents', 'doc_id', 'text')}) select d.doc_id, count(tok) as n, count(distinct tok) as distinct_tokens from documents d left join t using (doc_id) group by 1",
    "sentence_split": f"select doc_id, len(s)::bigint as n, md5(array_to_string(s, '|')) as digest from (select doc_id, {sql_sentences('text')} as s from documents)",
    "defining_sentences": f"""with s as ({SENTS}) select doc_id, sum(case when regexp_matches(s[i], '(?i)\\b(?:is called|are called|is known as|are known as|we call|refers? to|is defined as|are defined as|is a (?:\\w+ ){{0,3}}(?:that|which|used)|means that|is short for|stands for)\\b') then 1 else 0 end)::bigint as defining, count(*) as n from s group by 1""",
    "evidence_coverage": f"with {GOLD}, ug as ({sql_grams('documents', 'doc_id', 'text')}) select qid, doc_id as doc, round(max(k / n), 6) as coverage from (select qid, sent, n, doc_id, count(*)::double as k from gold join ug using (gram) group by all) group by 1, 2",
    "evidence_thresholds": f"""with {GOLD}, ug as ({sql_grams('documents', 'doc_id', 'text')}), c as (select qid, sent, n, doc_id, count(*)::double as k from gold join ug using (gram) group by all),
      best as (select item_id, coalesce(max(k / n), 0) as best from benchmark left join c on qid = item_id group by 1)
      select count(*) as n, {', '.join(f"sum(case when best >= {t} then 1 else 0 end)::bigint as at_{int(t * 100)}" for t in retrieval.THRESHOLDS)} from best""",
    "recall_at_k": f"""with {HITS}, f as (select qid, min(rank) as first from hits where found group by 1)
      select k::int as k, round(avg(case when first <= k then 1 else 0 end), 6) as recall from (select item_id, unnest([1, 3, 5, 10]) as k from benchmark) left join f on qid = item_id group by 1""",
    "recall_at_words": f"""with {HITS}, cum as (select *, sum(len(w)) over (partition by qid order by rank) as upto, unnest([250, 500, 1000, 2000]) as budget from hits),
      whole as (select distinct qid, budget from cum where found and upto <= budget),
      crossing as (select qid, budget, array_to_string(w[1:(budget - (upto - len(w)))::bigint], ' ') as head from cum where upto - len(w) < budget and upto > budget),
      cg as ({sql_grams('crossing', 'qid, budget', 'head')}),
      part as (select distinct qid, budget from (select c.qid, c.budget, g.sent, any_value(g.n) as n, count(*) as k from cg c join gold g on g.qid = c.qid and g.gram = c.gram group by 1, 2, 3) where k >= 0.6 * n),
      f as (select * from whole union select * from part)
      select b.budget::int as budget, round(avg(case when f.qid is not null then 1 else 0 end), 6) as recall from (select item_id, unnest([250, 500, 1000, 2000]) as budget from benchmark) b left join f on f.qid = b.item_id and f.budget = b.budget group by 1""",
    "chunk_pack": f"""with recursive l as (select doc_id, string_split(text, chr(10)) as l from documents), x as (select doc_id, i, l[i] as t, {NW.format('l[i]')} as n from (select *, unnest(range(1, len(l) + 1)) as i from l)),
      y as (select doc_id, i, n, case when n <= 200 then [t] else {sql_parts('t')} end as s from x), p as (select doc_id, i, j, s[j] as t, {NW.format('s[j]')} as n from (select *, unnest(range(1, len(s) + 1)) as j from y)),
      r as (select doc_id, i, j, n as run, 0 as g from p where j = 1 union all select p.doc_id, p.i, p.j, case when run + p.n > 200 then p.n else run + p.n end, g + (run + p.n > 200)::int from r join p on p.doc_id = r.doc_id and p.i = r.i and p.j = r.j + 1),
      c as (select doc_id, i, g, string_agg(t, ' ' order by j) as t, sum(n) as n from p join r using (doc_id, i, j) group by all), o as (select doc_id, t, n, row_number() over (partition by doc_id order by i, g) as k from c),
      q as (select doc_id, k, n as run, 0 as g from o where k = 1 union all select o.doc_id, o.k, case when run + o.n > 200 then o.n else run + o.n end, g + (run + o.n > 200)::int from q join o on o.doc_id = q.doc_id and o.k = q.k + 1)
      select doc_id, g::int as chunk, sum(n)::int as words, md5(string_agg(t, chr(10) || chr(10) order by k)) as digest from o join q using (doc_id, k) group by 1, 2""",
    "tfidf_terms": f"with {TERMS}, n as (select count(distinct grp) as n from d) select grp, term, tf, round(tf * ln(n / df), 6) as score from tf join df using (term), n where tf >= 3",
    "distinctive_topics": f"""with recursive {TERMS}, n as (select count(distinct grp) as n from d), sc as (select grp, term, tf * ln(n / df) as score from tf join df using (term), n where tf >= 3),
      k as (select grp, term, list_transform(string_split(term, ' '), lambda t: {STEM}) as s, row_number() over (partition by grp order by score desc, term desc) as k from sc),
      r as (select grp, k, [{{'t': term, 's': s}}] as c from k where k = 1 union all
        select k.grp, k.k, case when len(list_filter(c, lambda x: list_has_any(x.s, k.s))) = 0 then list_append(c, {{'t': term, 's': k.s}})
          when contains(term, ' ') and len(list_filter(c, lambda x: list_has_any(x.s, k.s))) = 1 and not contains(list_filter(c, lambda x: list_has_any(x.s, k.s))[1].t, ' ') then list_transform(c, lambda x: case when list_has_any(x.s, k.s) then {{'t': term, 's': k.s}} else x end) else c end
        from r join k on k.grp = r.grp and k.k = r.k + 1 where len(c) < 8)
      select grp, array_to_string(list_transform(arg_max(c, k), lambda x: x.t), ', ') as topics from r group by 1""",
    "vocab_df": f"select word, count(*) as df from (select distinct doc_id, lower(w) as word from (select doc_id, unnest(regexp_extract_all({PLAIN.format('text')}, '[A-Za-z]+')) as w from documents)) group by 1",
    "token_f1": f"""with p as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as reply from conversations),
      q as (select *, conv_id || '-' || turn as k from p where reply is not null),
      a as (select k, tok, count(*) as n from ({sql_tokens('q', 'k', 'text')}) group by all), b as (select k, tok, count(*) as n from ({sql_tokens('q', 'k', 'reply')}) group by all),
      na as (select k, sum(n) as n from a group by 1), nb as (select k, sum(n) as n from b group by 1), c as (select k, sum(least(a.n, b.n)) as c from a join b using (k, tok) group by 1)
      select conv_id, turn, round(coalesce(2 * (c / na.n) * (c / nb.n) / (c / na.n + c / nb.n), 0), 6) as f1 from q left join c using (k) left join na using (k) left join nb using (k)""",
    "prf_words": """with w as (select 1 as s, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents union all select 2, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) from benchmark),
      c as (select w, count(*) filter (where s = 1) as p, count(*) filter (where s = 2) as g from w group by 1), t as (select sum(least(p, g))::bigint as tp, sum(p)::bigint as predicted, sum(g)::bigint as gold from c)
      select tp, predicted, gold, round(tp / predicted, 6) as precision, round(tp / gold, 6) as recall, round(2 * (tp / predicted) * (tp / gold) / (tp / predicted + tp / gold), 6) as f1 from t""",
    "kappa_labels": """with s as (select count(*) as n, avg(case when (quality = 1) = (toxic = 1) then 1.0 else 0 end) as a, avg(case when quality = 1 then 1.0 else 0 end) as p, avg(case when toxic = 1 then 1.0 else 0 end) as q from labels where quality is not null and toxic is not null)
      select n, round(a, 6) as agreement, round(p * q + (1 - p) * (1 - q), 6) as chance, round((a - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 6) as kappa from s""",
    "split_hash": "select source, lang, case when list_sum(list_transform(string_split(sha256(source || chr(0) || lower(lang)), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 = 0 then 'test' else 'dev' end as split from (select distinct source, lang from documents)",
    "slugs": f"""with l as (select doc_id, string_split(text, chr(10))[1] as line from documents) select doc_id, case when regexp_replace({SLUG}[1:40], '-+$', '') = '' then 'untitled' else regexp_replace({SLUG}[1:40], '-+$', '') end as slug,
      regexp_replace(lower({PLAIN.format('line')}), '[^a-z0-9]+', '', 'g') as title_key from l""",
    "prose_words": f"with p as (select doc_id, array_to_string({PROSE}, chr(10)) as t from documents) select doc_id, {NW.format('t')}::bigint as n, md5(t) as digest from p",
    "random_control": f"""with s as ({SENTS}), r as (select doc_id as grp, i - 1 as sent, s[i] as sentence, {NW.format('s[i]')} as n, md5('3|' || doc_id || '|' || (i - 1)) as h from s),
      b as (select doc_id as grp, floor({NW.format('text')} / 5) as budget from documents),
      c as (select *, sum(n) over (partition by grp order by h, sent) - n as before from r) select grp, count(*) as n, sum(c.n)::bigint as words, sum(sent)::bigint as positions from c join b using (grp) where before < budget group by 1""",
    "repeated_edge_lines": """with l as (select string_split(text, chr(10)) as s from documents), e as (select unnest(list_distinct([s[1], s[len(s)]])) as line from l),
      m as (select regexp_replace(line, '\\d+', '#', 'g') as line from e) select line, count(*) as n from m where line <> '' group by 1 having count(*) >= 4""",
}
