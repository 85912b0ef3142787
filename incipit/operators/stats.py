"""Text statistics and quality measures: TF-IDF terms, defects, token overlap, agreement, multiset scores, intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.functions import text as tx
from incipit.scale import cut, small


def term_counts(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """keys (grp, where none are named), term, tf: words of four letters or more and two-word phrases, without stopwords;
    paragraphs (keys, text)."""
    keys = keys or ("grp",)
    words = tx.matches(F.lower("text"), "[a-z][a-z-]{2,}")
    words = F.transform(words, lambda w: F.when(~w.isin(*tx.STOPWORDS), w))  # null for a stopword, which no phrase holds
    single = F.filter("w", lambda w: F.length(w) >= 4)
    phrases = F.array_compact(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = paragraphs.select(*keys, tx.once(words).alias("w")).select(*keys, tx.once(F.concat(single, phrases)).alias("terms"))
    return rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tfidf(paragraphs: DataFrame, least_tf: int = 3) -> DataFrame:
    """grp, term, tf, score = tf x ln(groups / groups with the term)."""
    counts = term_counts(paragraphs)
    n = paragraphs.select("grp").distinct().count()
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.where(F.col("tf") >= least_tf).join(df, "term").select("grp", "term", "tf", (F.col("tf") * F.log(n / F.col("df"))).alias("score"))


def topics(scored: DataFrame, n: int = 8, candidates: int = 2000) -> DataFrame:
    """grp, topics: best terms without overlap of stems; a phrase takes the place of one picked word it holds.

    A greedy pick, as a fold over ranked terms in rounds of `candidates`, so no row holds a group's whole vocabulary: a group
    that has not picked n when its round ends goes on with its next terms, until it has n or no term is left.
    """
    pick = "array<struct<term:string,stems:array<string>>>"
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("term"))
    ranked = cut(scored.select("grp", F.row_number().over(order).alias("k"), "term"), "topics-ranked")
    stems = F.transform(F.split("term", " "), tx.stem).alias("stems")

    def step(picked: Column, x: Column) -> Column:
        me = F.struct(x["term"].alias("term"), x["stems"].alias("stems"))

        def placed(touching: Column) -> Column:
            swaps = (F.size(touching) == 1) & F.contains(x["term"], F.lit(" ")) & ~F.contains(F.get(touching, F.lit(0))["term"], F.lit(" "))
            swapped = F.transform(picked, lambda p: F.when(F.arrays_overlap(p["stems"], x["stems"]), me).otherwise(p))
            return F.when(F.size(picked) >= n, picked).when(F.size(touching) == 0, F.concat(picked, F.array(me))).when(swaps, swapped).otherwise(picked)

        return tx.let(F.filter(picked, lambda p: F.arrays_overlap(p["stems"], x["stems"])), placed)

    had, first, done = ranked.select("grp").distinct().withColumn("had", F.array().cast(pick)), 0, []
    while True:
        some = ranked.where(F.col("k").between(first + 1, first + candidates)).select(F.col("grp").alias("_grp"), "k", "term", stems)
        some = some.groupBy("_grp").agg(F.sort_array(F.collect_list(F.struct("k", "term", "stems"))).alias("ts"))
        now = had.join(some, F.col("grp").eqNullSafe(F.col("_grp")), "left").select("grp", F.aggregate(F.coalesce("ts", F.array().cast("array<struct<k:int,term:string,stems:array<string>>>")), F.col("had"), step).alias("had"), (F.size("ts") == candidates).alias("more"))
        now = cut(now, "topics")
        goes_on = F.coalesce("more", F.lit(False)) & (F.size("had") < n)
        done.append(now.where(~goes_on).select("grp", F.transform("had", lambda p: p["term"]).alias("topics")))
        had, first = now.where(goes_on).select("grp", "had"), first + candidates
        if had.isEmpty():
            return reduce(DataFrame.unionByName, done)


def vocabulary_df(docs: DataFrame) -> DataFrame:
    """word, df: in how many documents each word occurs."""
    return docs.select(F.explode(tx.vocabulary("text")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def defects(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, ligature_glyphs, broken_hyphenations, glued_words; texts (id, text), vocab (word), by semi-joins on the vocabulary."""
    vocab = small(vocab)
    norm = texts.select("id", tx.once(tx.plain("text")).alias("t"))
    # A letter with none before it is found at less cost than a boundary of words.
    hyphened = tx.matches(F.col("t"), r"(?U)(?<![A-Za-z])(?=[A-Za-z])\b[A-Za-z]{2,}+-\s+[a-z]{2,}+\b")
    # Words are put in lower case, not texts; but where a dotted I or a Kelvin sign would become a letter of ASCII.
    low = F.when(F.col("t").rlike("[\u0130\u212a]"), F.lower("t")).otherwise(F.col("t"))
    long = F.transform(tx.matches(low, "[A-Za-z]{7,}"), F.lower)
    norm = cut(norm.select("id", tx.ligature_count("t").cast("long").alias("ligature_glyphs"), hyphened.alias("hyphened"), long.alias("long")), "defects")
    broken = norm.select("id", F.explode("hyphened").alias("m")).select("id", F.lower(F.regexp_replace("m", r"(?U)-\s+", "")).alias("word")).join(vocab, "word", "left_semi").groupBy("id").agg(F.count("*").alias("broken_hyphenations"))
    unknown = norm.select("id", F.explode("long").alias("word")).join(vocab, "word", "left_anti")
    # Words are taken apart once each, not in every text.
    cuts = unknown.select("word").distinct().select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("k")).select("word", F.expr("substring(word, 1, k)").alias("head"), F.expr("substring(word, k + 1)").alias("tail"))
    both = cuts.join(vocab.withColumnRenamed("word", "head"), "head", "left_semi").join(vocab.withColumnRenamed("word", "tail"), "tail", "left_semi")
    both = small(cut(both.select("word").distinct(), "glued"), 500_000)
    glued = unknown.join(both, "word", "left_semi").groupBy("id").agg(F.count("*").alias("glued_words"))
    out = norm.select("id", "ligature_glyphs").join(broken, "id", "left").join(glued, "id", "left")
    return out.fillna(0, ["broken_hyphenations", "glued_words"])


def prf(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, predicted, gold, precision, recall, f1 of two multisets of keys (by groups)."""
    by = by or []
    p = predicted.groupBy(*by, *keys).agg(F.count("*").alias("p"))
    g = gold.groupBy(*by, *keys).agg(F.count("*").alias("g"))
    both = p.join(g, [*by, *keys], "full").fillna(0, ["p", "g"])
    return rates(both.groupBy(*by).agg(F.sum(F.least("p", "g")).alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("gold")))


def rates(s: DataFrame) -> DataFrame:
    """tp, predicted, gold with precision, recall, f1."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    s = s.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "gold"))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def prf_texts(texts: DataFrame, keys: list[str], by: str, groups: list[str]) -> DataFrame:
    """prf() of texts' tokens against those of their reference: texts (keys, by, text, reference); by is one of groups.

    All texts of a reference meet in one row, so that texts are shuffled, not tokens, and a reference is read once.
    """
    rows = texts.groupBy(*keys).agg(F.collect_list(F.struct(by, "text")).alias("ts"), F.first("reference").alias("reference"))
    parts = F.concat(F.array(F.struct(F.lit("").alias("g"), F.col("reference").alias("text"))), F.transform("ts", lambda t: F.struct(t[by].alias("g"), t["text"].alias("text"))))
    tokens = rows.select(*keys, F.inline(parts)).select(*keys, F.array_position(F.array(*map(F.lit, groups)), F.col("g")).cast("int").alias("g"), F.explode(tx.fidelity_tokens("text")).alias("token"))
    counts = tokens.groupBy(*keys, "token").agg(*[F.count_if(F.col("g") == k).alias(f"n{k}") for k in range(len(groups) + 1)])
    sums = counts.agg(*[F.sum(F.least(f"n{k}", "n0")).alias(f"tp{k}") for k in range(1, len(groups) + 1)], *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(groups) + 1)])
    each = F.array(*[F.struct(F.lit(g).alias(by), F.col(f"tp{k}").alias("tp"), F.col(f"n{k}").alias("predicted"), F.col("n0").alias("gold")) for k, g in enumerate(groups, 1)])
    return rates(sums.select(F.inline(each)))


def token_f1(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with f1 of the stemmed tokens of two text columns, as multisets; 0 where one is empty or none is shared.

    The n-th occurrence of a token becomes a value of its own, so that one hashed intersection counts what both have.
    """

    def occurrences(tokens: Column) -> Column:
        runs = F.regexp_extract_all(F.array_join(F.array_sort(tokens), " "), F.lit(r"(\S++)(?: \1(?!\S))*+"), F.lit(0))
        return F.flatten(F.transform(runs, lambda run: F.transform(F.split(run, " "), lambda t, n: F.concat(t, F.lit(":"), n))))

    both = pairs.withColumns({"_a": occurrences(tx.tokenize(a)), "_b": occurrences(tx.tokenize(b))}).withColumn("_c", F.size(F.array_intersect("_a", "_b")))
    p, r = F.col("_c") / F.size("_a"), F.col("_c") / F.size("_b")
    return both.withColumn("f1", F.when(F.col("_c") > 0, 2 * p * r / (p + r)).otherwise(0.0)).drop("_a", "_b", "_c")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, chance, kappa of two boolean columns."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    s = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("agreement"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    s = s.withColumn("chance", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    return s.select("n", "agreement", "chance", F.when(F.col("chance") == 1, 1.0).otherwise((F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


# Fidelity follows difflib's matching blocks, which no built-in expression has; the pairs are chapters, one at a time.
FIDELITY = "precision double, recall double, f1 double, ref_tokens int, out_tokens int"


def fidelity(pairs: DataFrame) -> DataFrame:
    """id and order-aware token overlap of extracted and reference; pairs (id, extracted, reference)."""
    from difflib import SequenceMatcher

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a, b = list(r.a), list(r.b)
                same = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) if a and b else 0
                p, q = (same / len(a), same / len(b)) if a and b else (0.0, 0.0)
                rows.append((r.id, p, q, 2 * p * q / (p + q) if p + q else 0.0, len(b), len(a)))
            yield pd.DataFrame(rows, columns=["id", "precision", "recall", "f1", "ref_tokens", "out_tokens"])

    tokens = pairs.select("id", tx.fidelity_tokens("extracted").alias("a"), tx.fidelity_tokens("reference").alias("b"))
    return tokens.mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, {FIDELITY}")


def micro_average(scores: DataFrame, by: str) -> DataFrame:
    """Fidelity over the tokens of all chapters of a group."""
    s = scores.groupBy(by).agg(F.sum("out_tokens").alias("out_tokens"), F.sum("ref_tokens").alias("ref_tokens"), F.sum(F.col("precision") * F.col("out_tokens")).alias("m"))
    p, r = F.try_divide(F.col("m"), F.col("out_tokens")), F.try_divide(F.col("m"), F.col("ref_tokens"))
    return s.select(by, p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def dedented(lines: Column) -> Column:
    """Lines without the indentation (blanks) that all lines with text share."""
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    return tx.let(indent, lambda n: F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(F.substring(x, F.coalesce(n, F.lit(0)) + 1, F.length(x)))))


def code_lines(text: Column | str) -> Column:
    return F.transform(F.split(tx.plain(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def code_recovery(listings: DataFrame) -> DataFrame:
    """chapter-wide shares of multi-line listings found verbatim; listings (id, extracted, code), by id: blocks, exact, indented, exact_indented."""
    return code_shares(listings.select("id", "extracted", F.array("code").alias("codes")))


def code_shares(texts: DataFrame) -> DataFrame:
    """The same from texts (id, extracted, codes: all listings of a text), where a text's lines are made once, not for each of its listings."""

    def listing(code: Column, hay: Column) -> Column:
        block = F.regexp_replace(F.array_join(dedented(code_lines(code)), "\n"), r"^\n+|\n+$", "")
        return tx.let(block, lambda b: F.struct(F.contains(hay, b).alias("found"), b.rlike(r"\n ").alias("indented")))

    multi = F.filter("codes", lambda c: F.contains(F.trim(c), F.lit("\n")))
    found = F.when(F.size(multi) > 0, tx.let(F.array_join(code_lines("extracted"), "\n"), lambda hay: F.transform(multi, lambda c: listing(c, hay))))
    rows = texts.select("id", F.inline(found))
    rate = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return rows.groupBy("id").agg(F.count("*").alias("blocks"), F.sum(F.col("indented").cast("int")).alias("indented_blocks"), rate(F.col("found").cast("int")).alias("exact"), rate(F.when(F.col("indented"), F.col("found").cast("int"))).alias("exact_indented"))


def bootstrap(values: DataFrame, by: str, cluster: str | None = None, n_boot: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean by group, resampling rows, or whole clusters where a column is named.

    values (by, value[, cluster, ord]). For small fixtures: one task holds a group and walks it n_boot times, with the draws of
    Python's generator over its rows in order. bootstrap_counts() is the form for tables.
    """
    keep = [by, "value"] + ([cluster] if cluster else []) + (["ord"] if "ord" in values.columns else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in ("ord", cluster, "value") if c in pdf.columns], kind="stable")
        draw = random.Random(seed).randrange
        if cluster:
            parts = [(g.sum(), len(g)) for _, g in pdf.groupby(cluster, sort=True)["value"]]
        else:
            parts = [(v, 1) for v in pdf["value"].astype(float)]
        means = []
        for _ in range(n_boot):
            total = count = 0
            for _ in parts:
                s, n = parts[draw(len(parts))]
                total, count = total + s, count + n
            means.append(total / count)
        means.sort()
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [float(pdf["value"].mean())], "low": [float(means[int(alpha / 2 * n_boot)])], "high": [float(means[min(n_boot - 1, int((1 - alpha / 2) * n_boot))])], "n": [len(pdf)]})

    return values.select(*keep).groupBy(by).applyInPandas(run, f"{by} {dict(values.dtypes)[by]}, mean double, low double, high double, n long")


def bootstrap_counts(values: DataFrame, by: str, cluster: str | None = None, n_boot: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """bootstrap() for groups of any size: rows (or clusters) are counted by value, and each resample is a multinomial draw of those counts.

    The draws are numpy's, seeded by (seed, hash of the group, replicate), so they do not depend on partitions. Only distinct
    values of a group meet in a row; resamples are spread in blocks. Rows without a value are left out.
    """
    import numpy as np

    block = 50
    rows = values.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    parts = rows.groupBy(by, cluster).agg(F.sum("value").alias("_s"), F.count("*").alias("_c")) if cluster else rows.select(by, F.col("value").alias("_s"), F.lit(1).cast("long").alias("_c"))
    counts = parts.groupBy(by, "_s", "_c").agg(F.count("*").alias("_n"))
    groups = cut(counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_s", "_c", "_n"))).alias("_p"), F.xxhash64(by).alias("_h")), "bootstrap-counts")
    tasks = groups.select(by, "_h", "_p._s", "_p._c", "_p._n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(block))).alias("_first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                group, h, s, c, times, first = r
                m = int(times.sum())
                for k in range(first, min(first + block, n_boot)):
                    n = np.random.default_rng([seed, int(h) % 2**64, k]).multinomial(m, times / m)
                    out.append((group, k, float((n * s).sum() / (n * c).sum())))
            yield pd.DataFrame(out, columns=[by, "_k", "_m"])

    means = tasks.repartition(by, "_first").mapInPandas(run, f"{by} {dict(values.dtypes)[by]}, _k int, _m double")
    at = F.row_number().over(Window.partitionBy(by).orderBy("_m", "_k")) - 1
    pick = lambda k: F.max(F.when(F.col("_at") == k, F.col("_m")))
    ends = means.withColumn("_at", at).groupBy(F.col(by).alias("_by")).agg(pick(int(alpha / 2 * n_boot)).alias("low"), pick(min(n_boot - 1, int((1 - alpha / 2) * n_boot))).alias("high"))
    weigh = lambda f: F.aggregate("_p", F.lit(0.0), lambda a, x: a + x[f] * x["_n"])
    return groups.join(ends, F.col(by).eqNullSafe(F.col("_by"))).select(by, (weigh("_s") / weigh("_c")).alias("mean"), "low", "high", weigh("_c").cast("long").alias("n"))
