"""License scans: sparse TF-IDF cosine of file headers and licence files to templates, then inheritance by directory.

Segments are the lines of every file, and the whole text of files named like licences. A segment can only reach the
threshold for a template if it holds one of the template's telling words (the norm of the others is below the
threshold; short, common words are taken last), so lines without any such word are skipped without loss. Distinct lines are scored once for the whole corpus: their word
weights join the templates' weights by word, and cosines are grouped sums.

Headers and licence texts run over lines and are found in the file's words as a whole: comment marks and line ends are no
words, and the score of a standard text (see licence_standards) is the share of its distinct 3-word shingles that the file
holds, whatever else stands around them. Of the texts at the threshold the one with most shingles in the file wins (a
BSD-3 text holds BSD-2 too). A file's licence is its SPDX-License-Identifier (several are joined by AND), else such a
text, else its best line (or licence file as a whole), else a one-sentence notice wrapped over lines.

A licence file is one named like it, one whose every line with a word is a notice or SPDX line, or one of which a standard
text makes up `WHOLE` of the shingles. Other files without a licence of
their own take that of the nearest ancestor directory with a licence file: distinct directories are expanded to their ancestors and
joined with licence directories, the deepest match wins, and files join their directory's result.

Edge cases: null text has no segments; a null path has only its own licence, never an inherited one; repeated paths share
the best segment of all their rows; of equal cosines the template first by name wins; an empty table gives no rows; extra
columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.llm.licence_standards import standards
from incipit.llm.quality import let
from incipit.scale import cut, small

#: Notices that authors put in files, as the licences' own texts word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
THRESHOLD = 0.7
#: Function words, which carry no weight in any segment.
STOPWORDS = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "in", "is", "it", "may", "not", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you")
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([a-z0-9.+:-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[a-z0-9.+:-]+)*|\([a-z0-9.+:() \t-]+\))"
#: Share of a file's shingles that a standard text must make up for the file to be a licence file by its contents.
WHOLE = 0.9
LICENCE_NAME = "(?i)(^|/)(licen[sc]e|copying|notice)(\\.[a-z]+)?$"


class Weights:
    """TF-IDF of the templates (few and fixed), and the words of which a segment needs one."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        counts = [Counter(w for w in re.findall(WORD, text.lower()) if w not in STOPWORDS) for _, text in templates]
        df = Counter(w for c in counts for w in c)
        self.idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in df.items()}
        self.unseen = math.log(1 + len(templates)) + 1
        self.rows, need = [], set()
        for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
            raw = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.rows += [(k, name, w, v / norm) for w, v in raw.items()]
            left = 1.0
            for w, v in sorted(raw.items(), key=lambda p: (len(p[0]) < 4, -p[1], p[0])):  # short words are common: last
                if left < threshold**2 - 1e-9:
                    break
                need.add(w)
                left -= (v / norm) ** 2
        self.needed = "(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(need)) + ")(?![a-z0-9])"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, name, w, v, self.idf[w]) for k, name, w, v in self.rows], "template int, license string, word string, weight double, idf double")


def matched(segments: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """id, license, score of the distinct segments (id, segment) that reach the threshold."""
    table = small(cut(weights.frame(segments.sparkSession), "license-templates"))
    words = segments.select("id", F.explode(F.regexp_extract_all(F.lower("segment"), F.lit(f"({WORD})"), F.lit(1))).alias("word")).where(~F.col("word").isin(*STOPWORDS)).groupBy("id", "word").agg(F.count("*").alias("tf"))
    idf = small(cut(table.select("word", "idf").distinct(), "license-idf"))
    words = words.join(idf, "word", "left")
    words = cut(words.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(weights.unseen))).drop("idf", "tf"), "license-words")
    norms = words.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = words.join(table.drop("idf"), "word").groupBy("id", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "id").select("id", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = Window.partitionBy("id").orderBy(F.desc("score"), "license")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def shingles(text: Column) -> Column:
    """Hashes of the 3-word shingles of a text, without words that mark comments."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?im)^[ \t]*(?:dnl|rem)[ \t]", "")), F.lit(f"({WORD})"), F.lit(1))
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))
    return let(words, lambda w: F.when(F.size(w) >= 3, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def needed_words(texts: list[str], threshold: float) -> set[str]:
    """Words of which a file needs one: less than the threshold of any text's shingles are free of them all."""
    need: set[str] = set()
    for text in texts:
        words = re.findall(WORD, text.lower())
        left = {g for g in zip(words, words[1:], words[2:])}
        least = threshold * len(left)
        left = {g for g in left if not need & set(g)}
        while len(left) >= least:
            count = Counter(w for g in left for w in set(g) if w not in STOPWORDS and len(w) > 3) or Counter(w for g in left for w in g)
            word = min(count, key=lambda w: (-count[w], w))
            need.add(word)
            left = {g for g in left if word not in g}
    return need


def declared(files: DataFrame, wordy: Column, named: Column, threshold: float) -> DataFrame:
    """What SPDX lines, standard texts and wrapped notices say: path, named, kind (0, 1, 3), n, license, score, notices, wordy, whole."""
    spark = files.sparkSession
    long = standards()
    texts = [(k, name, 1 if k < len(long) else 3, text) for k, (name, text) in enumerate([*long, *TEMPLATES])]
    need = "(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(needed_words([t[3] for t in texts], threshold))) + ")(?![a-z0-9])"
    table = cut(spark.createDataFrame(texts, "template int, license string, kind int, text string").withColumn("s", F.array_distinct(shingles(F.col("text")))), "license-standards")
    sizes = table.select("template", "license", "kind", F.size("s").alias("all"))
    grams = cut(table.select("template", F.explode("s").alias("s")).groupBy("s").agg(F.collect_list("template").alias("templates")), "license-shingles")
    # Shingles meet the standards' (some ten thousands, whatever the input) where they are read; only those found are written.
    exploded = files.where(F.lower("text").rlike(need)).select("path", named.alias("named"), wordy.alias("wordy"), F.monotonically_increasing_id().alias("row"), shingles(F.col("text")).alias("all")).select("path", "named", "wordy", "row", F.size("all").alias("own"), F.explode("all").alias("s"))
    held = cut(exploded.join(F.broadcast(grams), "s"), "license-held")
    held = held.select("path", "named", "wordy", "row", "own", "s", F.explode("templates").alias("template")).groupBy("path", "named", "wordy", "row", "own", "template").agg(F.count_distinct("s").alias("n"), F.count("*").alias("times"))
    scored = held.join(small(sizes), "template").withColumn("score", F.round(F.col("n") / F.col("all"), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy("path", "named", "wordy", "row", "own", "kind").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("away"), "license", "times")).alias("b"))
    texts_found = best.select("path", "named", "kind", "b.n", "b.license", (-F.col("b.away")).alias("score"), F.lit(0).alias("notices"), "wordy", ((F.col("kind") == 1) & (F.col("b.times") >= F.col("own") * WHOLE)).alias("whole"))
    spdx = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"[ \t]+", " "))))
    tags = F.size(F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(SPDX))))
    tagged = files.where(F.lower("text").contains("spdx-license-identifier:")).select("path", named.alias("named"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.array_join(spdx, " AND ").alias("license"), F.lit(1.0).alias("score"), tags.alias("notices"), wordy.alias("wordy"), F.lit(False).alias("whole")).where("license <> ''")
    return texts_found.unionByName(tagged)


def ancestors(directory: Column) -> Column:
    """A directory and all above it, to the root (empty string)."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.when(directory == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, weights: Weights | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """path, license (own or inherited), score, licence_file, inherited_from (a directory, or null); one row a row of files."""
    weights = weights or Weights(threshold=threshold)
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    named = F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(F.lower(x), F.lit(weights.needed)))
    wordy = F.size(F.filter(F.split("text", "\n"), lambda x: F.regexp_like(F.lower(x), F.lit("[a-z0-9]"))))
    hits = files.where(F.lower("text").rlike(weights.needed)).select("path", named.alias("named"), wordy.alias("wordy"), F.explode(F.concat(F.transform(lines, lambda x: F.struct(x.alias("segment"), F.lit(True).alias("line"))), F.when(named, F.array(F.struct(F.col("text").alias("segment"), F.lit(False).alias("line")))).otherwise(F.array()))).alias("s"))
    hits = hits.select("path", "named", "wordy", "s.segment", "s.line", F.md5("s.segment").alias("id"))
    hits = cut(hits, "license-hits")
    found = small(cut(matched(hits.select("id", "segment").distinct(), weights, threshold), "license-found"))
    by_line = hits.drop("segment").join(found, "id").select("path", "named", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n"), "license", "score", F.col("line").cast("int").alias("notices"), "wordy", F.lit(False).alias("whole"))
    own = (
        by_line.unionByName(declared(files, wordy, named, threshold)).groupBy("path", "named")
        .agg(F.min(F.struct("kind", "n", (-F.col("score")).alias("away"), "license")).alias("b"), F.sum("notices").alias("notices"), F.max("wordy").alias("wordy"), F.bool_or("whole").alias("whole"))
        .select(F.col("path").alias("own_path"), F.col("b.license").alias("own"), (-F.col("b.away")).alias("score"), (F.col("named") | (F.col("notices") >= F.col("wordy")) | F.col("whole")).alias("licence_file"))
    )
    own = cut(own, "license-own")
    dirs = own.where("licence_file and own_path is not null").select(dirname(F.col("own_path")).alias("above"), "own", "score").groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("away"), F.col("own").alias("license"))).alias("b")).select("above", "b.license")
    dirs = small(cut(dirs, "license-dirs"))
    spread = files.where("path is not null").select(dirname(F.col("path")).alias("dir")).distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("above")).join(dirs, "above")
    spread = spread.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "license")).alias("m")).select("dir", F.col("m.above").alias("from_dir"), F.col("m.license").alias("from_license"))
    out = files.select("path", dirname(F.col("path")).alias("dir")).join(small(own), F.col("path").eqNullSafe(F.col("own_path")), "left").join(small(cut(spread, "license-spread")), "dir", "left")
    inherits = F.col("own").isNull()
    return out.select("path", F.coalesce("own", "from_license").alias("license"), "score", F.coalesce("licence_file", F.lit(False)).alias("licence_file"), F.when(inherits, F.col("from_dir")).alias("inherited_from"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text"))


def oracle() -> str:
    w = Weights()
    values = ", ".join(f"({k}, '{name}', '{word}', {v!r}::double, {w.idf[word]!r}::double)" for k, name, word, v in w.rows)
    return f"""
    with t(template, license, word, weight, idf) as (values {values}),
    files as (select row_number() over () as rid, concat_ws('/', source, lang, doc_id) as path, coalesce(text, '') as text from documents),
    parts as (select path, unnest(string_split(text, chr(10))) as line from files),
    segs as (select path, line, count(*) as n from parts where regexp_matches(lower(line), '[a-z0-9]') group by all),
    wordy as (select path, sum(n) / count(distinct rid) as wordy from (select f.rid, f.path, unnest(string_split(text, chr(10))) as line, 1 as n from files f) where regexp_matches(lower(line), '[a-z0-9]') group by path),
    cand as (select distinct line from segs where regexp_matches(lower(line), '(licen|redistribution|cc|gnu|mit|released|permission|mozilla|apache|by|public)')),
    toks as (select line, unnest(regexp_extract_all(lower(line), '{WORD}')) as word from cand),
    tf as (select line, word, count(*) as tf from toks where word not in ({', '.join(repr(x) for x in STOPWORDS)}) group by all),
    ww as (select tf.line, tf.word, tf * coalesce(i.idf, {w.unseen!r}) as w from tf left join (select distinct word, idf from t) i using (word)),
    norms as (select line, sqrt(sum(w * w)) as norm from ww group by line),
    dots as (select line, template, license, sum(w * weight) as dot from ww join t using (word) group by all),
    scored as (select line, license, round(dot / norm, 6) as score from dots join norms using (line) where round(dot / norm, 6) >= {THRESHOLD}),
    best as (select * from (select *, row_number() over (partition by line order by score desc, license) as k from scored) where k = 1),
    own as (select path, arg_min(license, (-score, license)) as own, max(score) as score, sum(n) as notices from segs join best using (line) group by path),
    o as (select own.*, notices >= wordy as lf from own join wordy using (path)),
    dirs as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as above, arg_min(own, (-score, own)) as license from o where lf group by 1),
    d as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files),
    m as (select dir, max({{'n': length(above), 'above': above, 'license': license}}) as m from d join dirs on above = dir or above = '' or starts_with(dir, above || '/') group by dir),
    mm as (select dir, m.above as above, m.license as license from m)
    select f.path, coalesce(own, mm.license) as license, score, coalesce(lf, false) as licence_file, case when own is null then above end as inherited_from
    from files f left join o using (path) left join mm on mm.dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1)"""
