"""Quality rules: word statistics, and robust outliers by minimum covariance determinant per language and source.

Base rules count, in each whole text, words, their code points, symbols, repeated lines and words in repeated 3-word
windows. Five transformed statistics then form a vector; for every (language, source) the minimum-covariance-determinant
estimate of centre and scatter is searched, and a document whose squared Mahalanobis distance from it is above the
chi-squared quantile of `tail` is rejected.

The search starts, for each group, from three deterministic scatters about the medians (median absolute deviations alone,
spatial signs, and hyperbolic tangents of the scaled statistics). From each start, concentration steps take the h nearest
documents, h being `covered` of the group, and estimate anew, until the determinant no longer falls; the least determinant of
the three is the group's. A step counts the documents of each distance (told apart by 1/4096 of a doubling), finds the h-th
from these counts, and sums the vectors up to it. h is met exactly: documents that tie at the h-th distance share what is
left of h equally (a weighted step, for which the determinant falls just the same).

Where half of a group agrees on a statistic its scatter would be singular. So scatter is regularised, as in the minimum
regularised covariance determinant: a statistic's variance gets what its median absolute deviation lacks to its floor (a ten
thousandth of the floor at least), fixed for the group before the first step.

Groups of fewer than `least_group` documents are pooled by language, pools that are still smaller are pooled together, and
where even these are fewer in all the estimate is that of all documents, however few (with whole floors); every document that
passes the base rules is judged. Documents that fail them take no part in the fit. Vectors are whole thousandths, so sums are
exact and do not depend on their order.

Statistics are written once to the shared folder; steps read only them. No group's rows ever meet in a task: counts of
distances and values and the sums are partial, and windows run over counts (bounded a group by what is told apart).

Edge cases: null text has no words and fails the base rules; very long texts are counted whole, in their own row; null lang
or source is a value of its own; equal distances share alike; repeated rows each get their row; empty tables give no rows;
kept_documents() keeps docs' columns, also where names clash with its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incipit.scale import BROADCAST_ROWS, cut, dropped, planned_once, small, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 1000
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats")
P = len(FEATURES)
#: Least deviation of each transformed statistic.
FLOORS = (0.9, 0.1, 0.2, 0.35, 0.15)
#: The share of a normal group that the cutoff would reject, and the share of a group that the estimate covers.
TAIL, COVERED = 1e-6, 0.75
#: Parts of a doubling of 1 + distance that distances are told apart by, and the fall of a determinant that counts as one.
STEP, LEAST_FALL = 4096, 1e-6


def let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur at least twice: windows with a hash that another one has are compared by
    their words."""

    def of(w: Column) -> Column:
        a, b, c = (lambda k, d=d: F.get(w, k + d) for d in range(3))
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.struct(F.xxhash64(a(k), b(k), c(k)).alias("h"), k.alias("k")))

        def neighbours(s: Column, same) -> Column:
            return F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))

        def covered(s: Column) -> Column:
            maybe = F.transform(neighbours(s, lambda x, y: x["h"] == y["h"]), lambda x: F.struct(a(x["k"]).alias("a"), b(x["k"]).alias("b"), c(x["k"]).alias("c"), x["k"].alias("k")))
            twin = let(F.sort_array(maybe), lambda m: neighbours(m, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])))
            at = F.array_sort(F.transform(twin, lambda x: x["k"]))
            # Each window covers 3 words, less what the next one covers again.
            return let(at, lambda a: F.when(F.size(a) > 0, F.aggregate(F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.least(F.coalesce(y - x, F.lit(3)), F.lit(3))), F.lit(0), lambda n, x: n + x)).otherwise(0))

        return F.when(F.size(w) >= 3, let(F.sort_array(hashed), covered)).otherwise(0)

    return let(words, of).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column `_q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    plain = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))

    def stats(w: Column) -> Column:
        n = F.size(w).cast("long")
        repeats = repeated_words(w)
        return let(
            F.struct(n.alias("n_words"), plain.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeats.alias("n_repeat_words")),
            lambda s: s.withField("base_failed", (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)),
        )

    return docs.withColumn("_q", let(words, stats))


def vector(q: Column) -> list[Column]:
    """The transformed statistics in whole thousandths."""
    n = F.greatest(q["n_words"], F.lit(1)).cast("double")
    x = [F.log(n), F.log(F.greatest(q["word_chars"], F.lit(1)) / n), F.log(1 + 20 * q["n_symbols"] / n), F.log(1 + 100 * q["n_dup_lines"] / n), F.sqrt(q["n_repeat_words"] / n)]
    return [F.round(v * UNIT).cast("long") for v in x]


def vectors(stats: DataFrame, least_group: int) -> DataFrame:
    """stats with x0.., _group (what judges the row: its (lang, source), its language's pool, the pool of small pools, or all) and _fit (the groups it is fitted in)."""
    rows = stats.withColumns({f"x{k}": v for k, v in enumerate(vector(F.col("_q")))})
    good = rows.where(~F.col("_q.base_failed"))
    counts = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pools = counts.where(F.col("n") < least_group).groupBy(F.col("lang").alias("pool_lang")).agg(F.sum("n").alias("pool"))
    counts = counts.join(pools, F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
    key = F.when(F.col("n") >= least_group, F.struct(F.col("lang").alias("l"), F.col("source").alias("s"), F.lit(False).alias("pooled")))
    key = key.when(F.col("pool") >= least_group, F.struct(F.col("lang").alias("l"), F.lit(None).cast("string").alias("s"), F.lit(True).alias("pooled")))
    counts = cut(counts.withColumn("_group", F.to_json(key)), "mcd-counts")
    rest = counts.where("_group is null").agg(F.sum("n")).first()[0] or 0
    last = "small" if rest >= least_group else "all"
    counts = counts.withColumn("_fit", F.array_compact(F.array("_group", F.lit("all") if 0 < rest < least_group else F.when(F.col("_group").isNull(), F.lit(last)))))
    groups = small(cut(counts.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.coalesce("_group", F.lit(last)).alias("_group"), "_fit"), "mcd-groups"))
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")


def medians(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The lower median of value by keys, from value counts n."""
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy(value))
    return counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where("upto * 2 >= all").groupBy(*keys).agg(F.min(value).alias("med"))


def deviations(fit: DataFrame, covered: float, least_group: int) -> DataFrame:
    """_group, centre (medians, thousandths), sd (floored), ridge (variances), h."""
    long = fit.select("_group", F.posexplode(F.array(*[F.col(f"x{k}") for k in range(P)])).alias("k", "x"))
    counts = cut(long.groupBy("_group", "k", "x").agg(F.count("*").alias("n")), "mcd-values")
    med = medians(counts, ["_group", "k"], "x")
    away = counts.join(med, ["_group", "k"]).groupBy("_group", "k", F.abs(F.col("x") - F.col("med")).alias("d")).agg(F.sum("n").alias("n"))
    mad = medians(away, ["_group", "k"], "d").withColumnRenamed("med", "mad")
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("k") + 1)
    n = counts.where("k = 0").groupBy("_group").agg(F.sum("n").alias("n"))
    sd = F.col("mad") * 1.4826 / UNIT
    lacking = F.when(F.col("n") < least_group, floor * floor).otherwise(F.greatest(floor * floor - sd * sd, floor * floor * 1e-4))
    both = med.join(mad, ["_group", "k"]).join(n, "_group").withColumns({"sd": F.greatest(sd, floor), "ridge": lacking})
    rows = both.groupBy("_group", "n").agg(F.array_sort(F.collect_list(F.struct("k", "med", "sd", "ridge"))).alias("a"))
    return rows.select("_group", F.transform("a", lambda r: r["med"].cast("double")).alias("centre"), F.transform("a", lambda r: r["sd"]).alias("sd"), F.transform("a", lambda r: r["ridge"]).alias("ridge"), F.ceil(F.col("n") * covered).alias("h"))


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def matrix_of(entry) -> str:
    """SQL of a symmetric array of arrays from the SQL of its entries."""
    return "array(" + ", ".join("array(" + ", ".join(entry(min(i, j), max(i, j)) for j in range(P)) + ")" for i in range(P)) + ")"


def starts(fit: DataFrame, covered: float, least_group: int) -> DataFrame:
    """_group, start, centre, inverse, ridge, h, det (infinite), active: three scatters about the medians."""
    base = cut(deviations(fit, covered, least_group), "mcd-deviations")
    z = ", ".join(f"(x{k} - centre[{k}]) / {UNIT} / sd[{k}]" for k in range(P))
    scaled = fit.join(small(base), "_group").selectExpr("_group", f"array({z}) as z").selectExpr("_group", "z", "aggregate(z, 0D, (a, v) -> a + v * v) as norm2", "transform(z, v -> tanh(v)) as t")
    million = lambda c: f"sum(cast(round({c} * 1000000) as bigint))"  # noqa: E731  # whole millionths: exact in any order
    signs = [f"{million(f'if(norm2 > 0, z[{i}] * z[{j}] / norm2, 0D)')} as u{i}_{j}" for i, j in PAIRS]
    tanhs = [f"{million(f't[{k}]')} as t{k}" for k in range(P)] + [f"{million(f't[{i}] * t[{j}]')} as t{i}_{j}" for i, j in PAIRS]
    sums = scaled.groupBy("_group").agg(F.count("*").alias("n"), *map(F.expr, signs + tanhs))
    share = lambda c: f"{c} / n / 1000000"
    room = lambda i, j: 0.05 * (i == j)  # noqa: E731  # keeps every start's scatter regular
    kinds = (
        lambda i, j: f"{float(i == j)}D",
        lambda i, j: f"{share(f'u{i}_{j}')} * {P} + {room(i, j)}D",
        lambda i, j: f"{share(f't{i}_{j}')} - {share(f't{i}')} * {share(f't{j}')} + {room(i, j)}D",
    )
    scatters = ", ".join(matrix_of(lambda i, j, kind=kind: f"({kind(i, j)}) * sd[{i}] * sd[{j}]") for kind in kinds)
    rows = base.join(sums, "_group").selectExpr("_group", "centre", "ridge", "h", f"posexplode(array({scatters})) as (start, scatter)")
    return rows.selectExpr("_group", "start", "centre", f"{inverted('scatter')}.a as inverse", "ridge", "h", "double('infinity') as det", "true as active")


def inverted(m: str) -> str:
    """SQL of struct<a, det>: Gauss-Jordan inverse of a positive definite array of arrays, and its determinant."""
    pivot = "s.a[k][k]"
    cell = f"case when i = k and j = k then 1 / {pivot} when i = k then x / {pivot} when j = k then -x / {pivot} else x - r[k] * s.a[k][j] / {pivot} end"
    return f"aggregate(sequence(0, {P - 1}), struct({m} as a, 1D as det), (s, k) -> struct(transform(s.a, (r, i) -> transform(r, (x, j) -> {cell})) as a, s.det * {pivot} as det))"


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from centre by inverse."""
    terms = [f"(x{i} - centre[{i}]) / {UNIT} * (x{j} - centre[{j}]) / {UNIT} * inverse[{i}][{j}] * {1 + (i != j)}" for i, j in PAIRS]
    return F.expr(" + ".join(terms))


def concentrated(fit: DataFrame, now: DataFrame, covered: float, hint) -> DataFrame:
    """now after one concentration step of its active estimates, which stay active if their determinant falls; hint(frame) marks frames of
    a row an estimate."""
    key = ["_group", "start"]
    # Sums are relative to the rounded centre, so that products stay small.
    estimate = now.where("active").selectExpr(*key, "centre", "inverse", "h", "transform(centre, c -> cast(round(c) as bigint)) as base")

    def placed(estimate: DataFrame) -> DataFrame:
        return fit.join(hint(estimate), "_group").withColumn("d", F.floor(F.log2(1 + F.greatest(distance(), F.lit(0.0))) * STEP).cast("int"))

    # The distance where h falls, and how many lie nearer and exactly there.
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("d"))
    counts = placed(estimate).groupBy(*key, "h", "d").agg(F.count("*").alias("n")).withColumn("upto", upto).where("upto >= h")
    edge = counts.groupBy(*key).agg(F.min(F.struct("d", "n", "upto")).alias("e")).selectExpr(*key, "e.d as edge", "e.n as tied", "e.upto - e.n as nearer")
    near = placed(estimate.join(hint(edge), key)).where("d <= edge")
    near = near.selectExpr(*key, "base", "h as _h", "tied", "nearer", "d = edge as _tie", *[f"x{k} - base[{k}] as y{k}" for k in range(P)])
    products = {f"s{k}": f"y{k}" for k in range(P)} | {f"c{i}_{j}": f"y{i} * y{j}" for i, j in PAIRS}
    parts = [f"sum(if({on}_tie, {v}, null)) as {name}{part}" for name, v in products.items() for on, part in (("not ", ""), ("", "t"))]
    # What an estimate has once is grouped by: aggregates are whole numbers only, so rows are hashed, not sorted.
    sums = near.groupBy(*key, "base", "_h", "tied", "nearer").agg(*map(F.expr, parts))
    sums = sums.selectExpr(*key, "base", *[f"(coalesce({name}, 0) + coalesce({name}t, 0) * ((_h - nearer) / tied)) / _h as {name}" for name in products])
    spread = consistency(covered) / UNIT**2
    scatter = matrix_of(lambda i, j: f"(c{i}_{j} - s{i} * s{j}) * {spread!r}D" + f" + ridge[{i}]" * (i == j))
    centre = ", ".join(f"base[{k}] + s{k}" for k in range(P))
    new = now.join(hint(sums), key, "left").selectExpr(*now.columns, f"array({centre}) as new_centre", f"if(base is null, null, {inverted(scatter)}) as m")
    new = new.selectExpr("*", "m.a as new_inverse", "m.det as new_det", f"coalesce(m.det < det * {1 - LEAST_FALL!r}D, false) as falls")
    taken = [F.when(F.col("falls"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "inverse", "det")]
    return new.select(*key, "ridge", "h", *taken, F.col("falls").alias("active"))


def chi2_cdf(x: float, p: int) -> float:
    """Chi-squared distribution function by the series of the lower incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def consistency(covered: float) -> float:
    """What makes the scatter of the nearest share of a normal sample consistent."""
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, P) < covered else (low, mid)
    return covered / chi2_cdf(low, P + 2)


def cutoff(tail: float) -> float:
    """The squared distance that a share `tail` of normal vectors exceeds."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, P) > tail else (low, mid)
    return high


def fitted(rows: DataFrame, covered: float = COVERED, least_group: int = 50, most_steps: int = 200) -> DataFrame:
    """The estimate of each group: concentration steps from every start until its determinant no longer falls, then the least."""
    with planned_once(rows.sparkSession):
        return _fitted(rows, covered, least_group, most_steps)


def _fitted(rows: DataFrame, covered: float, least_group: int, most_steps: int) -> DataFrame:
    fit = cut(rows.where(~F.col("_q.base_failed") & F.col("_group").isNotNull()).select(F.explode("_fit").alias("_group"), *[f"x{k}" for k in range(P)]), "mcd-fit")
    now, path = written(starts(fit, covered, least_group), "mcd-step")
    # Every step has a row a group and start, as the first has; so its size is proven once.
    hint = F.broadcast if now.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    for _ in range(most_steps):
        if now.where("active").isEmpty():
            break
        after, to = written(concentrated(fit, now, covered, hint), "mcd-step")
        dropped(rows.sparkSession, path)
        now, path = after, to
    else:
        raise RuntimeError(f"the determinants still fall after {most_steps} steps")
    best = now.groupBy("_group").agg(F.min_by(F.struct("centre", "inverse"), F.struct("det", "start")).alias("e"))
    return cut(best.select("_group", "e.centre", "e.inverse"), "mcd-estimates")


def judged(stats: DataFrame, tail: float = TAIL, covered: float = COVERED, least_group: int = 50) -> DataFrame:
    """stats (with _q, lang, source; see with_statistics) with _distance and _kept."""
    rows = vectors(stats, least_group)
    out = rows.join(small(fitted(rows, covered, least_group)), "_group", "left").withColumn("_distance", distance())
    return out.withColumn("_kept", ~F.col("_q.base_failed") & (F.coalesce("_distance", F.lit(0.0)) <= cutoff(tail))).drop("_group", "_fit", "centre", "inverse", *[f"x{k}" for k in range(P)])


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with docs' columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    stats = with_statistics(docs.select(whole, "text", "lang", "source")).drop("text")
    return judged(cut(stats, "quality"), **options).where("_kept").select("_doc.*")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    stats = cut(with_statistics(docs).drop("text"), "quality")
    return judged(stats).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))
