"""Secret scans: three base patterns, and character Markov models compared by log-likelihood ratio.

Base patterns report leftmost non-overlapping matches with their offsets (Unicode code points, end exclusive): the text
between matches and the matches themselves alternate, so their lengths add up to the offsets. Long runs of token
characters that no base match touches are then scored: two first-order character models, of random strings and of ordinary
identifiers, are fitted by counting bigrams of labelled samples, and a run whose log-likelihood ratio is high in sum and per
character is reported as `markov`. Ratios are whole millinats, so sums are exact.

Labelled samples: random strings are generated by hashing (`samples` of each alphabet). Ordinary ones are identifiers made
of common English words in the styles of code (snake_case, camelCase, PascalCase, UPPER_SNAKE, kebab-case, paths, with
numbers and short forms), rules of one character, and the words of `train_docs` documents (those with the lowest hash), with
base matches cut out; words and identifiers weigh the same. All bounds are parameters. Pairs that the ordinary samples lack
are smoothed by the frequency of the characters. The model is a table of fixed size (alphabet squared), so it may pass
through the driver; scanning is one narrow pass without a shuffle. A UUID is an identifier and not reported, neither are
runs of one character or paths of words.

Offsets are running sums in blocks, overlaps one merge by start, and redaction cuts the text in blocks once, so a text of many
secrets costs little more than its length.

Edge cases: null text is empty and has no spans; texts are scanned whole, however long; repeated rows each get their row;
empty tables give no rows (the model then stands on identifiers alone); extra columns are not read by scan()
and are kept by redacted(), also where names clash with its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern drops exactly the matches that are too short.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN_CLASS = "A-Za-z0-9+/_=-"
#: Least length of a scored run, least ratio in sum and on average (millinats).
LEAST_RUN, LEAST_SUM, LEAST_MEAN = 20, 16_000, 800
#: How many counts the character frequencies weigh in each row of the ordinary model.
PRIOR = 400
UUID = "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
# Common words of identifiers, the labelled sample of ordinary ones is made of them.
NAME_WORDS = """
abstract access account action active address after agent allow answer apply array assert async attribute audio auth
average background backup balance base batch before binary block board body boolean border bottom branch browser buffer
build button byte cache call cancel category change channel character check child class clean client close cluster code
collection color column command comment commit common compare complete component config connection constant container
content context control convert copy core count create current custom data database date debug decode default define delete
depth description detail device dialog different directory disable display document domain download driver dynamic edge
edit element email empty enable encode end engine entity entry environment error event example exception execute exist
expected export expression extension external factory feature field file filter final find first flag float folder font
force format forward frame from function general generate get global graph group handler hash header height hidden history
host https icon image import index info initialize input insert instance integer interface internal interval invalid item
join kernel key kind label language large last layer layout length level library license limit line link list load local
location lock
""".split()


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op, zero: Column) -> Column:
    """Inclusive running results of an associative op over an array of int: in blocks of its length's root, since a fold that
    appends to an array copies it each time."""

    def fold(a: Column, first: Column) -> Column:
        start = F.struct(first.alias("last"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda s, x: let(op(s["last"], x), lambda y: F.struct(y.alias("last"), F.concat(s["out"], F.array(y)).alias("out"))), lambda s: s["out"])

    def blocked(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), width), lambda at: F.slice(v, at + 1, width))

        def joined(b: Column) -> Column:
            totals = fold(F.transform(b, lambda x: F.aggregate(x, zero, op)), zero)
            return let(totals, lambda before: F.flatten(F.transform(b, lambda x, i: fold(x, F.when(i > 0, F.get(before, i - 1)).otherwise(zero)))))

        return let(blocks, joined)

    return let(values, blocked)


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of the pattern's matches; keep(match) drops some after matching."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def offsets(found: Column) -> Column:
        steps = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.length(gap) + F.length(m)), lambda n: n.isNotNull())
        ends = running(steps, lambda a, x: a + x, F.lit(0))
        spans = F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (F.lit(True) if keep is None else keep(m)).alias("ok")))
        return F.when(F.size(found) > 0, F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), offsets)


def base_spans(text: Column) -> Column:
    return F.sort_array(
        F.concat(
            spans_of(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
            spans_of(text, ACCESS, 1),
            spans_of(text, HEX, 2),
        )
    )


def furthest(spans: Column) -> Column:
    """The furthest end of the spans before each, 0 at first; spans come by start."""
    return F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0)))


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` (which do not overlap each other) that no span of `others` overlaps: one merge by start."""

    def merged(both: Column) -> Column:
        ends = F.transform(both, lambda s: F.when(s["mine"], 0).otherwise(s["end"]))
        upto = F.concat(F.array(F.lit(0)), running(ends, lambda a, x: F.greatest(a, x), F.lit(0)))  # of others before each

        def alone(upto: Column) -> Column:
            marked = F.transform(both, lambda s, i: s.withField("ok", s["mine"] & (F.get(upto, i) <= s["start"]) & (F.coalesce(F.get(both, i + 1)["start"], s["end"]) >= s["end"])))
            return F.transform(F.filter(marked, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

        return let(upto, alone)

    tagged = lambda a, mine: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.sort_array(F.concat(tagged(others, False), tagged(spans, True))), merged)).otherwise(spans)


def random_strings(spark, samples: int) -> DataFrame:
    """Label random: hexadecimal of both cases, base64 and base62 strings from hashes of a counter."""
    seed = F.sha2(F.concat(F.lit("incipit"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(seed))
    upper_hex = F.upper(F.substring(seed, 1, 40))
    b62 = F.regexp_replace(b64, "[+/=]", "")
    return spark.range(samples).select(F.explode(F.array(F.substring(seed, 1, 40), upper_hex, b64, b62, F.upper(b62), F.translate(b64, "+/=", "-_"))).alias("s"))


def ordinary_strings(docs: DataFrame, train_docs: int) -> DataFrame:
    """Label ordinary: words of the sampled documents outside base matches, alone and joined to longer identifiers."""
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    # Only hashes meet in one task; the sample's texts are then taken where they are.
    cutoff = hashed.select("h").orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= F.lit(cutoff).cast("long"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), ACCESS, " ")
    words = F.filter(F.regexp_extract_all(clean, F.lit(f"([{RUN_CLASS}]+)"), F.lit(1)), lambda w: F.length(w) >= 2)
    joined = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)), F.lit(7)), lambda k: F.concat_ws("_", F.get("w", k), F.get("w", k + 1)))
    return some.select(words.alias("w")).select(F.explode(F.concat("w", joined)).alias("s"))


def identifiers(spark, samples: int) -> DataFrame:
    """Label ordinary: words joined in the styles of code, some with numbers or short forms, and rules of one character."""
    at = lambda *key: F.get(F.split(F.lit(" ".join(NAME_WORDS)), " "), F.pmod(F.xxhash64("id", *map(F.lit, key)), F.lit(len(NAME_WORDS))).cast("int"))
    number = lambda most, key: F.pmod(F.xxhash64("id", F.lit(key)), F.lit(most)).cast("string")
    few = F.pmod(F.xxhash64("id", F.lit("few")), F.lit(4)).cast("int") + 2
    first = F.when(F.col("id") % 9 == 0, F.concat(at("w", 0), number(64, "width"))).otherwise(at("w", 0))
    words = F.slice(F.array(first, *[at("w", k) for k in range(1, 5)]), 1, few)
    words = F.concat(words, F.when(F.col("id") % 4 == 0, F.array(number(300, "number"))).otherwise(F.array().cast("array<string>")), F.when(F.col("id") % 7 == 0, F.array(F.upper(F.substring(at("short"), 1, 3)))).otherwise(F.array().cast("array<string>")))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    pascal = F.array_join(F.transform("w", capital), "")
    camel = F.concat(F.get("w", F.lit(0)), F.array_join(F.transform(F.slice("w", F.lit(2), F.size("w")), capital), ""))
    path = F.array_join("w", "/")
    made = spark.range(samples).select(words.alias("w")).select(F.explode(F.array(F.array_join("w", "_"), camel, pascal, F.upper(F.array_join("w", "_")), F.array_join("w", "-"), path, F.concat(F.lit("/"), path))).alias("s"))
    rules = spark.range(5).select(F.explode(F.split(F.lit(ALPHABET), "")).alias("c")).where("c <> ''").select(F.repeat("c", F.lit(40)).alias("s"))
    return made.unionByName(rules)


def bigrams(strings: DataFrame) -> DataFrame:
    """Counts by (a, b): positions in ALPHABET from 1, a = 0 at the start."""
    at = F.transform(F.split("s", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = strings.select(F.filter(at, lambda x: x > 0).alias("x")).select(F.explode(F.zip_with(F.concat(F.array(F.lit(0)), "x"), "x", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return pairs.where("p.a is not null and p.b is not null").groupBy("p.a", "p.b").count()


def trained(docs: DataFrame, samples: int = 2000, train_docs: int = 1000, names: int = 3000) -> list[int]:
    """Log-likelihood ratio (random to ordinary, millinats) of each (previous, next) character, row by row."""
    n, spark = len(ALPHABET), docs.sparkSession

    def table(strings: DataFrame) -> list[list[float]]:
        c = [[0.0] * (n + 1) for _ in range(n + 1)]
        for r in bigrams(strings).collect():  # at most 68 x 67 rows
            c[r.a][r.b] += r["count"]
        return c

    rnd, made, prose = table(random_strings(spark, samples)), table(identifiers(spark, names)), table(ordinary_strings(docs, train_docs))
    total = lambda c: sum(map(sum, c))
    weight = total(made) / (total(prose) or 1.0)  # as many characters of words as of identifiers
    word = [[x + weight * y for x, y in zip(p, q, strict=True)] for p, q in zip(made, prose, strict=True)]
    whole = total(word)
    often = [sum(row[b] for row in word) / whole for b in range(n + 1)]
    word = [[0.0] + [row[b] + PRIOR * (often[b] / 2 + 1 / (2 * n)) for b in range(1, n + 1)] for row in word]
    rnd = [[0.0] + [row[b] + 0.5 for b in range(1, n + 1)] for row in rnd]
    logs = lambda c: [math.log(row[b] / sum(row)) for row in c for b in range(1, n + 1)]
    return [round(1000 * (a - b)) for a, b in zip(logs(rnd), logs(word), strict=True)]


def ratio(run: Column, model: list[int]) -> Column:
    """The run's log-likelihood ratio."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded to a constant
    start = F.struct(F.lit(0).alias("before"), F.lit(0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        b = F.instr(F.lit(ALPHABET), c)
        return F.struct(b.alias("before"), (a["sum"] + F.element_at(table, a["before"] * n + b)).alias("sum"))

    return F.aggregate(F.split(run, ""), start, step, lambda a: a["sum"])


def random_runs(text: Column, model: list[int]) -> Column:
    """Spans of the long runs of token characters that the models call random."""
    pattern = f"(?<![{RUN_CLASS}])[{RUN_CLASS}]{{{LEAST_RUN},}}+"

    def random(run: Column) -> Column:
        return let(ratio(run, model), lambda s: (s >= LEAST_SUM) & (s >= F.length(run) * LEAST_MEAN)) & ~run.rlike(UUID)

    return spans_of(text, pattern, 3, random)


def with_spans(docs: DataFrame, model: list[int]) -> DataFrame:
    """docs with _base, _random (runs that the models call random) and _spans (base and the random runs apart from it, by start, then kind)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumns({"_base": base_spans(text), "_random": random_runs(text, model)})
    return docs.withColumn("_spans", F.sort_array(F.concat("_base", apart(F.col("_random"), F.col("_base")))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov (spans that the models add), n_confirmed (runs the models
    call random that overlap a base span: what they would have found by themselves)."""
    docs = docs.select("doc_id", "text")
    found = with_spans(docs, trained(docs) if model is None else model)
    n = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    counts = [n("_base", 0).alias("n_assign"), n("_base", 1).alias("n_access"), n("_base", 2).alias("n_hex")]
    added = n("_spans", 3)
    return found.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"), added.alias("n_markov"), (F.size("_random") - added).alias("n_confirmed"))


def redacted(docs: DataFrame, model: list[int] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark (spans that overlap share one), and n_chars, where there is one, recounted."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    model = trained(docs) if model is None else model
    found = with_spans(docs.select(whole, "text"), model)
    block = 1000  # code points: the text is cut up once, so that a piece is found without walking the text from its start

    def replaced(blocks: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first = F.floor(begin / block).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor(end / block).cast("int") - first + 1), "")
            return F.substring(some, begin - first * block + 1, end - begin)

        def pieces(upto: Column) -> Column:
            gaps = F.transform(F.col("_spans"), lambda s, i: F.struct(F.get(upto, i).alias("begin"), s["start"].alias("end")))
            tail = F.struct(F.element_at(upto, -1).alias("begin"), F.length("text").alias("end"))
            # A span that overlaps what came before it has no gap and no mark of its own.
            return F.array_join(F.transform(F.filter(F.concat(gaps, F.array(tail)), lambda g: g["begin"] <= g["end"]), lambda g: piece(g["begin"], g["end"])), mark)

        return let(furthest(F.col("_spans")), pieces)

    text = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), replaced)
    some = F.size("_spans") > 0
    out = found.select("_doc", F.when(some, text).otherwise(F.col("text")).alias("_text"), some.alias("_some"))
    own = {"text": F.col("_text"), "n_chars": F.when(F.col("_some"), F.length("_text").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[own[c].alias(c) if own.get(c) is not None else F.col(f"_doc.`{c}`") for c in docs.columns])


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
