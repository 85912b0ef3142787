"""Fingerprints and links against brute force."""
import random
import re

import xxhash
from pyspark.sql import functions as F

from incipit.llm import simhash


def brute_fp(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, fp int")
    out = simhash.near_duplicates(df, **kw).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    return sorted(map(tuple, out.collect()), key=str)


def corpus():
    r = random.Random(5)
    words = ["w%d" % k for k in range(400)] + ["É", "ß", "X"]
    rows = []
    for d in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 40, 300, 900]))]
        rows.append((d * 10, " ".join(base)))
        for k in range(r.choice([0, 0, 2, 5])):
            near = list(base)
            near[r.randrange(len(near))] = r.choice(words)
            rows.append((d * 10 + 1 + k, "\n".join(near)))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (None, rows[0][1]), (5000, rows[3][1]), (5000, rows[3][1])]


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_crowded_keys_lose_nothing(spark):
    rows = corpus()
    assert got(spark, rows, pair_limit=1) == brute(rows)


def test_links_on_chosen_fingerprints(spark):
    """Families around one fingerprint, by pairs and by balls, against all pairs."""
    r = random.Random(9)
    fps = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for b in r.sample(range(64), r.randrange(5)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = sorted(fps)
    want = {(a, b) for a in rows for b in rows if a < b and (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit, exact in ((10_000, True), (3, False)):
        edges = {tuple(sorted((u % (1 << 64), v % (1 << 64)))) for u, v in simhash.links(df, limit).collect()}
        assert edges <= want
        assert edges == want if exact else groups(rows, edges) == groups(rows, want)


def groups(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_long_text(spark):
    """More shingles than one piece holds, and a text of one very long word."""
    r = random.Random(1)
    long = " ".join(str(r.randrange(5000)) for _ in range(140_000))
    rows = [(1, long), (2, long + " End"), (3, "x" * 2_000_000), (4, None)]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one(spark):
    """One row of each component; a repeated doc_id with another text is another document; rerun on other partitions."""
    rows = [(1, "a b c d", "s", 0), (2, "a b c d", "s", 0), (3, "other words are here", None, 1), (3, "other words are here", None, 0), (3, "quite different text of its own", "t", 1), (None, "a b c d", "s", 3), (None, "nobody named this one", "s", 4), (None, "nobody named this ONE", "s", 4), (4, None, None, None), (5, "", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, _doc int")
    want = sorted([(1, "a b c d", "s", 0), (3, "other words are here", None, 0), (3, "quite different text of its own", "t", 1), (None, "nobody named this ONE", "s", 4), (4, None, None, None)], key=str)
    for df in (docs, docs.repartition(5)):
        kept = simhash.keep_one(df)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == want


def test_keep_one_against_brute_force(spark):
    rows = corpus()
    fps = {(d, t): f for (d, t), f in ((x, brute_fp(x[1])) for x in rows)}
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    comp = {(d, f): c for d, f, c in brute(rows)}
    assert len({comp[d, f"{fps[d, t]:016x}"] for d, t in kept}) == len(kept) == len(set(comp.values()))
