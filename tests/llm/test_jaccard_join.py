"""Jaccard components against all pairs in plain Python, and the bounds that the join stands on."""
import random

import numpy as np
import pytest

from incipit.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, digest string, n string, keys string, c string"
RULE = jj.Rule()


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, "d", "n", "k", "c") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jj.jaccard_components(df, **sizes).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def text(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=5):
    rng = random.Random(seed)
    texts = []
    for size in (5, 8, 12, 30, 80, 200, 600):
        for _ in range(8):
            base = text(rng, size)
            texts += [base, base.upper(), base.replace(" ", "\n")]
            texts += [near(rng, base, c) for c in (1, 1, 2, 1 + size // 60, 1 + size // 40, 1 + size // 25)]
            cut_at = max(1, round(size * 0.86))
            texts += [" ".join(base.split()[:cut_at]), base + " " + text(rng, max(1, size // 8))]
    family = text(rng, 150)
    texts += [near(rng, family, rng.randrange(1, 7)) for _ in range(120)]  # a large family, chained
    passage = text(rng, 60)
    texts += [text(rng, rng.randrange(20, 90)) + " " + passage + " " + text(rng, rng.randrange(20, 90)) for _ in range(90)]
    texts += [passage + " " + text(rng, 6) for _ in range(40)]  # mostly passage
    texts += [None, "", " \t\n", "one", "ONE", "one two", "one two three", "one two three four", "one two three", "a\x0bb\x0cc d", "é É", "É é"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    return rows + [(3, text(rng, 40)), (3, texts[0]), (None, texts[5]), (None, text(rng, 50)), (None, None), rows[7], rows[7], (rows[9][0], rows[9][1].upper() + " "), (5000, "Aa bB cc dd ee"), (5000, "aa bb CC dd  ee"), (5000, "aa bb cc")]


@pytest.mark.parametrize("pair_limit", [16, 2])
def test_same_components_as_all_pairs(spark, pair_limit):
    rows = corpus()
    assert found(spark, rows, pair_limit=pair_limit) == brute(rows)


def test_long_text_and_empty_table(spark):
    rng = random.Random(1)
    long = text(rng, 60_000, 10**6)
    rows = [(1, long), (2, near(rng, long, 600)), (3, near(rng, long, 9000)), (4, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_sketch_distance_is_at_most_the_difference(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (3, 40, 500):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        other = np.concatenate([base[n // 4 :], rng.integers(0, 2**64, n // 5, dtype=np.uint64)])
        for space_bits in (20, 4):  # few bits: many flips cancel
            monkeypatch.setattr(jj, "PART_BITS", space_bits)
            apart = len(np.setxor1d(jj.sketch(base, 17), jj.sketch(other, 17)))
            assert apart <= len(np.setxor1d(base, other)) and (apart - len(np.setxor1d(base, other))) % 2 == 0


def test_dense_sketch_distance_is_at_most_the_difference():
    rng = np.random.default_rng(4)
    for n, lost in ((50, 3), (500, 40), (500, 400)):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        other = np.concatenate([base[lost:], rng.integers(0, 2**64, lost, dtype=np.uint64)])
        for bits in (64, 1000):
            far = jj.apart(jj.packed(base, bits), jj.packed(other, bits))
            assert far <= 2 * lost and far % 2 == 0
    assert jj.apart(jj.packed(base, 4000), jj.packed(other, 4000)) > 500


def test_linked_sets_share_a_key():
    """Just above the threshold, over sizes at and around the bands' bounds: some key is shared."""
    rng = np.random.default_rng(3)
    bands = jj.Bands(RULE)
    sizes = sorted({m for n in (6, 7, 8, 10, 13, 20, 50, 100, 333, 1000) for m in (n, bands.starts[bands.of(n)], bands.starts[bands.of(n)] - 1) if m})
    for n in sizes:
        for _ in range(30):
            whole = rng.integers(0, 2**64, 3 * n, dtype=np.uint64)
            lost = int(rng.integers(0, n * 15 // 100 + 1))
            gained = 0
            while RULE.linked(n, n - lost + gained + 1, n - lost):
                gained += 1
            a, b = whole[:n], whole[lost : n + gained]
            assert RULE.linked(len(a), len(b), n - lost)
            assert np.intersect1d(jj.keys(a, bands), jj.keys(b, bands)).size


def test_order_of_words_counts():
    a, b = jj.shingle_set("a b c d e", 4), jj.shingle_set("d c b a e", 4)
    assert len(a) == len(b) == 2 and not np.intersect1d(a, b).size
    assert jj.shingle_set("a b c d a b c d a b c", 4).size == 4


def test_batches_for_python_are_small(spark, monkeypatch):
    """op11: a batch held up to ten thousand texts, or pairs with both their sets, on both sides of a task."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, kept = spark.conf.get(name), jj.cut
    monkeypatch.setattr(jj, "cut", lambda df, label: (seen.append(int(spark.conf.get(name))), kept(df, label))[1])
    rows = [(k, "one two three four five six seven eight " + "x" * (k % 3)) for k in range(9)]
    assert jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == 9
    assert seen and max(seen) <= 500 and spark.conf.get(name) == before
