"""Prefix trie against a plain-Python trie."""
import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from incipit.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string, path string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    token = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", token(role or "", text or ""), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def below(p):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        for q in children[p]:
            x, y = below(q)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *below(p), hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in list(members.items())
    )


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = pt.op13_prefix_trie(spark, str(tmp_path)).collect()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in pt.RESULT) for r in got)


def test_copies_ties_nulls_and_turnless(spark, tmp_path):
    rows = []
    for c in range(0, 130):
        if c in (20, 60):
            continue  # families without a base: short members lose all their turns
        length = 1 + c % 6
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"word {t} of\t{c % 3 if t > 2 else 0}\n") for t in range(length)]
    rows += [(7, 1, "user", "tie b"), (7, 1, "assistant", "tie a"), (7, 1, "user", "tie b"), (9, None, None, None), (9, None, "user", ""), (None, 0, "user", "nobody")]
    rows += [(200 + c, 0, "user", "hot turn") for c in range(40)] + [(300, t, "user", f"x{t}") for t in range(300)]
    rows += [(301, t, "user", f"x{t}") for t in range(290)] + [(c, 0, "a:b", "c") for c in (400, 401)] + [(402, 0, "a", ":bc")]
    rows += [(5_000_000_000 + c, t, "user", f"far {t}") for c in range(3) for t in range(5)] + [(500, 0, "user", "long " * 40_000)]
    got = found(spark, rows, tmp_path)
    assert got == brute([r for r in rows])
    assert any(r[1] == 0 and r[3] == len({r[0] for r in rows if r[0] is not None}) for r in got)


def test_empty(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_sums_over_partitions(spark):
    """Prefix sums over ids of several range partitions, whatever the order of the rows."""
    ids = [(p << 33) + k for p in (0, 2, 3) for k in range(50)]
    rows = [(i, k % 7) for k, i in enumerate(ids)]
    got = {r.i: r.before_v for r in pt.summed_before(spark.createDataFrame(rows[::-1], "i long, v long"), "i", ["v"]).collect()}
    total = 0
    for i, v in rows:
        assert got[i] == total
        total += v


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_same_rows_as_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '/root/testdata/{sf}/conversations.parquet'")
    want = db.execute(pt.oracle())
    names = [c[0] for c in want.description]
    at = [names.index(c) for c in pt.RESULT]
    plain = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows)
    assert plain(pt.op13_prefix_trie(spark, f"/root/testdata/{sf}").collect()) == plain([tuple(r[k] for k in at) for r in want.fetchall()])
