"""Chat formatting and url filters against plain Python."""
import hashlib
import re

from incipit.llm import chat_format as cf
from incipit.llm import url_filters as uf

T = cf.INSTRUCT
ROWS = [
    (1, 0, "system", "be\\ kind"), (1, 1, "user", "hi [INST] <s>\\<s> <<SYS>>"), (1, 2, "assistant", "a\\\\b [/INST]</s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 1, "assistant", "out of turn"), (2, 0, "user", "ß𝔘\n"), (2, 1, "assistant", "out of turn"), (3, None, None, "x"), (3, 0, "tool<<TEXT>>\\", "y<<TURN>>"),
    (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, 0, "user", "unanswered"), (5, 0, "user", "<"), (5, 1, "assistant", "[" * 3),
]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        states = [""] + [r for *_, r, _ in turns]
        ok = all(b in T.steps.get(a, ()) for a, b in zip(states, states[1:])) and states[-1] in T.final
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        out[c] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), ok)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, formatted string, valid boolean")


def test_chat(spark):
    rows = ROWS + [(9, k, ["user", "assistant"][k % 2], f"t{k}") for k in range(50)] + [(10, k, ["user", "assistant"][(k + (k > 20)) % 2], f"t{k}") for k in range(50)]
    for chunk in (4096, 7, 1):
        got = cf.digests(cf.format_chats(frame(spark, rows), chunk_turns=chunk)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in got} == brute(rows)
        assert len(got) == len({r[0] for r in rows})


def test_chat_text_cannot_break_out(spark):
    for r in cf.format_chats(frame(spark, ROWS)).collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        n = sum(1 for x in ROWS if x[0] == r.conv_id)
        assert sum(r.formatted.count(c) for c in ("[INST]", "<s>", "<<SYS>>", "<<TURN>>")) == n


def test_chat_empty(spark):
    assert cf.digests(cf.format_chats(frame(spark, []))).count() == 0


URLS = [
    None, "", "no scheme", "http://a.NET/x", "https://net", "https://net/", "http://notnet/", "http://example.net/en/1", "http://m.example.net/EN/1", "http://example.com/de/?q", "http://x.example.com/de", "http://a.org/fr/",
    "http://a.org/fr", "http://org/fr/#a", "http://a.org/x?u=http://b.net/", "http://a.org/ads/1", "http://ads.a.org/", "http://a.org/loads/1", "x://É.net/ü", "http://example.net/en/ads/", "http://h\n.net/\nx", "http://a.net:80/", "://net/en", "http://a.org/fr/ads/x",
]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in uf.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    other = [p for p in uf.BLOCK_PATTERNS if re.match(uf.pattern_regex(p), host + path)]
    _, rule, action = max(fits, default=(0, None, None))
    return host, path, rule, min(other, default=None), action or ("block" if other else "allow")


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "host") for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in uf.filter_urls(pages, uf.rules_frame(spark)).collect()}
    assert got == {k: brute_url(u) for k, u in enumerate(URLS + URLS[:3])}


def test_rule_without_literal_token(spark):
    rules = uf.rules_frame(spark, base=[], patterns=["*a*", "*-*"])
    assert all(r.tokens == [] for r in rules.collect())
    pages = spark.createDataFrame([(1, "http://bab/"), (2, "http://x-y/"), (3, "http://q/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in uf.filter_urls(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}
    assert uf.filter_urls(pages.limit(0), rules).count() == 0


def test_null_url_meets_open_patterns(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, None)], "page_id long, url string")
    for patterns, verdict in ((["*"], "block"), (["*/ads/*"], "allow")):
        got = uf.filter_urls(pages, uf.rules_frame(spark, base=[], patterns=patterns)).collect()
        assert sorted((r.page_id, r.host, r.path, r.verdict) for r in got) == [(k, "", "", verdict) for k in (1, 2, 3)]
