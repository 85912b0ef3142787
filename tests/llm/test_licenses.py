"""License scans against plain Python."""
import math
import re
from collections import Counter

from incipit.llm import licenses as lic

ROWS = [
    ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files"),
    ("a/b/x.py", "import os"), ("a/b/y.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("a/b/c/z.py", None), ("other/LICENSE.txt", "nothing of the kind"), ("other/q", "x"),
    ("n/notice_only", "Released under the MIT License.\n\nReleased under the MIT License."), ("n/sub/f", "mit der license"), ("top", "t"), (None, "Licensed under CC BY 4.0."), (None, "x"), ("a/b/x.py", "import os"),
    ("ab/x", "This work is licensed under the GNU General Public License, version 3. Ab und zu."), ("ab/y", "This work is licensed under the GNU General Public License, version 2"),
]


def cosine(segment):
    w = lic.Weights()
    tf = Counter(x for x in re.findall(lic.WORD, segment.lower()) if x not in lic.STOPWORDS)
    vec = {x: n * w.idf.get(x, w.unseen) for x, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in vec.values())) or 1
    dots = {}
    for k, name, word, v in w.rows:
        dots[k, name] = dots.get((k, name), 0) + vec.get(word, 0) * v
    return max(((round(d / norm, 6), name) for (_, name), d in dots.items()), key=lambda p: (p[0], [-ord(c) for c in p[1]]))


def brute(rows):
    own = {}
    for path, text in rows:
        named = bool(path and re.search(lic.LICENCE_NAME, path))
        lines = [x for x in (text or "").split("\n") if re.search("[a-z0-9]", x.lower())]
        hits = [cosine(x) for x in lines] + ([cosine(text)] if named and text else [])
        notices = sum(s >= lic.THRESHOLD for s, _ in hits[: len(lines)])
        good = sorted([(-s, n) for s, n in hits if s >= lic.THRESHOLD])
        if good:
            own[path] = min(own.get(path, ((1, ""), False)), ((good[0]), named or notices >= len(lines)))
    out = []
    dirs = {}
    for p, ((s, name), whole) in own.items():
        if whole and p is not None:
            d = p.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, (1, "")), (s, name))
    for path, _ in rows:
        if path in own:
            (s, name), whole = own[path]
            out.append((path, name, -s, whole, None))
            continue
        d = (path or "").rpartition("/")[0]
        while d not in dirs and d:
            d = d.rpartition("/")[0]
        hit = path is not None and d in dirs
        out.append((path, dirs[d][1] if hit else None, None, False, d if hit else None))
    return sorted(out, key=str)


def test_scan(spark):
    files = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "path string, text string, license string, id string")
    got = sorted((tuple(r) for r in lic.scan(files).collect()), key=str)
    assert got == brute(ROWS)
    by = {r[0]: r for r in got}
    assert by["a/b/x.py"][1] == "MIT" and by["a/b/y.py"][1] == "CC-BY-NC-4.0" and by["n/sub/f"][1] == "MIT" and by["top"][1] is None and by["ab/y"][1] == "GPL-2.0"


def test_skipped_lines_cannot_match():
    """Without a needed word, a template's other words have a norm below the threshold, which bounds the cosine."""
    w = lic.Weights()
    for k in range(len(lic.TEMPLATES)):
        left = [v for n, _, x, v in w.rows if n == k and not re.search(w.needed, x)]
        assert math.sqrt(sum(v * v for v in left)) < lic.THRESHOLD


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def wrapped(text, mark="", width=66):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_texts_over_lines(spark):
    """Wrapped headers and full texts, with comment marks, holders of their own and code around them."""
    from incipit.llm.licence_standards import full_texts, standards

    texts = standards()

    def header(name, start):
        return next(t for n, t in texts if n == name and t.startswith(start))

    full = dict(full_texts())
    gpl, bsd3, bsd2 = header("GPL-3.0", "This program"), header("BSD-3-Clause", "Redistribution"), header("BSD-2-Clause", "Redistribution")
    code = "\n\nint main() { return 0; }\n" * 50
    rows = {
        "g3/x.c": (wrapped(gpl.replace("This program is free", "Foo is free"), " * ") + code, "GPL-3.0"),
        "g2/x.py": (wrapped(header("GPL-2.0", "This program"), "# ") + code, "GPL-2.0"),
        "l/x.m4": (wrapped(header("LGPL-2.1", "This program"), "dnl ") + code, "LGPL-2.1"),
        "a/x.js": (wrapped(header("AGPL-3.0", "This program"), "// ", 40) + code, "AGPL-3.0"),
        "b3/x.h": (wrapped(bsd3.replace("the copyright holder nor", "Foo Inc. nor"), " * ") + code, "BSD-3-Clause"),
        "b2/x.h": (wrapped(bsd2, " * ") + code, "BSD-2-Clause"),
        "ap/x.go": (wrapped(header("Apache-2.0", "Licensed"), "// ") + code, "Apache-2.0"),
        "m/x.rs": (wrapped(header("MPL-2.0", "This Source"), "// ", 30) + code, "MPL-2.0"),
        "w/x": ("# Released under\n# the MIT License." + code, "MIT"),
        "s/x": ("// SPDX-License-Identifier: GPL-2.0-only OR MIT" + code, "GPL-2.0-only OR MIT"),
        "o/COPYING": (full["GPL-3.0"][:600], "GPL-3.0"),
        "i/terms": ("ISC License\n\nCopyright (c) 2020 A B\n\n" + wrapped(header("ISC", "Permission")), "ISC"),
        "mit/LICENSE": ("MIT License\n\nCopyright (c) 2020 A B\n\n" + wrapped(header("MIT", "Permission")), "MIT"),
        **{f"full-{n}/LICENSE": (t, n) for n, t in full.items()},
    }
    extra = [("i/sub/y", "code"), ("full-GPL-3.0/sub/y", None), ("g3/y", "the program is free software and so on"), ("p/y", "permission is granted to copy this software")]
    files = spark.createDataFrame([*((p, t) for p, (t, _) in rows.items()), *extra], "path string, text string")
    got = {r.path: r for r in lic.scan(files).collect()}
    assert {p: got[p].license for p in rows} == {p: want for p, (_, want) in rows.items()}
    assert all(got[p].score >= lic.THRESHOLD for p in rows)
    assert got["i/terms"].licence_file and got["i/sub/y"].license == "ISC" and got["full-GPL-3.0/sub/y"].license == "GPL-3.0"
    assert not got["g3/x.c"].licence_file and got["g3/y"].license is None and got["p/y"].license is None
