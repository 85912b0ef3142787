"""Text functions as Spark column expressions: tokens, stems, sentences, n-grams, names and markup stripping.

All are built-in expressions (no Python in the tasks). A null text gives null, or an empty array where an array is due.
White space is that of the JVM's `\\s` (ASCII).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search ignores.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers herself him himself his
how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves
out over own same she should so some such than that the their theirs them themselves then there these they this those
through to too under until up very was we were what when where which while who whom why will with would you your yours
yourself yourselves
""".split()
# Ligature glyphs and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Typographic characters and their plain forms.
PLAIN_FROM, PLAIN_TO = "‘’“”–—−\u00a0•", "''\"\"---  "
# Ranges that hold all of these characters.
PLAIN_SOME = r"[\u00a0\u2013-\u2022\u2212]"
# Phrases of sentences that define a term.
DEFINING = (
    r"(?iU)\b(?:is called|are called|is known as|are known as|we call|refers? to|is defined as|are defined as|"
    r"is a (?:\w+ ){0,3}(?:that|which|used)|means that|is short for|stands for)\b"
)
SENTENCE_GAP = r"""(?<=[.?!])\s+(?=[A-Z("'])"""
INDEX_SENTENCE_GAP = r"""(?<=[.?!:])\s+(?=[A-Z"'(`])"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(value: Column) -> Column:
    """value, as a generator of one row: it is computed once a row. The optimizer copies the expression of a plain column into the
    filters and projections that use it, and into the filter that it infers of every explode."""
    return F.explode(F.array(value))


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    return F.size(words(text))


# ------------------------------------------------------------------ search


def stem(word: Column) -> Column:
    """Plural and verb endings off, at most one of each kind of rule."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    plain_s = word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is")
    return (
        F.when(word.endswith("ies") & (n >= 6), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("sses") & (n >= 7), cut(2))
        .when(word.endswith("es") & (n >= 5), cut(1))
        .when(plain_s & (n >= 4), cut(1))
        .when(word.endswith("ing") & (n >= 7), cut(3))
        .when(word.endswith("ed") & (n >= 6), cut(2))
        .otherwise(word)
    )


def tokenize(text: Column | str) -> Column:
    """Lower-cased alphanumeric runs without stopwords, stemmed."""
    found = matches(F.lower(col(text)), "[a-z0-9]+")
    return F.transform(F.filter(found, lambda t: ~t.isin(*STOPWORDS)), stem)


# ---------------------------------------------------------------- rendering


def expand_ligatures(text: Column | str) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), LIGATURES.items(), col(text))


def ligature_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit("[\ufb00-\ufb06]"))


def nfc(text: Column | str) -> Column:
    """The text in Unicode's composed form.

    Texts without any combining mark, Hangul letter or character of a compatibility block are in that form already; only the
    others go through Python, in Arrow batches, of which few texts at a time are Python's strings.
    """

    @F.arrow_udf("string")
    def composed(t: pa.Array) -> pa.Array:
        form = lambda x: None if x is None else unicodedata.normalize("NFC", x)
        parts = [pa.array([form(x.as_py()) for x in t.slice(k, 100)], pa.string()) for k in range(0, len(t), 100)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    # Blocks that hold every character whose composed form differs or that joins the one before it.
    open_forms = r"[\p{M}\u0340-\u0387\u0958-\u0fb9\u1100-\u11ff\u1f71-\u1ffd\u2000-\u2001\u2126-\u212b\u2329-\u232a\u2adc\uf900-\ufaff\ufb1d-\ufb4e]|[^\u0000-\uffff]"
    text = col(text)
    some = text.rlike(open_forms)
    return F.when(some, composed(F.when(some, text))).otherwise(text)


def plain(text: Column | str) -> Column:
    """Quotes, dashes, bullets and no-break spaces in their plain form."""
    return let(col(text), lambda t: F.when(t.rlike(PLAIN_SOME), F.translate(t, PLAIN_FROM, PLAIN_TO)).otherwise(t))


def fidelity_tokens(text: Column | str) -> Column:
    return matches(plain(text), r"(?U)\w+|[^\w\s]")


def vocabulary(text: Column | str) -> Column:
    """Distinct lower-cased ASCII words."""
    return F.array_distinct(F.transform(matches(plain(text), "[A-Za-z]+"), F.lower))


def title_key(title: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(title)), "[^a-z0-9]+", "")  # typographic characters go, as their plain forms would


# ----------------------------------------------------------------- evidence


def evidence_words(text: Column | str) -> Column:
    return matches(F.lower(plain(expand_ligatures(text))), "[a-z0-9]+")


def grams(tokens: Column, n: int = 3) -> Column:
    """Distinct n-grams, space-joined; none for fewer than n tokens."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda k: F.concat_ws(" ", *[F.get(w, k + d) for d in range(n)])))

    return let(tokens, of)


def gram_set(text: Column | str) -> Column:
    return grams(evidence_words(text), 3)


def short_gram_set(text: Column | str) -> Column:
    """Trigrams, or the whole text as one gram where it has fewer than three words."""
    return let(evidence_words(text), lambda w: F.when(F.size(w) >= 3, grams(w)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def coverage(unit: Column | str, gold: Column | str) -> Column:
    """Share of the gold sentence's n-grams that the unit has; n is 3, or the gold's length if shorter."""

    def of(g: Column) -> Column:
        n = F.size(g)
        unit_words = evidence_words(unit)
        own = F.when(n == 1, grams(unit_words, 1)).when(n == 2, grams(unit_words, 2)).otherwise(grams(unit_words, 3))
        goal = F.when(n == 1, grams(g, 1)).when(n == 2, grams(g, 2)).otherwise(grams(g, 3))
        return let(goal, lambda x: F.when(F.size(x) > 0, shared(x, own) / F.size(x)).otherwise(0.0))

    return let(evidence_words(gold), of)


# ---------------------------------------------------------------- sentences


def sentences(text: Column | str, gap: str = SENTENCE_GAP) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), gap), lambda s: F.trim(s)), lambda s: s != "")


def index_sentences(text: Column | str) -> Column:
    """Sentences of five words or more, cut after colons too."""
    return F.filter(sentences(text, INDEX_SENTENCE_GAP), lambda s: F.size(words(s)) >= 5)


def sentence_with(paragraph: Column | str, term: Column | str) -> Column:
    """The first sentence that holds the term (in any case), else the paragraph."""
    parts = F.split(col(paragraph), r"""(?<=[.?!:])\s+(?=[A-Z"(])""")
    first = let(F.lower(col(term)), lambda t: F.get(F.filter(parts, lambda s: F.contains(F.lower(s), t)), F.lit(0)))  # the term may be a costly expression
    return F.coalesce(first, col(paragraph))


def defines(sentence: Column | str) -> Column:
    return col(sentence).rlike(DEFINING)


# --------------------------------------------------------------------- names


def slugify(text: Column | str, limit: int = 40) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(slug == "", "untitled").otherwise(slug)


def skill_name(title: Column | str) -> Column:
    return slugify(title, 64)


def reference_file_name(number: Column | str, title: Column | str) -> Column:
    number = col(number)
    padded = F.when(number.rlike("^[0-9]$"), F.concat(F.lit("0"), number)).otherwise(number)
    return F.concat(F.lit("references/ch"), padded, F.lit("-"), slugify(title), F.lit(".md"))


# Values of roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_to_int(token: Column | str) -> Column:
    """Subtractive sum of roman digits, without a validity check; null for other tokens."""
    token = F.lower(col(token))
    value = lambda c: reduce(lambda x, p: x.when(c == p[0], p[1]), ROMAN.items(), F.when(F.lit(False), 0)).otherwise(0)
    digits = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), value)
    total = let(digits, lambda d: F.aggregate(F.transform(d, lambda v, k: F.when(v < F.coalesce(F.get(d, k + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v))
    return F.when(token.rlike("^[ivxlcdm]+$") & (total > 0), total)


def edge_number(text: Column | str) -> Column:
    """struct<kind, number> of a page number that starts or ends a line; null without one."""

    def of(w: Column) -> Column:
        def one(token: Column) -> Column:
            arabic = token.rlike("^[0-9]{1,4}$")
            roman = roman_to_int(token)
            return F.when(arabic, F.struct(F.lit("arabic").alias("kind"), F.when(arabic, token).cast("int").alias("number"))).when(roman.isNotNull(), F.struct(F.lit("roman").alias("kind"), roman.alias("number")))

        return F.when(F.size(w) > 0, F.coalesce(one(F.get(w, F.lit(0))), one(F.element_at(w, -1))))

    return let(words(text), of)


def split_of(book: Column | str, term: Column | str) -> Column:
    """dev or test by a hash; 16 is 1 modulo 5, so the hash modulo 5 is that of its digit sum."""
    digest = F.sha2(F.concat(col(book), F.lit("\x00"), F.lower(col(term))), 256)
    total = F.aggregate(F.filter(F.split(digest, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.conv(c, 16, 10).cast("int"))
    return F.when(total % 5 == 0, "test").otherwise("dev")


def index_variants(term: Column | str) -> Column:
    """Spellings under which an index term may stand in a glossary."""

    def of(t: Column) -> Column:
        more = F.when(t.endswith("ies"), F.array(F.regexp_replace(t, "ies$", "y"))).otherwise(F.array())
        return F.array_distinct(F.concat(F.array(t, F.when(F.contains(t, F.lit("s")), F.regexp_replace(t, "s+$", "")).otherwise(t), F.concat(t, F.lit("s"))), more))

    return let(F.lower(col(term)), of)


def term_variants(term: Column | str) -> Column:
    def of(t: Column) -> Column:
        return F.concat(F.array(t, F.concat(t, F.lit("s")), F.concat(t, F.lit("es"))), F.when(t.endswith("y"), F.array(F.regexp_replace(t, "y$", "ies"))).otherwise(F.array()))

    return let(F.lower(col(term)), of)


def junk_title(title: Column | str) -> Column:
    """Metadata titles that are file names, program names or numbers."""
    t = F.trim(col(title))
    return t.isNull() | (t == "") | t.rlike(r"(?i)\.(dvi|tex|docx?|indd|qxd|pdf|ps|odt|rtf)$") | t.rlike(r"(?i)^(microsoft word|untitled|document\d*$|powerpoint)") | ~t.rlike("[A-Za-z]{2}")


# ------------------------------------------------------------------ markdown


def prose_lines(markdown: Column | str) -> Column:
    """Lines that can hold book prose: no fenced code, headings, tables or boilerplate; labels and list marks removed."""
    bare = F.regexp_replace(col(markdown), r"(?sm)^```.*?^```[ \t]*$", "")
    lines = F.transform(F.split(bare, "\n"), lambda s: F.trim(s))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|\||Source pages |Open this file for questions about:)"))
    return F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"^From \*[^*\n]+\*:\s*", ""), r"^\s*(?:[-*+]|\d+[.)])\s+", ""))


def prose_text(markdown: Column | str) -> Column:
    return F.array_join(prose_lines(markdown), "\n")


def prose_words(markdown: Column | str) -> Column:
    return n_words(prose_text(markdown))


# -------------------------------------------------------------------- markup

# LaTeX commands and what they leave, in the order they are applied.
TEX_RULES = [
    (r"\\index\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", ""), (r"\\label\{[^{}]*\}", ""), (r"~\\ref\{[^{}]*\}", " N"), (r"\\ref\{[^{}]*\}", "N"), (r"\\cite\{[^{}]*\}", ""),
    (r"\\url\{([^{}]*)\}", "$1"), (r"\\href\{[^{}]*\}\{([^{}]*)\}", "$1"), (r"\\footnote\{[^{}]*\}", ""), (r"\\verb(.)(.*?)\1", "$2"),
    (r"\\(?:emph|textbf|texttt|textit|mathrm|mbox|hbox|tt|bf|em|it)\b\s*", ""), (r"\\(?:ldots|dots)\b", "..."), (r"\\%", "%"), (r"\\_", "_"), (r"\\&", "&"), (r"\\#", "#"), (r"\\\$", r"\$"),
    (r"``|''", '"'), (r"---", "\u2014"), (r"--", "\u2013"), (r"\\[a-zA-Z]+\*?", ""), (r"[{}$]", ""), (r"~", " "),
]
# What a text must hold for each of these rules to change it ("": not asked).
TEX_NEEDS = ["\\index{", "\\label{", "~\\ref{", "\\ref{", "\\cite{", "\\url{", "\\href{", "\\footnote{", "\\verb", "\\", "dots", "\\%", "\\_", "\\&", "\\#", "\\$", "", "---", "--", "\\", "", "~"]
# Groups of those rules (first, end), and what a text must hold for any of the group to change it.
TEX_GROUPS = {0: (9, r"\\(?:index|label|ref|cite|url|href|footnote|verb)"), 10: (16, r"dots|\\[%_&#$]"), 16: (19, "``|''|--")}
# Asciidoc inline markup and what it leaves, in order.
ASCIIDOC_RULES = [
    (r"\(\(\([^()]*\)\)\)", ""), (r"footnote:\[([^\]]*)\]", " $1"), (r"(?:link:)?(?:https?|ftp)://\S+?\[([^\]]*)\]", "$1"), (r"<<[^,>]*,\s*([^>]*)>>", "$1"), (r"<<[^>]*>>", ""), (r"kbd:\[([^\]]*)\]", "$1"),
    (r"\"`([^`]*)`\"", "$1"), (r"'`([^`]*)`'", "$1"), (r"`+([^`]*)`+", "$1"), (r"(?=[*_])(?<!\w)[*_]{1,2}([^*_\n]+?)[*_]{1,2}(?!\w)", "$1"), (r"\{(?:empty|nbsp|sp)\}", " "), (r"\s+\+$", ""),
]

ASCIIDOC_NEEDS = ["(((", "footnote:[", "://", "<<", "<<", "kbd:[", "\"`", "'`", "`", "", "{", "+"]


def rewritten(text: Column, rules: list[tuple[str, str]], needs: list[str], groups: dict[int, tuple[int, str]] | None = None) -> Column:
    """Rules in order. One whose need the text lacks is passed over, and so is a group of which the text holds nothing: a search for
    that takes a fraction of the rules' time."""

    def one(x: Column, k: int) -> Column:
        rule, need = rules[k], needs[k]
        return let(x, lambda v: F.when(F.contains(v, F.lit(need)), F.regexp_replace(v, *rule)).otherwise(v)) if need else F.regexp_replace(x, *rule)

    def some(x: Column, first: int, end: int, holds: str) -> Column:
        return let(x, lambda v: F.when(v.rlike(holds), reduce(one, range(first, end), v)).otherwise(v))

    groups, k = groups or {}, 0
    while k < len(rules):
        text, k = (some(text, k, *groups[k]), groups[k][0]) if k in groups else (one(text, k), k + 1)
    return text


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r" \s+|[^\S ]\s*", " "))  # single blanks are left alone


def detex(text: Column | str) -> Column:
    """LaTeX prose to plain text."""

    def of(t: Column) -> Column:
        bare = let(t, lambda v: F.when(F.contains(v, F.lit("%")), F.regexp_replace(v, r"%(?<!\\%)[^\n]*", "")).otherwise(v))
        return rewritten(bare, TEX_RULES, TEX_NEEDS, TEX_GROUPS)

    # Every rule starts with one of these characters.
    return squeezed(let(col(text), lambda t: F.when(t.rlike(r"[\\{}$~%`'-]"), of(t)).otherwise(t)))


def asciidoc_text(block: Column | str) -> Column:
    """Asciidoc prose to plain text: no directive lines, list marks or inline markup."""
    lines = F.transform(F.split(col(block), r"\r?\n"), lambda s: F.trim(s))
    prose = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^(\[|image::|include::|//|=|:|\|===)") & ~s.rlike(r"^\.[A-Za-z]") & ~s.isin("****", "____", "--"))
    return squeezed(rewritten(F.array_join(F.transform(prose, lambda s: F.regexp_replace(s, r"^[*.]+\s+", "")), " "), ASCIIDOC_RULES, ASCIIDOC_NEEDS))


def latex_term(entry: Column | str) -> Column:
    """An index entry's term: sub-entry before entry, display form, no see-references; empty without a word."""
    parts = F.split(F.split(col(entry), r"\|", 2)[0], "!")
    shown = F.filter(F.transform(parts, lambda p: detex(F.regexp_replace(p, "(?s)^[^@]*@", ""))), lambda p: p != "")
    return let(F.array_join(F.reverse(shown), " "), lambda term: F.when(term.rlike("[A-Za-z]{2}"), term).otherwise(""))


def asciidoc_term(entry: Column | str) -> Column:
    def of(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.when((F.lower(first) == "git commands") & second.isNotNull(), F.concat(F.lit("git "), second)).otherwise(F.array_join(F.reverse(p), " "))

    return let(F.filter(F.transform(F.split(col(entry), ","), lambda s: F.trim(s)), lambda p: p != ""), of)


def hevea_chapter(heading: Column | str) -> Column:
    """struct<number, title> of `Chapter 3  Title` or `Appendix A  Title` headings."""
    h = col(heading)
    pattern = r"(?s)^(?:Chapter|Appendix)\s+([0-9A-Z]+)\s+(.*)"
    return F.when(h.rlike(pattern), F.struct(F.regexp_extract(h, pattern, 1).alias("number"), F.trim(F.regexp_extract(h, pattern, 2)).alias("title"))).otherwise(F.struct(F.lit("").alias("number"), h.alias("title")))


def asciidoctor_chapter(heading_id: Column | str, heading: Column | str) -> Column:
    """struct<number, title>, numbered by ids such as ch03-name or A-name."""
    i = F.coalesce(col(heading_id), F.lit(""))
    number = F.when(i.rlike(r"^ch\d+-"), F.regexp_replace(F.regexp_extract(i, r"^ch(\d+)-", 1), "^0+(?=.)", "")).when(i.rlike("^[A-Z]-"), F.substring(i, 1, 1)).otherwise("")
    return F.struct(number.alias("number"), col(heading).alias("title"))


# ------------------------------------------------------------------ questions


def search_queries(kind: Column, term: Column, definition: Column) -> Column:
    """array<struct<qtype, query>> of a question."""
    one = lambda t, q: F.struct(F.lit(t).alias("qtype"), q.alias("query"))
    explain = F.array(one("term", F.concat(F.lit("Where does the book explain "), term, F.lit("?"))))
    return F.when(kind == "index", explain).otherwise(F.array(one("term", F.concat(F.lit("What is "), term, F.lit("?"))), one("definition", definition)))


def reader_question(term: Column | str) -> Column:
    return F.concat(F.lit('In the book, what is meant by "'), col(term), F.lit('"?'))


def says_correct(reply: Column | str) -> Column:
    """Whether the first word of a judge's reply is CORRECT."""
    return F.regexp_extract(F.upper(col(reply)), "[A-Z]+", 0) == "CORRECT"


def routed(reply: Column | str, files: Column) -> Column:
    """struct<file, ok>: the first file that the reply names, by path or base name; else the first file, not ok."""
    hit = F.get(F.filter(files, lambda f: F.contains(col(reply), f) | F.contains(col(reply), F.substring_index(f, "/", -1))), F.lit(0))
    return F.struct(F.coalesce(hit, F.get(files, F.lit(0))).alias("file"), hit.isNotNull().alias("ok"))
