"""Small fixtures with known answers: a synthetic book as positioned runs with planted layout features, scalars, anchors."""

WIDTHS = {c: 400.0 + ord(c) % 7 * 50 for c in map(chr, range(33, 127))} | {" ": 250.0}
FONTS = [("b", "R", WIDTHS, 500.0, "Serif", False), ("b", "M", {c: 600.0 for c in map(chr, range(32, 127))}, 600.0, "Typewriter", True)]
FONT_SCHEMA = "book string, font string, char_widths map<string,double>, avg_width double, family string, mono boolean"
RUN_SCHEMA = "book string, page int, run_no int, x double, y double, size double, font string, text string, in_figure boolean, lead_space boolean, pad int"


class Pages:
    def __init__(self):
        self.rows = []

    def run(self, page, y, text, x=72.0, size=10.0, font="R", fig=False, lead=False):
        self.rows.append(("b", page, len(self.rows), float(x), float(y), float(size), font, text, fig, lead, 0))

    def lines(self, page, y, texts, **kw):
        for k, t in enumerate(texts):
            self.run(page, y - 12 * k, t, **kw)


def tiny_book():
    p = Pages()
    p.run(0, 600, "A Tiny Book", size=24)
    for page in (2, 3, 4, 5):
        p.run(page, 750, f"{page} A Tiny Book")
    p.run(1, 650, "Contents of this volume are described on later pages of it.")
    long = "Every line of this paragraph is long enough to count as body text, it"
    p.run(2, 650, "Chapter 1", size=20)
    p.run(2, 620, "Getting Started", size=20)
    p.lines(2, 580, [long, "goes on about assign-", "ments and a func-", "tion that is well-", "known to readers. All assignments use a function here."])
    p.run(2, 500, "fig label 42", x=300, fig=True)
    p.run(2, 480, "1.1 First Section", size=14)
    p.lines(2, 450, ["A variable is called a name that refers to a value in memory. It is well-known.", "Look at the code:"])
    p.run(2, 420, "def double(x):", font="M")
    p.run(2, 408, "return 2 * x", x=72 + 24, font="M")
    p.run(3, 700, "1.2 Second Section", size=14)
    p.run(3, 670, "Call it with")
    p.run(3, 670, "double(21)", x=140, font="M")
    p.run(3, 670, "to get 42.", x=210)
    p.run(4, 650, "Chapter 2", size=20)
    p.run(4, 620, "Next Steps", size=20)
    p.lines(4, 580, ["T uples are sequences of values which cannot be changed once made. Many", "programs use tuples in place of lists when the values belong together."])
    p.run(4, 500, "2.1 More", size=14)
    p.lines(4, 470, ["The ﬁrst ﬂoat is eﬃcient, and a sequence is known as a list when it can change."])
    p.run(5, 700, "2.2 Last", size=14)
    p.lines(5, 670, ["The end of the book is short and it has no more code in it at all."])
    return p.rows


SCALARS = [(1, "xxii"), (2, "12 Chapter 2. Variables"), (3, "git commands, add"), (4, "version control,local"), (5, "What is the Variable?"), (6, "Classes and dictionaries"), (7, "② callout"), (8, "mcm")]
#: slug, roman, kind and number at an edge, tokens, term of an index entry.
SCALAR_ANSWERS = [
    (1, "xxii", 22, "roman", 22, "xxii", "xxii"), (2, "12-chapter-2-variables", None, "arabic", 12, "12 chapter 2 variable", "12 Chapter 2. Variables"), (3, "git-commands-add", None, None, None, "git command add", "git add"),
    (4, "version-control-local", None, None, None, "version control local", "local version control"), (5, "what-is-the-variable", None, None, None, "variable", "What is the Variable?"), (6, "classes-and-dictionaries", None, None, None, "class dictionary", "Classes and dictionaries"),
    (7, "callout", None, None, None, "callout", "② callout"), (8, "mcm", 1900, "roman", 1900, "mcm", "mcm"),
]
ANCHORED = [("1", 0, "((x)) ", "x"), ("1", 1, "code", ""), ("1", 2, "((y)) prose ((w))", "five words are in here"), ("1", 3, "((z))", ""), ("2", 0, "((q))", ""), ("2", 1, "none", "the next block has the prose")]
#: Blocks of the book after all repairs.
BLOCKS = [
    (0, "heading", "A Tiny Book", 0, 24.0), (1, "paragraph", "Contents of this volume are described on later pages of it.", 1, 10.0), (2, "heading", "Chapter 1 Getting Started", 2, 20.0),
    (3, "paragraph", "Every line of this paragraph is long enough to count as body text, it goes on about assignments and a function that is well-known to readers. All assignments use a function here.", 2, 10.0),
    (4, "heading", "1.1 First Section", 2, 14.0), (5, "paragraph", "A variable is called a name that refers to a value in memory. It is well-known. Look at the code:", 2, 10.0), (6, "code", "def double(x):\n    return 2 * x", 2, 10.0), (7, "heading", "1.2 Second Section", 3, 14.0),
    (8, "paragraph", "Call it with double(21) to get 42.", 3, 10.0), (9, "heading", "Chapter 2 Next Steps", 4, 20.0), (10, "paragraph", "Tuples are sequences of values which cannot be changed once made. Many programs use tuples in place of lists when the values belong together.", 4, 10.0),
    (11, "heading", "2.1 More", 4, 14.0), (12, "paragraph", "The first float is efficient, and a sequence is known as a list when it can change.", 4, 10.0), (13, "heading", "2.2 Last", 5, 14.0), (14, "paragraph", "The end of the book is short and it has no more code in it at all.", 5, 10.0),
]
