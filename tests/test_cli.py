"""Exit codes and a conversion from a PDF written by the tests."""
from incipit import cli
from tests.test_pdf import write


def page(*lines):
    out = []
    for k, (size, text) in enumerate(lines):
        out.append(f"BT /R {size} Tf 72 {700 - 30 * k} Td ({text}) Tj ET")
    return " ".join(out)


PROSE = "A reader is called patient when the text that follows goes on for longer than one line of print, and this one does."


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["convert", str(tmp_path / "none.pdf")]) == cli.USAGE
    book = tmp_path / "book.pdf"
    pages = [page((20, "Chapter 1"), (20, "Opening"), (10, PROSE), (14, "1.1 First"), (10, PROSE), (14, "1.2 Second"), (10, PROSE)), page((20, "Chapter 2"), (20, "Closing"), (10, PROSE), (14, "2.1 Third"), (10, PROSE), (14, "2.2 Last"), (10, "The zebra appears only in this sentence of the book."))]
    book.write_bytes(write(pages))
    assert cli.main(["search", str(book), "zebra", "-k", "2"]) == cli.OK
    assert "zebra" in capsys.readouterr().out
    assert cli.main(["convert", str(book), "--out", str(tmp_path)]) == cli.OK
    made = list(tmp_path.glob("*/SKILL.md"))
    assert len(made) == 1 and sorted(p.name for p in (made[0].parent / "references").iterdir()) == ["ch01-opening.md", "ch02-closing.md"]
