"""The PDF reader on a file written here, through to blocks."""
import zlib

from incipit.operators import layout
from incipit.scale import cut
from incipit.sources import pdf


def write(pages: list[str], form: str = "", packed: bool = False) -> bytes:
    """A plain PDF with fonts R and M; pages are content streams, form is drawn by /X Do."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R /Outlines 7 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Serif /FirstChar 32 /LastChar 126 /Widths [" + b" ".join(str(400 + c % 7 * 50).encode() for c in range(32, 127)) + b"] >>"]
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /LastChar 126 /Widths [" + b" ".join([b"600"] * 95) + b"] >>")
    res = b"<< /Font << /R 3 0 R /M 4 0 R >> /XObject << /X 6 0 R >> >>"
    objects += [res, b"<< /Type /XObject /Subtype /Form /Resources 5 0 R /Length %d >>\nstream\n%s\nendstream" % (len(form), form.encode())]
    first = 9
    objects += [b"<< /First 8 0 R >>", b"<< /Title (Start \\(one\\)) /Dest [%d 0 R /Fit] >>" % first]
    kids = []
    for text in pages:
        data = zlib.compress(text.encode("latin-1")) if packed else text.encode("latin-1")
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources 5 0 R /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", data))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1))
    return body + b"trailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF"


PAGE = "BT /R 10 Tf 72 700 Td (Plain words \\(here\\)) Tj 0 -12 Td [(ker) -20 (ned) -400 (gap)] TJ ET q 2 0 0 2 0 0 cm BT /M 5 Tf 36 300 Td (code) Tj ET Q /X Do"


def test_read():
    for packed in (False, True):
        runs, fonts = pdf.read(write([PAGE, "BT /R 12 Tf 1 0 0 1 50 60 Tm (second) Tj ET"], "BT /R 8 Tf 10 10 Td (fig) Tj ET", packed))
        assert [(r[0], round(r[2]), round(r[3]), round(r[4]), r[6], r[7]) for r in runs] == [(0, 72, 700, 10, "Plain words (here)", False), (0, 72, 688, 10, "kerned gap", False), (0, 72, 600, 10, "code", False), (0, 10, 10, 8, "fig", True), (1, 50, 60, 12, "second", False)]
        assert {f[0]: f[4] for f in fonts} == {"Serif": False, "Courier": True}
    assert pdf.outline(write([PAGE])) == [(0, "Start (one)", 0)]


def test_tounicode():
    cmap = b"2 beginbfchar <03> <0020> <04> <00660069> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0041> <0042>] endbfrange"
    assert pdf.tounicode(cmap) == {3: " ", 4: "fi", 16: "a", 17: "b", 18: "c", 32: "A", 33: "B"}


def test_scan_to_lines(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(write([PAGE], "BT /R 8 Tf 10 10 Td (fig) Tj ET"))
    runs, fonts = pdf.scan(spark, str(tmp_path))
    lines = layout.with_line_columns(layout.group_lines(layout.measured(cut(runs), cut(fonts)))).orderBy("line_no").collect()
    assert [(r.book, r.text, r.mono_fraction) for r in lines] == [("small", "Plain words (here)", 0.0), ("small", "kerned gap", 0.0), ("small", "code", 1.0), ("small", "fig", 0.0)]
