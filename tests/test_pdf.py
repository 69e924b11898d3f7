import zlib

import pytest

from collatrix.sources import pdf as P

CONTENT = b"q 200 0 0 150 100 500 cm /Fm Do Q q 1 0 0 1 0 0 cm 50 400 300 0.5 re f Q 10 10 5 5 re f BI /W 1 ID x EI /Im Do"


def made(compressed=False, broken=False, art=b"0 0 m 1 1 l S"):
    stream = lambda d, extra=b"": (b"<< /Length %d %s >>\nstream\n" % (len(d), extra + (b" /Filter /FlateDecode" if compressed else b"")), d)
    pack = zlib.compress if compressed else bytes
    content, form = stream(pack(CONTENT)), stream(pack(art), b"/Type /XObject /Subtype /Form /BBox [0 0 1 1]")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /XObject << /Fm 5 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R >>",
        content[0] + content[1] + b"\nendstream",
        form[0] + form[1] + b"\nendstream",
    ]
    out, places = b"%PDF-1.5\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 6\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (7 if broken else at)


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("broken", [False, True])
def test_graphics_and_rules(compressed, broken):
    pdf = P.Pdf(made(compressed, broken))
    (page,) = pdf.pages()
    scan = P.PageScan(pdf, page)
    assert [(k, b) for k, b, _ in scan.graphics] == [("form", (100, 500, 300, 650)), ("image", (0, 0, 1, 1))]
    assert scan.rules == [(50, 400, 350, 400.5)]


def test_fingerprints_tell_drawings_apart():
    prints = [P.PageScan(p, p.pages()[0]).graphics[0][2] for p in (P.Pdf(made()), P.Pdf(made(broken=True)), P.Pdf(made(art=b"0 0 m 2 2 l S")))]
    assert prints[0] == prints[1] != prints[2]


def test_values():
    read = lambda raw: P.Reader(raw).value()
    assert read(b"<< /A#42 [1 -2.5 (a\\)(b)) <41> 3 0 R true] % x\n /C null >>") == {"AB": [1, -2.5, "", "", (3, 0), True], "C": None}
    assert P.unpredicted(bytes([2, 1, 2, 2, 1, 1]), 2) == bytes([1, 2, 2, 3])
    whole = zlib.compress(b"some text " * 50)
    assert P.inflate(whole) == b"some text " * 50 and P.inflate(whole[:-6]).startswith(b"some")
    with pytest.raises(P.PdfError):
        P.inflate(b"\x00\x01\x02")


def test_tables(spark, tmp_path):
    rows = [("a", made()), ("b", b"no pdf"), ("c", None)]
    got = P.page_graphics(spark.createDataFrame(rows, "doc_id string, content binary")).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [("a", "form"), ("a", "image"), ("a", "page"), ("a", "rule"), ("b", "error"), ("c", "error")]


def test_files_by_content(spark, tmp_path):
    from collatrix.sources.tables import document_files, reviews

    for name, data in (("x.pdf", made()), ("copy.pdf", made()), ("y.pdf", made(True)), ("n.txt", b"L12: hm")):
        (tmp_path / name).write_bytes(data)
    files = document_files(spark, str(tmp_path))
    assert files.count() == 2 and document_files(spark, str(tmp_path), files.limit(1)).count() == 1
    assert [r.text for r in reviews(spark, str(tmp_path)).collect()] == ["L12: hm"]
