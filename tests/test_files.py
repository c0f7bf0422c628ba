"""Texts of files: PDF as other programs write it, rich text, and what is damaged."""

import random
import zlib

import pytest

from marginalia.sources import files, pdf

CONTENT = rb"""BT /F1 12 Tf 72 720 Td (Hello \(nested (one)\) \351t\351) Tj 0 -14 Td [(Wi) 20 (de) -300 (gap)] TJ
1 0 0 1 72 600 Tm (Placed) Tj 1 0 0 1 200 600 Tm (beside) Tj T* (next \
line) Tj ET q /Fm1 Do Q BI /W 1 /H 1 ID xyz(Tj EI BT /F1 12 Tf 0 0 Td <48 65 7> Tj ET"""


def classic(content=CONTENT, compress=True, encrypt=b"", before=b""):
    """A file as many programs write them: plain fonts, page attributes from above, a form, more than one content stream."""
    body = zlib.compress(content) if compress else content
    form = b"BT /F1 9 Tf 1 1 Td (in a form) Tj ET"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Count 1/Kids[3 0 R]/Resources<</Font<</F1 5 0 R>>/XObject<</Fm1 6 0 R>>>>>>",
        b"<</Type/Page/Parent 2 0 R/Contents[4 0 R]>>",
        b"<</Length %d%s>>\nstream\r\n%s\nendstream" % (len(body), b"/Filter[/FlateDecode]" if compress else b"", body),
        b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/eacute/uni4F60]>>>>",
        b"<</Type/XObject/Subtype/Form/Length %d>>\nstream\n%s\nendstream" % (len(form), form),
    ]
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\n" + before), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 7\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer<</Size 7/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (encrypt, start)
    return bytes(out)


WANT = ["Hello (nested (one)) été", "Wide gap", "Placed beside", "next line", "in a form", "Hep"]


@pytest.mark.parametrize("compress", [True, False])
def test_a_plain_file(compress):
    assert pdf.text(classic(compress=compress)).split("\n") == WANT
    assert pdf.text(classic().replace(b"startxref\n", b"startxref\n99")).split("\n") == WANT  # found one by one
    assert pdf.text(classic(b"BT /F1 1 Tf (a\\001\\002) Tj ET")) == "aé你"


def test_round_trips():
    r = random.Random(1)
    letters = "ab \n\t()<>\\éßñ你好😀\r\x0b%/[]"
    for i in range(60):
        t = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 20, 3000])))
        assert pdf.text(pdf.made(t, streams=bool(i % 2), lines_a_page=r.choice([1, 7, 60]))) == t
    t = "\n".join(f"row {i} of a long text" for i in range(20_000))
    assert pdf.text(pdf.made(t)) == t


def test_predicted_rows():
    rows, kinds = [bytes([i, 2 * i, 7, 255 - i]) for i in range(5)], [0, 1, 2, 3, 4]
    raw, before = b"", bytes(4)
    for row, kind in zip(rows, kinds, strict=True):
        made = []
        for i, x in enumerate(row):
            left, up, corner = row[i - 1] if i else 0, before[i], before[i - 1] if i else 0
            paeth = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            made.append((x - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        raw, before = raw + bytes([kind, *made]), row
    assert pdf.unpredicted(raw, {"Predictor": 12, "Columns": 4}) == b"".join(rows)


def test_damaged_files():
    with pytest.raises(pdf.Damaged, match="locked"):
        pdf.text(classic(encrypt=b"/Encrypt 9 0 R"))
    for bad in (b"", b"no pdf", b"%PDF-1.4\nnothing here", b"%PDF-1.4\n1 0 obj<</Type/Catalog>>endobj"):
        try:
            assert pdf.text(bad) == ""
        except pdf.Damaged as e:
            assert str(e) == "damaged"
    circle = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[2 0 R 3 0 R]>>endobj\n3 0 obj 3 0 R endobj"
    assert pdf.text(circle) == ""
    r, whole = random.Random(2), classic()
    for data in (whole, pdf.made("some text\nof two lines", streams=True)):
        for _ in range(300):  # anything may be cut or changed: a text, or said to be damaged
            b = bytearray(data)
            for _ in range(r.randint(1, 12)):
                b[r.randrange(len(b))] = r.randrange(256)
            try:
                pdf.text(bytes(b[: r.choice([len(b), r.randrange(len(b))])]))
            except pdf.Damaged:
                pass


def test_rich_text():
    source = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Times;}}{\*\generator x;}{\info{\title no}}\pard caf\'E9 \'e9t\'e9\par second\tab \b bold\b0 line {\i in} a group\line %s x\~y \{z\}}" % (b"\\u8364? \\uc0\\u-10179\\u-8704")
    assert files.text_of("a.rtf", source) == ("café été\nsecond boldline in a group\n€ \U0001f600x y {z}".replace("\U0001f600", "😀"), "rtf")
    assert files.text_of("b.rtf", b"{\\rtf1 \\ansicpg9999 plain")[0] == "plain"
    assert files.text_of("c.rtf", b"}}}\\'zz{{")[1] == "rtf"


def test_kinds(spark, tmp_path):
    for name, data in {"a.pdf": classic(), "b.pdf": b"junk", "c.pdf": classic(encrypt=b"/Encrypt 9 0 R"), "d.doc": b"\xd0\xcf\x11\xe0", "e.txt": b"plain", "f.docx": b"no zip"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["how"]) for r in files.attachments(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("\n".join(WANT), "pdf"), "b.pdf": (None, "damaged"), "c.pdf": (None, "locked"), "d.doc": (None, "unknown"), "e.txt": ("plain", "text"), "f.docx": (None, "damaged")}


def test_small_files_share_tasks(spark, tmp_path):
    """Thirty files to a task was what Spark gives; names with folders, and a maker for each kind."""
    from marginalia.sources import files, pdf

    rows = spark.range(1500).selectExpr("id", "concat(id % 5, '/', id, if(id % 2 = 0, '.txt', '.pdf')) as name", "concat('text (', id, ')\\nñ') as text", "id % 2 as k")
    assert files.write_files(rows, "name", "text", str(tmp_path), {0: str.encode, 1: pdf.made}, "k") == 1500
    found = files.attachments(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = {int(r["path"].rsplit("/", 1)[1].split(".")[0]): (r["text"], r["how"]) for r in found.collect()}
    assert got == {i: (f"text ({i})\nñ", "pdf" if i % 2 else "text") for i in range(1500)}
