import zlib

import numpy as np
import pytest

from inquest.errors import CompileError, RefusalError
from inquest.functions import documents as d
from inquest.plans.session import AiSession


def pdf(*pages, flate=True, image=None):
    """A small PDF with a text stream on each page."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)}
    for i, text in enumerate(pages):
        data = zlib.compress(text) if flate else text
        extra = b"/Resources << /XObject << /I 90 0 R >> >>" if image is not None else b""
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (11 + 2 * i, extra)
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" if flate else b"") + data + b"\nendstream"
    if image is not None:
        h, w, _ = image.shape
        raw = zlib.compress(image.tobytes())
        objects[90] = b"<< /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode >>\nstream\n" % (w, h) + raw + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"%%EOF"


@pytest.mark.parametrize("flate", [True, False])
def test_text_of_a_pdf(flate):
    raw = pdf(b"BT /F1 12 Tf 10 10 Td (Hello \\(big\\) ) Tj [(wor) -20 (ld) -300 (again)] TJ 0 -14 Td (caf\\351) Tj ET", b"BT <48692E> Tj ET", flate=flate)
    assert d.parse_document(raw) == "Hello (big) world again\ncafé\fHi."
    assert d.parse_document(None) is None and d.parse_document(b"no pdf") is None and d.parse_document(b"%PDF-1.4 broken") in (None, "")


def test_pages():
    picture = (np.arange(64 * 96 * 3) % 251).astype(np.uint8).reshape(64, 96, 3)
    raw = pdf(b"BT (a) Tj ET", b"BT (b) Tj ET", b"BT (c) Tj ET", image=picture)
    got = d.pdf_pages(raw, 32, 2, 3)
    assert [p["page"] for p in got] == [2, 3] and max(d.read_png(got[0]["image"]).shape[:2]) == 32
    assert d.pdf_pages(pdf(b"BT (a) Tj ET"), 32)[0]["image"] is None and d.pdf_pages(b"x") is None


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_images_shrink_only(channels):
    image = np.random.default_rng(1).integers(0, 256, (20, 40, channels), dtype=np.uint8)
    raw = d.write_png(image)
    assert (d.read_png(raw) == image).all() and d.shrink(raw, 40) == raw
    assert d.read_png(d.shrink(raw, 10)).shape == (5, 10, channels)
    flat = d.write_png(np.full((30, 30, channels), 77, np.uint8))
    assert (d.read_png(d.shrink(flat, 7)) == 77).all()


def test_png_filters_and_other_formats():
    image = np.random.default_rng(2).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    rows, before = [], np.zeros(15, int)
    for y in range(6):  # one row for each kind of filter
        kind, line = y % 5, image[y].reshape(-1).astype(int)
        left = np.concatenate([[0, 0, 0], line[:-3]])
        corner = np.concatenate([[0, 0, 0], before[:-3]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [np.zeros(15, int), left, before, (left + before) // 2, paeth][kind]
        rows.append(bytes([kind]) + bytes(((line - guess) % 256).tolist()))
        before = line
    plain = d.write_png(image)
    start, end = plain.index(b"IDAT") - 4, plain.index(b"IEND") - 4
    data = zlib.compress(b"".join(rows))
    raw = plain[:start] + len(data).to_bytes(4, "big") + b"IDAT" + data + zlib.crc32(b"IDAT" + data).to_bytes(4, "big") + plain[end:]
    assert (d.read_png(raw) == image).all()
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x40\x00\x20\x03" + b"\0" * 20
    assert d.shrink(jpeg, 64) == jpeg and d.shrink(b"text", 9) is None and d.shrink(None, 9) is None
    with pytest.raises(RefusalError):
        d.shrink(jpeg, 32)


def test_in_sql(spark):
    with AiSession(spark) as s:
        s.register("f", {"id": [1, 2], "pdf": [pdf(b"BT (first) Tj ET", b"BT (second) Tj ET"), None]})
        assert [r["t"] for r in s.sql("SELECT AI.PARSE_DOCUMENT(pdf) AS t FROM f ORDER BY id").run().to_rows()] == ["first\fsecond", None]
        assert [r["p"] for r in s.sql("SELECT UNNEST(AI.PDF_PAGES(pdf, 64, 2))['page'] AS p FROM f").run().to_rows()] == [2]
        assert s.sql("SELECT AI.IMAGE(pdf, 64) AS i FROM f WHERE id = 1").run().to_rows() == [{"i": None}]
        assert len(s.sql("SELECT id FROM f WHERE AI.IF(PROMPT('{0}', AI.PARSE_DOCUMENT(pdf))) IS NOT NULL").run().to_rows()) == 1
        for text in ("AI.IMAGE(pdf, 0)", "AI.PDF_PAGES(pdf, 64, 3, 2)", "AI.PDF_PAGES(pdf, 'x')", "AI.PARSE_DOCUMENT(pdf, 1)"):
            with pytest.raises(CompileError):
                s.sql(f"SELECT {text} FROM f")
