"""PDF and image functions that need no model and no library beyond zlib and numpy.

PDF text comes from text operators in plain or Flate streams, with object streams; nothing is recognised from
pictures. Pages are returned with the picture that fills them (scans), as PNG, or as the JPEG it is; a page of
text has a null image, as there is no renderer here. PNG images are scaled; JPEG images that need scaling are
refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inquest.errors import CompileError, RefusalError

PAGES_TYPE = "array<struct<page: int, image: binary>>"
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TEXT = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[(?:[^\[\]\\()]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\]|[-+]?\d*\.?\d+|/[^\s/<>\[\]()]+|[A-Za-z'\"*]+", re.S)
_PART = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[-+]?\d*\.?\d+", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    """Objects of a file, by number."""

    def __init__(self, raw: bytes) -> None:
        if not raw.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        self.objects = {int(n): body for n, _, body in _OBJECT.findall(raw)}
        if b"/Encrypt" in raw:
            raise ValueError("encrypted")
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data = self.stream(body)
        n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
        heads = list(map(int, data[:first].split()[: 2 * n]))
        offsets = [*heads[1::2], len(data) - first]
        for number, a, b in zip(heads[::2], offsets, offsets[1:], strict=False):
            self.objects.setdefault(number, data[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return b""
        data = body[m.end() : body.rfind(b"endstream")]
        if b"/FlateDecode" in body[: m.start()]:
            data = zlib.decompressobj().decompress(data)
        return data

    def ref(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)]
        out: list[bytes] = []

        def walk(number: int, seen: frozenset) -> None:
            body = self.objects.get(number, b"")
            if number in seen or not body:
                return
            if re.search(rb"/Type\s*/Pages", body):
                for kid in self.ref(body, b"Kids"):
                    walk(kid, seen | {number})
            else:
                out.append(body)

        for root in roots:
            for top in self.ref(root, b"Pages"):
                walk(top, frozenset())
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def text(self, page: bytes) -> str:
        data = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.ref(page, b"Contents"))
        out: list[str] = []
        stack: list[bytes] = []
        for token in _TEXT.findall(data):
            if token[:1] in b"([<" or token[:1] == b"/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                stack.append(token)
                continue
            if token in (b"Tj", b"'", b'"') and stack:
                out += ["\n"] * (token != b"Tj") + [_string(stack[-1])]
            elif token == b"TJ" and stack:
                for part in _PART.findall(stack[-1]):
                    if part[:1] in b"(<":
                        out.append(_string(part))
                    elif float(part) < -200:
                        out.append(" ")
            elif token in (b"T*", b"TD", b"Tm") or token == b"Td" and len(stack) > 1 and float(stack[-1]) != 0:
                out.append("\n")
            elif token == b"Td":
                out.append(" ")
            stack = []
        return re.sub(r"\n{2,}", "\n", "".join(out)).strip()

    def image(self, page: bytes) -> bytes | None:
        """The largest picture of a page."""
        best, size = None, 0
        numbers = {int(n) for n in _REF.findall(page)}
        for n in list(numbers):
            numbers |= {int(k) for k in _REF.findall(self.objects.get(n, b"")[:4000])}
        for n in sorted(numbers):
            body = self.objects.get(n, b"")
            head = body.split(b"stream", 1)[0]
            if not re.search(rb"/Subtype\s*/Image", head):
                continue
            w, h = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"Width", b"Height"))
            if w * h <= size:
                continue
            if b"/DCTDecode" in head:
                m = re.search(rb"stream\r?\n", body)
                best, size = body[m.end() : body.rfind(b"endstream")].rstrip(b"\r\n"), w * h
            elif b"/DeviceRGB" in head or b"/DeviceGray" in head:
                channels = 3 if b"/DeviceRGB" in head else 1
                data = np.frombuffer(self.stream(body)[: w * h * channels], np.uint8)
                if len(data) == w * h * channels:
                    best, size = write_png(data.reshape(h, w, channels)), w * h
        return best


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][:1] in b"\r\n" else _NAMED.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("cp1252", "replace")


def parse_document(raw: bytes | None) -> str | None:
    """Text of a PDF, pages parted by a form feed; None if it can't be read."""
    try:
        pdf = Pdf(bytes(raw))
        return "\f".join(pdf.text(p) for p in pdf.pages())
    except Exception:  # whatever a broken file does, it has no text
        return None


def pdf_pages(raw: bytes | None, longest_edge: int = 1536, first: int = 1, last: int | None = None) -> list[dict] | None:
    """[{page, image}] of the pages first..last; None if the file can't be read."""
    try:
        pdf = Pdf(bytes(raw))
        pages = pdf.pages()
    except Exception:
        return None
    out = []
    for k, page in enumerate(pages[first - 1 : last], first):
        picture = pdf.image(page)
        out.append({"page": k, "image": shrink(picture, longest_edge) if picture and picture[:8] == PNG else picture})
    return out


PNG = b"\x89PNG\r\n\x1a\n"


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        yield raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        at += 12 + n


def read_png(raw: bytes) -> np.ndarray:
    """Height x width x channels of an 8-bit PNG that isn't interlaced."""
    parts: dict[bytes, bytes] = {}
    for name, data in _chunks(raw):
        parts[name] = parts.get(name, b"") + data
    w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlaced or color not in (0, 2, 3, 4, 6):
        raise ValueError("unsupported PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * channels, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = np.add.accumulate(line.reshape(w, channels), 0).reshape(-1) & 255
        else:
            now = np.zeros(w * channels, np.int64)
            for x in range(w * channels):
                a, b, c = (now[x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
                if kind == 3:
                    now[x] = (line[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    now[x] = (line[x] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
            out[y] = now
    image = out.reshape(h, w, channels)
    return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[image[:, :, 0]] if color == 3 else image


def write_png(image: np.ndarray) -> bytes:
    h, w, channels = image.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))
    rows = np.c_[np.zeros((h, 1), np.uint8), image.reshape(h, w * channels)].tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a bicubic reduction, n_out x n_in."""
    scale = n_in / n_out
    x = np.abs((np.arange(n_in)[None, :] + 0.5 - (np.arange(n_out)[:, None] + 0.5) * scale) / max(scale, 1))
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(1, keepdims=True)


def jpeg_size(raw: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(raw):
        marker, n = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
            return w, h
        at += 2 + n
    raise ValueError("no size")


def shrink(raw: bytes | None, longest_edge: int) -> bytes | None:
    """The image with its longer edge at most that long, in its own format; None if it is no PNG or JPEG."""
    if raw is None:
        return None
    raw = bytes(raw)
    try:
        if raw[:2] == b"\xff\xd8":
            if max(jpeg_size(raw)) > longest_edge:
                raise RefusalError(["JPEG images can't be scaled here"], constraint="image")
            return raw
        if raw[:8] != PNG:
            return None
        image = read_png(raw)
    except (ValueError, KeyError, struct.error, zlib.error):
        return None
    h, w, _ = image.shape
    if max(h, w) <= longest_edge:
        return raw
    size = max(1, round(h * longest_edge / max(h, w))), max(1, round(w * longest_edge / max(h, w)))
    scaled = np.einsum("yi,ijc,xj->yxc", _cubic(h, size[0]), image.astype(float), _cubic(w, size[1]), optimize=True)
    return write_png(np.clip(np.rint(scaled), 0, 255).astype(np.uint8))


def check_pages(edge: int, first: int, last: int | None) -> None:
    if edge % 32 or not 32 <= edge <= 8192:
        raise CompileError("the longest edge of a page is a multiple of 32 from 32 to 8192")
    if first < 1 or last is not None and last < first:
        raise CompileError("pages count from 1, and the last is not before the first")


def sql_call(spark: SparkSession) -> Callable[[str, list[str]], str]:
    """Register the functions once they are used; returns (name, arguments) -> SQL."""
    known: set[str] = set()

    def number(text: str) -> int:
        try:
            return int(text.replace(" ", ""))
        except ValueError:
            raise CompileError(f"expected a whole number, got {text}") from None

    def call(name: str, args: list[str]) -> str:
        if name == "parse_document":
            if len(args) != 1:
                raise CompileError("AI.PARSE_DOCUMENT takes one argument")
            fn, kind = (lambda d: d.map(parse_document, na_action="ignore").astype(object).where(lambda x: x.notna(), None)), "string"
            suffix, use = "", args
        elif name == "pdf_pages":
            if not 1 <= len(args) <= 4:
                raise CompileError("AI.PDF_PAGES takes one to four arguments")
            given = [number(a) for a in args[1:]]
            edge, first, last = [*given, *(1536, 1, None)[len(given) :]]
            check_pages(edge, first, last)
            fn, kind = (lambda d: pd.Series([None if x is None else pdf_pages(x, edge, first, last) for x in d], dtype=object)), PAGES_TYPE
            suffix, use = f"_{edge}_{first}_{last or 0}", args[:1]
        else:
            if len(args) != 2:
                raise CompileError("AI.IMAGE takes an image and its longest edge")
            edge = number(args[1])
            if not 1 <= edge <= 8192:
                raise CompileError("the longest edge of an image lies between 1 and 8192")
            fn, kind = (lambda d: pd.Series([shrink(x, edge) for x in d], dtype=object)), "binary"
            suffix, use = f"_{edge}", args[:1]
        registered = f"__inquest_{name}{suffix}"
        if registered not in known:
            spark.udf.register(registered, F.pandas_udf(_annotated(fn), kind))
            known.add(registered)
        return f"{registered}({', '.join(use)})"

    return call


def _annotated(fn: Callable) -> Callable:
    def run(documents: pd.Series) -> pd.Series:
        return fn(documents)

    return run
