"""Plain PDF: text out of simple files, and reports as pages of lines."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(T\*|Td|TD|ET)", re.S)
_PART = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return out.decode("cp1252", "replace")


def extract_text(data: bytes) -> str:
    """Text shown by literal strings in plain or deflated streams; empty for anything else, such as scanned pages."""
    lines: list[str] = []
    for head, body in _STREAM.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        line = ""
        for one, many, move in _SHOWN.findall(body):
            if move:
                if line:
                    lines.append(line)
                line = ""
            else:
                line += _plain(one) if one else "".join(map(_plain, _PART.findall(many)))
        if line:
            lines.append(line)
    return "\n".join(lines)


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """``extract_text`` of binary values."""
    return content.map(lambda b: None if b is None else extract_text(bytes(b)))


def pages(lines: list[str], per_page: int = 60) -> bytes:
    """A PDF of lines in one font."""
    escape = lambda s: s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    parts = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for part in parts:
        body = b"BT /F1 10 Tf 12 TL 50 790 Td\n" + b"".join(b"(" + escape(s) + b") Tj T*\n" for s in part) + b"ET"
        objects.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))
