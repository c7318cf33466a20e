"""File types by signature, container contents, extension and text heuristics; text encodings."""

from __future__ import annotations

import codecs
import io
import unicodedata
import zipfile
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import functions as F

from quillspark.sources.ole import CompoundFile

_OPEN = "application/vnd.openxmlformats-officedocument."
_MS = "application/vnd.ms-"
# Types and their extensions.
_TYPES = {
    "application/pdf": ".pdf", _OPEN + "wordprocessingml.document": ".docx", _MS + "word.document.macroEnabled.12": ".docm", "application/msword": ".doc .dot",
    "application/rtf": ".rtf", "application/vnd.oasis.opendocument.text": ".odt", "application/vnd.oasis.opendocument.spreadsheet": ".ods",
    _OPEN + "spreadsheetml.sheet": ".xlsx", _MS + "excel.sheet.macroEnabled.12": ".xlsm", _MS + "excel": ".xls .xlt",
    _OPEN + "presentationml.presentation": ".pptx", _MS + "powerpoint.presentation.macroEnabled.12": ".pptm", _OPEN + "presentationml.slideshow": ".ppsx",
    _MS + "powerpoint.slideshow.macroEnabled.12": ".ppsm", _MS + "powerpoint": ".ppt .pps .pot",
    "text/plain": ".txt .log .ini .cfg", "text/markdown": ".md", "text/yaml": ".yaml .yml", "text/csv": ".csv", "text/tab-separated-values": ".tsv",
    "application/json": ".json", "application/xml": ".xml", "text/html": ".html .htm", "application/xhtml+xml": ".xhtml",
    "message/rfc822": ".eml .mht .mhtml", _MS + "outlook": ".msg", "application/zip": ".zip", "application/x-7z-compressed": ".7z", "application/vnd.rar": ".rar",
    "image/png": ".png", "image/jpeg": ".jpg .jpeg", "image/tiff": ".tif .tiff", "image/bmp": ".bmp", "image/gif": ".gif", "image/webp": ".webp",
}
EXTENSION_TYPES = {e: t for t, extensions in _TYPES.items() for e in extensions.split()}
# What files begin with, and members and streams of containers that name a format.
SIGNATURES = [
    (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
    (b"{\\rtf", "application/rtf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"),
    (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"), (b"\x1f\x8b", "application/gzip"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"Rar!\x1a\x07", "application/vnd.rar"),
]
OFFICE_MEMBERS = {"word/document.xml": ".docx", "xl/workbook.xml": ".xlsx", "ppt/presentation.xml": ".pptx", "content.xml": ".odt"}
OLE_STREAMS = {"WordDocument": ".doc", "Workbook": ".xls", "Book": ".xls", "PowerPoint Document": ".ppt", "__properties_version1.0": ".msg"}
# Byte order marks, longer ones first, and encodings that are tried.
BOMS = [
    (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"),
]
FALLBACKS = ("utf-8", "cp1250", "iso-8859-2", "cp1252", "utf-16", "utf-16-le", "utf-16-be", "latin-1")
# How well characters suit an office text, the first group that has one; scripts that don't are (first, last) code points.
POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
WEIGHTS = {"polish": 3.0, "blank": 0.2, "odd": -3.0, "foreign": -6.0, "letter or digit": 1.0, "broken": -8.0, "other": -0.2}
CHARACTERS = {"polish": POLISH, "blank": " \t\n\r\f\v", "odd": "¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿×÷"}
FOREIGN = [(0x0590, 0x08FF), (0x0E00, 0x0FFF), (0x1100, 0x11FF), (0x2E80, 0xA4CF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF)]
BROKEN = ("Cc", "Cf", "Co", "Cs", "Cn")
SCORED, GUESSED = 20_000, 256 * 1024  # characters of a text that are scored, bytes of a file that are guessed from


def looks_like_text(head: bytes) -> bool:
    """No zero byte, and nine of ten bytes printable."""
    good = sum(b >= 0x80 or 32 <= b < 127 or b in b"\t\n\r\f\b\x1b" for b in head)
    return b"\x00" not in head and good > 0.9 * len(head)


def file_type(content: bytes | None, name: str, declared: str | None = None) -> tuple[str, bool]:
    """The type, and whether the file is encrypted."""
    content = content or b""
    extension = "." + name.rpartition(".")[2].lower() if "." in name else ""
    found = next((t for s, t in SIGNATURES if content.startswith(s)), None)
    if found == "application/zip":
        try:
            members = zipfile.ZipFile(io.BytesIO(content)).infolist()
        except (zipfile.BadZipFile, OSError, ValueError):
            return found, False
        office = next((e for m in members if (e := OFFICE_MEMBERS.get(m.filename))), None)
        return EXTENSION_TYPES[office or ".zip"], any(m.flag_bits & 1 for m in members)
    if found == "application/x-ole-storage":
        try:
            streams = CompoundFile(content).paths
        except (ValueError, IndexError, ArithmeticError, OSError):
            return EXTENSION_TYPES.get(extension, found), False
        office = next((e for n, e in OLE_STREAMS.items() if n in streams), None)
        sealed = "EncryptedPackage" in streams or "EncryptionInfo" in streams
        return EXTENSION_TYPES[office] if office else EXTENSION_TYPES.get(extension, found), sealed
    if found:
        return found, False
    if extension in EXTENSION_TYPES:
        return EXTENSION_TYPES[extension], False
    if declared:
        return declared, False
    return ("text/plain" if content and looks_like_text(content[:4096]) else "application/octet-stream"), False


@cache
def _weights() -> dict[str, float]:
    """Of single characters that have a weight of their own."""
    return {c: WEIGHTS[kind] for kind in reversed(CHARACTERS) for c in CHARACTERS[kind]}


def _weight(c: str) -> float:
    if (known := _weights().get(c)) is not None:
        return known
    if any(first <= ord(c) <= last for first, last in FOREIGN):
        return WEIGHTS["foreign"]
    if c.isalnum():
        return WEIGHTS["letter or digit"]
    return WEIGHTS["broken" if unicodedata.category(c) in BROKEN else "other"]


def text_score(text: str) -> float:
    """The mean weight of the first SCORED characters, each distinct one weighed once."""
    seen = Counter(text[:SCORED])
    return sum(n * _weight(c) for c, n in seen.items()) / seen.total() if seen else 0.0


def mark(data: bytes) -> tuple[bytes, str] | None:
    """The byte order mark that data begin with, and its encoding."""
    return next(((m, name) for m, name in BOMS if data.startswith(m)), None)


def guess(data: bytes) -> str | None:
    """An encoding from the bytes' statistics: where zeros stand, else the code page whose reading scores best."""
    head = data[:GUESSED]
    if len(head) >= 4 and (zeros := [head[i::2].count(0) / max(1, len(head[i::2])) for i in (0, 1)]) and max(zeros) > 0.3 > 3 * min(zeros):
        return "utf-16-be" if zeros[0] > zeros[1] else "utf-16-le"
    scored = [(text_score(head.decode(name, "replace")), -i, name) for i, name in enumerate(("utf-8", "cp1250", "iso-8859-2", "cp1252", "cp852", "cp1251"))]
    best = max(scored, default=None)
    return best[2] if best and head and best[0] > 0 else None


def candidates(data: bytes, declared: str | None = None) -> list[str]:
    """Encodings to try, in order, each once."""
    return list(dict.fromkeys(n.strip().lower().replace("_", "-") for n in (declared, guess(data), *FALLBACKS) if n))


def _read(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except (LookupError, UnicodeError):
        return None


def decode(data: bytes, declared: str | None = None) -> tuple[str, str]:
    """Text and encoding: byte order mark, declared if plausible, strict UTF-8, else the best reading of the candidates."""
    if marked := mark(data):
        return data[len(marked[0]) :].decode(marked[1].removesuffix("-sig"), "replace"), marked[1]
    if declared and (text := _read(data, declared)) is not None and text_score(text) >= 0:
        return text, declared
    if b"\x00" not in data and (text := _read(data, "utf-8")) is not None:
        return text, "utf-8"
    read = [(text_score(text), -i, text, name) for i, name in enumerate(candidates(data, declared)) if (text := _read(data, name)) is not None]
    if not read:
        return data.decode("utf-8", "replace"), "utf-8"
    *_, text, name = max(read)
    return text, name


def file_type_udf():
    @F.pandas_udf("struct<mime_type:string,encrypted:boolean>")
    def run(content: pd.Series, name: pd.Series) -> pd.DataFrame:
        found = [file_type(c, n or "") for c, n in zip(content, name, strict=True)]
        return pd.DataFrame(found, columns=["mime_type", "encrypted"])

    return run
