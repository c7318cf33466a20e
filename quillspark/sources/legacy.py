"""Readers of binary office files: Word, Excel, PowerPoint and Outlook, by their public specifications (MS-DOC, MS-XLS, MS-PPT, MS-OXMSG)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from quillspark.functions.text import clean_text
from quillspark.sources.ole import CompoundFile

# --- Word: pieces of text in the main stream, listed in a table stream

_FIELD_CODE = re.compile("\x13[^\x13\x14\x15]*(?:\x14|(?=\x15))")  # a field's instruction; its result stays


def doc_text(data: bytes) -> str:
    """The text of the main document, paragraphs ended by newlines, cells by tabs."""
    file = CompoundFile(data)
    main = file.read("WordDocument")
    magic, flags = struct.unpack_from("<H8xH", main, 0)
    if magic != 0xA5EC:
        raise ValueError("not a Word document")
    if flags & 0x0100:
        raise PermissionError("encrypted")
    length = struct.unpack_from("<I", main, 0x4C)[0]
    place, size = struct.unpack_from("<II", main, 0x01A2)
    table = file.read("1Table" if flags & 0x0200 else "0Table")[place : place + size]
    while table[:1] == b"\x01":  # property modifiers before the piece table
        table = table[3 + struct.unpack_from("<H", table, 1)[0] :]
    if table[:1] != b"\x02":
        raise ValueError("no piece table")
    plc = table[5 : 5 + struct.unpack_from("<I", table, 1)[0]]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    parts = []
    for i in range(n):
        at = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
        count = ends[i + 1] - ends[i]
        if at & 0x40000000:
            at = (at & 0x3FFFFFFF) // 2
            parts.append(main[at : at + count].decode("cp1252", "replace"))
        else:
            parts.append(main[at : at + 2 * count].decode("utf-16-le", "replace"))
    text = "".join(parts)[:length]
    while True:
        shorter = _FIELD_CODE.sub("", text)
        if shorter == text:
            break
        text = shorter
    return text.replace("\x07", "\t").translate({0x0D: "\n", 0x0B: "\n", 0x0C: "\n", 0x15: None, 0x14: None, 0x13: None, 1: None, 8: None, 5: None})


def read_doc(data: bytes, out) -> None:
    for par in doc_text(data).split("\n"):
        cells = [c.strip() for c in par.split("\t")]
        if "\t" in par and sum(map(bool, cells)) > 1:
            out.add(clean_text(" | ".join(filter(None, cells))), "table_row")
        else:
            out.add(clean_text(par))


# --- Excel: records of type, length and body

# Fixed values of the format: record types, and built-in number formats that are dates.
_BOUNDSHEET, _SST, _CONTINUE, _LABELSST, _NUMBER, _RK, _MULRK, _LABEL, _FORMULA, _STRING, _BOOLERR = 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x207, 0x205
_XF, _FORMAT, _DATEMODE, _FILEPASS, _BOF, _EOF, _CODEPAGE = 0xE0, 0x41E, 0x22, 0x2F, 0x809, 0x0A, 0x42
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Strings:
    """Strings that run over the borders of records; at a border inside characters their width is told anew."""

    def __init__(self, bodies: list[bytes]):
        self.bodies, self.part, self.at = bodies, 0, 0

    def _left(self) -> int:
        while self.at >= len(self.bodies[self.part]) and self.part + 1 < len(self.bodies):
            self.part, self.at = self.part + 1, 0
        return len(self.bodies[self.part]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while n and (left := self._left()):
            piece = self.bodies[self.part][self.at : self.at + min(n, left)]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
        return out

    def text(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count:
            before = self.part
            left = self._left()
            if self.part != before:
                wide = self.take(1)[0] & 1
                left -= 1
            n = min(count, left // (2 if wide else 1))
            if not n:
                break
            out += self.take(2 * n).decode("utf-16-le", "replace") if wide else self.take(n).decode("latin-1")
            count -= n
        self.take(4 * runs + extra)
        return out


def _short_text(body: bytes, size: int) -> str:
    """A string in one record whose count takes ``size`` bytes."""
    count = int.from_bytes(body[:size], "little")
    body, wide = body[size + 1 :], body[size] & 1
    return body[: 2 * count].decode("utf-16-le", "replace") if wide else body[:count].decode("latin-1")


def _rk(value: int) -> float:
    number = float((value >> 2) - ((value >> 2 & 0x20000000) << 1)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def xls_sheets(data: bytes) -> list[tuple[str, dict[int, dict[int, object]]]]:
    """Sheets with their cells by row and column: numbers, texts, truth values, datetimes."""
    file = CompoundFile(data)
    stream = file.read("Workbook" if file.has("Workbook") else "Book")
    sheets, formats, styles, base, found = [], {}, [], datetime(1899, 12, 30), []
    shared: list[bytes] = []
    into_shared = False
    for kind, body in _records(stream):
        if kind == _FILEPASS:
            raise PermissionError("encrypted")
        if kind == _SST or (kind == _CONTINUE and into_shared):
            shared.append(body)
            into_shared = True
            continue
        into_shared = False
        if kind == _BOUNDSHEET:
            sheets.append((struct.unpack_from("<I", body)[0], _short_text(body[6:], 1)))
        elif kind == _FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = _short_text(body[2:], 2)
        elif kind == _XF:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == _DATEMODE and body[:1] == b"\x01":
            base = datetime(1904, 1, 1)
        elif kind == _EOF:
            break
    if shared:
        unique = struct.unpack_from("<I", shared[0], 4)[0]
        strings = _Strings([shared[0][8:], *shared[1:]])
        shared_texts = [strings.text() for _ in range(unique)]
    else:
        shared_texts = []

    def shown(number: float, style: int) -> object:
        code = styles[style] if style < len(styles) else 0
        custom = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(code, ""))
        if (code in _DATE_FORMATS or re.search("[ymdhs]", custom, re.IGNORECASE)) and 0 <= number < 2_958_466:
            return base + timedelta(days=number)
        return number

    for at, name in sheets:
        cells: dict[int, dict[int, object]] = {}
        waiting = None
        depth = 0
        for kind, body in _records(stream, at):
            if kind == _BOF:
                depth += 1
            elif kind == _EOF:
                depth -= 1
                if not depth:
                    break
            elif kind == _STRING and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _short_text(body, 2)
            elif kind in (_LABELSST, _NUMBER, _RK, _LABEL, _FORMULA, _BOOLERR):
                row, column, style = struct.unpack_from("<HHH", body)
                value: object = None
                if kind == _LABELSST:
                    value = shared_texts[struct.unpack_from("<I", body, 6)[0]]
                elif kind == _NUMBER:
                    value = shown(struct.unpack_from("<d", body, 6)[0], style)
                elif kind == _RK:
                    value = shown(_rk(struct.unpack_from("<I", body, 6)[0]), style)
                elif kind == _LABEL:
                    value = _short_text(body[6:], 2)
                elif kind == _BOOLERR:
                    value = None if body[7] else bool(body[6])  # errors have no content
                elif body[12:14] != b"\xff\xff":
                    value = shown(struct.unpack_from("<d", body, 6)[0], style)
                elif body[6] == 1:
                    value = bool(body[8])
                waiting = (row, column) if kind == _FORMULA and body[12:14] == b"\xff\xff" and body[6] == 0 else None
                if value is not None:
                    cells.setdefault(row, {})[column] = value
            elif kind == _MULRK:
                row, first = struct.unpack_from("<HH", body)
                for i in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * i)
                    cells.setdefault(row, {})[first + i] = shown(_rk(value), style)
        found.append((name, cells))
    return found


# --- PowerPoint: nested records

_SLIDE_LIST, _SLIDE_PLACE, _SLIDE, _NOTES, _CHARS, _BYTES = 0x0FF0, 0x03F3, 0x03EE, 0x03F0, 0x0FA0, 0x0FA8


def _tree(data: bytes, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int, int, bytes]]:
    """(types above, instance, type, body) of all records, containers before what they hold."""
    at = 0
    while at + 8 <= len(data):
        version, kind, size = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + size]
        yield path, version >> 4, kind, body
        if version & 15 == 15 and len(path) < 32:
            yield from _tree(body, (*path, kind))
        at += 8 + size


def ppt_slides(data: bytes) -> list[list[str]]:
    """Texts of each slide: those of the outline, then those of its shapes."""
    file = CompoundFile(data)
    slides: list[list[str]] = []
    shapes: list[list[str]] = []
    outline = False
    for path, instance, kind, body in _tree(file.read("PowerPoint Document")):
        if kind == _SLIDE_LIST:
            outline = instance == 0
        elif kind == _SLIDE_PLACE and outline and path[-1:] == (_SLIDE_LIST,):
            slides.append([])
        elif kind == _SLIDE:
            shapes.append([])
        elif kind in (_CHARS, _BYTES):
            text = body.decode("utf-16-le" if kind == _CHARS else "latin-1", "replace").replace("\r", "\n").replace("\x0b", "\n")
            if path[-1:] == (_SLIDE_LIST,) and outline and slides:
                slides[-1].append(text)
            elif _SLIDE in path and shapes:
                shapes[-1].append(text)
    n = max(len(slides), len(shapes))
    slides += [[]] * (n - len(slides))
    shapes += [[]] * (n - len(shapes))
    return [list(dict.fromkeys([*a, *b])) for a, b in zip(slides, shapes, strict=True)]


def read_ppt(data: bytes, out) -> None:
    for page, texts in enumerate(ppt_slides(data), 1):
        for t in texts:
            out.add(clean_text(t), page=page)


# --- Outlook: a stream for each property

# Fixed values of the format: numbers of properties.
_SUBJECT, _SENDER, _ADDRESS, _TO, _CC, _BODY, _RTF, _HTML, _SENT = "0037", "0C1A", "0C1F", "0E04", "0E03", "1000", "1009", "1013", 0x0039
_DATA, _LONG_NAME, _NAME = "3701", "3707", "3704"
#: Fixed value of the format: what the dictionary of compressed RTF starts with.
_RTF_START = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArial"
    b"Times New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)


def unpacked_rtf(data: bytes) -> bytes:
    """Compressed RTF: literal bytes and references into the last 4096."""
    size, length, kind = struct.unpack_from("<II4s", data)
    body = data[16 : size + 4]
    if kind == b"MELA":
        return body[:length]
    window, at, out = bytearray(_RTF_START.ljust(4096, b"\x00")), len(_RTF_START), bytearray()
    i = 0
    while i < len(body) and len(out) < length:
        flags = body[i]
        i += 1
        for bit in range(8):
            if i >= len(body):
                break
            if flags >> bit & 1:
                if i + 2 > len(body):
                    break
                word = body[i] << 8 | body[i + 1]
                i += 2
                start, n = word >> 4, (word & 15) + 2
                if start == at % 4096:
                    return bytes(out[:length])
                for k in range(n):
                    c = window[(start + k) % 4096]
                    out.append(c)
                    window[at % 4096] = c
                    at += 1
            else:
                out.append(body[i])
                window[at % 4096] = body[i]
                i, at = i + 1, at + 1
    return bytes(out[:length])


def _property(file: CompoundFile, below: str, number: str) -> str | bytes | None:
    for kind, read in (("001F", lambda b: b.decode("utf-16-le", "replace")), ("001E", lambda b: b.decode("cp1250", "replace")), ("0102", bytes)):
        path = f"{below}__substg1.0_{number}{kind}"
        if file.has(path):
            return read(file.read(path))
    return None


def _sent(file: CompoundFile, below: str) -> datetime | None:
    path = below + "__properties_version1.0"
    if not file.has(path):
        return None
    body = file.read(path)
    for at in range(24 if below else 32, len(body) - 15, 16):
        kind, number = struct.unpack_from("<HH", body, at)
        if (number, kind) == (_SENT, 0x0040):
            ticks = struct.unpack_from("<Q", body, at + 8)[0]
            return datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)
    return None


def read_msg(data: bytes, out, rtf=None, page=None) -> None:
    """Header block, body (plain, else HTML, else RTF), attachments; attached messages are listed as sections of their own."""
    file = CompoundFile(data)
    _message(file, "", out, rtf, page)


def _message(file: CompoundFile, below: str, out, rtf, page, depth: int = 0) -> None:
    get = lambda n: _property(file, below, n)
    sender = " ".join(filter(None, (get(_SENDER), f"<{a}>" if (a := get(_ADDRESS)) else None)))
    sent = _sent(file, below)
    rows = {"Od": sender, "Do": get(_TO), "DW": get(_CC), "Data": sent and sent.isoformat(), "Temat": get(_SUBJECT)}
    out.add("\n".join(f"{k}: {v}" for k, v in rows.items() if v), "email_header")
    if not depth:
        out.meta |= {k: str(v) for k, v in (("title", rows["Temat"]), ("author", sender)) if v}
    body = get(_BODY)
    if not body and (html := get(_HTML)) is not None and page:
        body = page(html if isinstance(html, str) else html.decode("utf-8", "replace"))
    if not body and isinstance(packed := get(_RTF), bytes) and rtf:
        rtf(unpacked_rtf(packed), out)
    for par in re.split(r"\n[ \t]*\n", (body or "").replace("\r\n", "\n")) if isinstance(body, str) else ():
        out.add(clean_text(par))
    for storage in file.storages(below):
        if not storage[len(below) :].startswith("__attach_version1.0_"):
            continue
        name = _property(file, storage + "/", _LONG_NAME) or _property(file, storage + "/", _NAME)
        out.add(f"Załącznik: {name or 'attachment'}", "attachment_note")
        inner = f"{storage}/__substg1.0_{_DATA}000D"
        if inner in file.paths and depth < 3:
            _message(file, inner + "/", out, rtf, page, depth + 1)
        elif isinstance(content := _property(file, storage + "/", _DATA), bytes):
            out.attachments.append((str(name or "attachment"), content))
