"""Files to sections: text, CSV, HTML, e-mail, ZIP, PDF, RTF, images' headers, Word, Excel, PowerPoint and Outlook, old and new.

Each reader is a generator of sections from bytes; a table of readers by type
and extension, highest priority first, is tried until one succeeds. A file
that fails becomes a row with an error, never an exception.
"""

from __future__ import annotations

import contextlib
import csv
import html
import importlib
import importlib.util
import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.functions.text import Remembered, clean_text, fold_text
from quillspark.sources.detect import decode, file_type, looks_like_text
from quillspark.sources.images import read_image
from quillspark.sources.legacy import read_doc, read_msg, read_ppt, xls_sheets
from quillspark.sources.pdf import read_pdf

LONG_PARAGRAPH = 4000


class Enough(Exception):
    """A file gave as much as its limits let it."""


@dataclass(frozen=True)
class Limits:
    """How much is read of a file, and how long; what is left out is a warning. Nothing is bounded by default."""

    most_bytes: int | None = None
    chars: int | None = None
    rows: int | None = None
    seconds: float | None = None
    cancelled: Callable[[], bool] | None = None


@dataclass
class Extracted:
    sections: list[dict] = field(default_factory=list)
    attachments: list[tuple[str, bytes]] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)  # what was left out, and why
    limits: Limits = Limits()
    began: float = field(default_factory=time.monotonic)
    chars: int = 0
    rows: int = 0

    def add(self, text: str, kind: str = "paragraph", **more) -> None:
        text, own = text.strip(), self.limits
        if not text:
            return
        if own.cancelled and own.cancelled():
            raise InterruptedError("reading was cancelled")
        if own.seconds is not None and time.monotonic() - self.began > own.seconds:
            self._end(f"{own.seconds} seconds")
        if own.rows is not None and kind == "table_row" and self.rows >= own.rows:
            self._end(f"{own.rows} rows")
        if own.chars is not None and self.chars + len(text) > own.chars:
            text = text[: own.chars - self.chars].strip()
            if text:
                self.sections.append({"text": text, "kind": kind, **more})
            self._end(f"{own.chars} characters")
        self.chars += len(text)
        self.rows += kind == "table_row"
        self.sections.append({"text": text, "kind": kind, **more})

    def _end(self, what: str) -> None:
        self.warnings.append(f"read up to {what}")
        raise Enough


def _lines(text: str) -> Iterator[str]:
    """Paragraphs, long ones cut near LONG_PARAGRAPH at a line or word end."""
    for par in re.split(r"\n[ \t\f]*\n", text):
        while len(par) > LONG_PARAGRAPH:
            cut = max(par.rfind("\n", 0, LONG_PARAGRAPH), par.rfind(" ", 0, LONG_PARAGRAPH))
            cut = cut if cut > 0 else LONG_PARAGRAPH
            yield par[:cut]
            par = par[cut:].lstrip()
        yield par


def read_text(data: bytes, out: Extracted) -> None:
    for par in _lines(decode(data)[0].replace("\r\n", "\n")):
        out.add(clean_text(par))


# --- tables


def row_text(cells: list[str], header: list[str] | None) -> str:
    """``label: value`` of each filled cell; cells beyond the header stand bare."""
    labels = (header or [])[: len(cells)] + [""] * (len(cells) - len(header or []))
    return " | ".join(f"{name}: {c.strip()}" if name else c.strip() for name, c in zip(labels, cells, strict=True) if c.strip())


def is_number(cell: str) -> bool:
    text = cell.replace(" ", "").replace("\u00a0", "").replace(",", ".")
    try:
        float(text)
    except ValueError:
        return False
    return any(map(str.isdigit, text))


def delimiter(sample: str, default: str = ",") -> str:
    try:
        return csv.Sniffer().sniff(sample, ";,\t|").delimiter
    except csv.Error:
        counts = {d: sum(x.count(d) for x in sample.splitlines()[:20]) for d in ";,\t|"}
        return max(counts, key=counts.get) if any(counts.values()) else default


def read_csv(data: bytes, out: Extracted) -> None:
    text = decode(data)[0]
    rows = [(i, r) for i, r in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text[:16_384])), 1) if any(c.strip() for c in r)]
    if not rows:
        return
    (_, first), rest = rows[0], rows[1:]
    filled = [c for c in first if c.strip()]
    header = None
    if rest and len(first) == len(rest[0][1]) and not all(map(is_number, filled)):
        header, rows = [c.strip() for c in first], rest
        out.add(" | ".join(filled), "table_header")
    label = " | ".join(filter(None, header or [])) or None
    for i, cells in rows:
        out.add(row_text(cells, header), "table_row", row=i, heading=label)


# --- HTML

# Elements without text of their own, those that end a paragraph, and meta names that are kept.
SILENT = frozenset("script style head noscript template".split())
BREAKS = frozenset("p div br li tr table section".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
META = frozenset("author description keywords".split())


class _Page(HTMLParser):
    def __init__(self, out: Extracted):
        super().__init__(convert_charrefs=True)
        self.out, self.silent, self.text, self.title, self.heading = out, [], [], None, None

    def end(self, heading: bool = False) -> None:
        text = clean_text("".join(self.text))
        self.text = []
        if heading and text:
            self.heading = text
        self.out.add(text, heading=self.heading)

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        name = found.get("name", "").strip().lower()
        if tag == "meta" and name in META and (content := clean_text(found.get("content", ""))):
            self.out.meta.setdefault(name, content)
        elif tag == "title":
            self.title = []
        elif tag == "body":
            self.silent = []
        elif tag in SILENT:
            self.end()
            self.silent.append(tag)
        elif not self.silent and tag in BREAKS | HEADINGS:
            self.end()
        elif not self.silent and tag in ("td", "th"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            if text := clean_text("".join(self.title)):
                self.out.meta.setdefault("title", text)
            self.title = None
        elif tag in SILENT:
            if tag in self.silent:
                self.silent.remove(tag)
        elif not self.silent and tag in BREAKS | HEADINGS:
            self.end(tag in HEADINGS)

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)


def parse_html(text: str, out: Extracted) -> None:
    page = _Page(out)
    page.feed(text)
    page.close()
    page.end()


#: A named reference that no semicolon ends; browsers take some of them for characters.
_UNENDED = re.compile(r"&(?!amp)(?=[A-Za-z][A-Za-z0-9]*+(?!;))")


def html_to_text(text: str | None, lenient: bool = True) -> str:
    """Paragraphs, a line each; unless ``lenient``, named references without a semicolon are text, but for an ampersand's."""
    text = text if lenient or not text else _UNENDED.sub("&amp;", text)
    out = Extracted()
    try:
        parse_html(text or "", out)
    except (AssertionError, ValueError):
        return clean_text(html.unescape(re.sub("<[^>]*>", " ", text or "")))
    return "\n".join(s["text"] for s in out.sections)


def read_html(data: bytes, out: Extracted) -> None:
    m = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:+-]{2,40})", data[:4096], re.IGNORECASE)
    parse_html(decode(data, m[1].decode() if m else None)[0], out)


# --- mail and archives

# Labels of the header block, limits of attachments and archive members.
MAIL_FIELDS = {"From": "Od", "To": "Do", "Cc": "DW", "Date": "Data", "Subject": "Temat"}
MOST_ATTACHMENTS, MOST_ATTACHED = 30, 100 * 2**20
MOST_MEMBERS, MOST_UNPACKED, BOMB_RATIO, BOMB_BYTES = 200, 200 * 2**20, 200, 10 * 2**20


_FIELD = Remembered(lambda name, value: policy.default.header_fetch_parse(name, value), 1024)


class _Fields(policy.EmailPolicy):
    """The default policy, but each access to a field does not parse it anew; types of contents are alike in most mails."""

    def header_fetch_parse(self, name, value):
        return _FIELD[name, value] if type(value) is str and len(value) <= 200 else super().header_fetch_parse(name, value)


def read_mail(data: bytes, out: Extracted) -> None:
    mail = message_from_bytes(data, policy=_Fields())
    fields = {name: value for name in MAIL_FIELDS if (value := mail[name])}  # each access parses a field anew
    out.add("\n".join(f"{label}: {fields[name]}" for name, label in MAIL_FIELDS.items() if name in fields), "email_header")
    out.meta |= {k: str(fields[n]) for k, n in (("title", "Subject"), ("author", "From")) if n in fields}
    body = mail.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        for par in _lines((html_to_text(text) if body.get_content_subtype() == "html" else text).replace("\r\n", "\n")):
            out.add(clean_text(par))
    total = 0
    for part in mail.iter_attachments() if mail.is_multipart() else ():
        nested = part.get_content_type() == "message/rfc822"
        raw = part.get_content().as_bytes() if nested else part.get_payload(decode=True) or b""
        name = part.get_filename() or ("message.eml" if nested else "attachment")
        out.add(f"Załącznik: {name}", "attachment_note")
        total += len(raw)
        if len(out.attachments) < MOST_ATTACHMENTS and total <= MOST_ATTACHED:
            out.attachments.append((name, raw))
        else:
            out.warnings.append(f"attachment beyond limits: {name}")


def read_zip(data: bytes, out: Extracted) -> None:
    members = [m for m in zipfile.ZipFile(io.BytesIO(data)).infolist() if not m.is_dir()]
    names = [m.filename for m in members]
    for i in range(0, len(names), 50):
        out.add("\n".join(names[i : i + 50]), "archive_listing")
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in members:
            base = m.filename.rpartition("/")[2]
            bomb = m.file_size >= BOMB_BYTES and m.file_size > BOMB_RATIO * max(1, m.compress_size)
            junk = base.startswith((".", "~$")) or m.filename.startswith("__MACOSX/") or base.lower() in ("thumbs.db", "desktop.ini")
            reasons = {"bomb": bomb, "encrypted": m.flag_bits & 1, "beyond limits": len(out.attachments) >= MOST_MEMBERS or total + m.file_size > MOST_UNPACKED}
            if junk:
                continue
            if why := next((k for k, v in reasons.items() if v), None):
                out.warnings.append(f"member {why}: {m.filename}")
                continue
            total += m.file_size
            out.attachments.append((m.filename, z.read(m)))


# --- Office Open XML


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _below(e, tag: str):
    return [x for x in e.iter() if _tag(x) == tag]


def _run_text(p) -> str:
    return "".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "\n" if _tag(x) in ("br", "cr") else "" for x in p.iter())


def _heads_table(rows: list[list[str]]) -> bool:
    """Two rows or more, and a first one that is half filled, short, with letters and no bare number."""
    if len(rows) < 2:
        return False
    filled = [c for c in rows[0] if c]
    short = all(len(c) <= 64 for c in filled)
    return bool(filled) and 2 * len(filled) >= len(rows[0]) and short and any(map(str.isalpha, "".join(filled))) and not any(map(is_number, filled))


def _table(rows: list[list[str]], out: Extracted, heading: str | None, **more) -> None:
    header = None
    if _heads_table(rows):
        header, rows = rows[0], rows[1:]
        out.add(" | ".join(filter(None, header)), "table_header", heading=heading, **more)
    for i, cells in enumerate(rows, 1 + bool(header)):
        out.add(row_text(cells, header), "table_row", row=i, heading=heading, **more)


def read_docx(data: bytes, out: Extracted) -> None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, heading = _xml(z, "word/document.xml"), None
        styles = _xml(z, "word/styles.xml")
        named = {_attr(s, "styleId"): _attr(n, "val") or "" for s in (_below(styles, "style") if styles is not None else []) for n in _below(s, "name")[:1]}
        for block in next(iter(_below(body, "body")), body):
            if _tag(block) == "p":
                text = clean_text(_run_text(block))
                style = next((_attr(s, "val") or "" for s in _below(block, "pStyle")), "")
                if text and fold_text(named.get(style, style)).startswith(("heading", "nagl")):
                    heading = text
                out.add(text, heading=heading)
            elif _tag(block) == "tbl":
                rows = [[clean_text("\n".join(map(_run_text, _below(c, "p")))) for c in r if _tag(c) == "tc"] for r in _below(block, "tr")]
                caption = next((_attr(c, "val") for c in _below(block, "tblCaption")), None)
                _table(rows, out, caption or heading)
        seen = set()
        for name in sorted(z.namelist()):
            if re.fullmatch(r"word/(header|footer)\d*\.xml", name):
                text = clean_text("\n".join(map(_run_text, _below(_xml(z, name), "p"))))
                if text.casefold() not in seen:
                    seen.add(text.casefold())
                    out.add(text, "header_footer")


def read_pptx(data: bytes, out: Extracted) -> None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            root, title = _xml(z, name), None
            for shape in _below(root, "sp"):
                kind = next((_attr(p, "type") for p in _below(shape, "ph")), None)
                for p in _below(shape, "p"):
                    text = clean_text(_run_text(p))
                    if kind in ("title", "ctrTitle") and text:
                        title = text
                    out.add(text, heading=title, page=number)
            for t in _below(root, "tbl"):
                rows = [[clean_text(_run_text(c)) for c in r if _tag(c) == "tc"] for r in _below(t, "tr")]
                _table(rows, out, title, page=number)
            notes = _xml(z, f"ppt/notesSlides/notesSlide{number}.xml")
            for p in _below(notes, "p") if notes is not None else []:
                out.add(clean_text(_run_text(p)), "notes", heading=title, page=number)


#: Built-in number formats of dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def cell_text(value: str, kind: str | None, is_date: bool) -> str:
    """Booleans in words, dates as ISO with the time only where there is one, whole numbers without a fraction."""
    if kind == "b":
        return "PRAWDA" if value == "1" else "FALSZ"
    if kind in ("str", "inlineStr", "s", "e"):
        return value
    try:
        number = float(value)
    except ValueError:
        return value
    if number != number or number in (float("inf"), float("-inf")):
        return ""
    if is_date:
        when = datetime(1899, 12, 30) + timedelta(days=number)
        return when.date().isoformat() if when.time().isoformat() == "00:00:00" else when.replace(microsecond=0).isoformat(" ")
    return str(int(number)) if number == int(number) else repr(number)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes, out: Extracted) -> None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in _below(s, "t")) for s in _below(shared, "si")] if shared is not None else []
        styles = _xml(z, "xl/styles.xml")
        own = {int(_attr(f, "numFmtId")): _attr(f, "formatCode") or "" for f in _below(styles, "numFmt")} if styles is not None else {}
        used = [int(_attr(x, "numFmtId") or 0) for c in _below(styles, "cellXfs") for x in c] if styles is not None else []
        dated = [f in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(f, "")).lower())) for f in used]
        links = {_attr(r, "Id"): _attr(r, "Target") for r in _below(_xml(z, "xl/_rels/workbook.xml.rels"), "Relationship")}
        for sheet in _below(_xml(z, "xl/workbook.xml"), "sheet"):
            title = _attr(sheet, "name") or ""
            root = _xml(z, "xl/" + (links.get(_attr(sheet, "id")) or "").removeprefix("/xl/"))
            rows = []
            for r in _below(root, "row") if root is not None else []:
                cells: dict[int, tuple[str, bool]] = {}
                for c in r:
                    kind, style = _attr(c, "t"), int(_attr(c, "s") or 0)
                    raw = "".join(x.text or "" for x in c.iter() if _tag(x) in ("v", "t"))
                    raw = strings[int(raw)] if kind == "s" and raw else raw
                    text = clean_text(cell_text(raw, kind, style < len(dated) and dated[style])) if raw else ""
                    if text:
                        cells[_column(_attr(c, "r") or "")] = text, kind in ("s", "str", "inlineStr")
                if cells:
                    rows.append((int(_attr(r, "r") or 0), cells))
            if not rows:
                continue
            out.add(f"Arkusz: {title}", "sheet", sheet=title)
            first, header = rows[0][1], None
            if 2 * sum(s for _, s in first.values()) > len(first):
                header = [first.get(i, ("", 0))[0] for i in range(max(first) + 1)]
                out.add(" | ".join(filter(None, header)), "table_header", sheet=title)
                rows = rows[1:]
            for number, cells in rows:
                line = [cells.get(i, ("", 0))[0] for i in range(max(cells) + 1)]
                out.add(row_text(line, header), "table_row", row=number, sheet=title, heading=" | ".join(filter(None, header or [])) or None)


# --- RTF

_RTF = re.compile(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
# Destinations without text, and words that stand for characters.
RTF_SILENT = frozenset(b"fonttbl colortbl stylesheet info pict object header footer themedata generator".split())
RTF_CHARS = {b"par": "\n\n", b"line": "\n", b"tab": "\t", b"cell": " ", b"row": "\n", b"emdash": "—", b"endash": "–", b"bullet": "•", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”"}


def read_rtf(data: bytes, out: Extracted) -> None:
    page, text, stack, silent, skip, unicode_skip = "cp1252", [], [], False, 0, 1
    for m in _RTF.finditer(data):
        name, number, code, symbol, brace, plain = m.groups()
        if brace == b"{":
            stack.append((silent, unicode_skip))
        elif brace == b"}":
            silent, unicode_skip = stack.pop() if stack else (False, 1)
        elif symbol == b"*" or name in RTF_SILENT:
            silent = True
        elif name == b"ansicpg":
            page = f"cp{int(number)}"
        elif name == b"uc":
            unicode_skip = int(number or 1)
        elif silent:
            continue
        elif name == b"u":
            text.append(chr(int(number) % 65536))
            skip = unicode_skip
        elif code and skip:
            skip -= 1
        elif code:
            text.append(bytes.fromhex(code.decode()).decode(page, "replace"))
        elif name in RTF_CHARS:
            text.append(RTF_CHARS[name])
        elif symbol in (b"\\", b"{", b"}", b"~"):
            text.append(" " if symbol == b"~" else symbol.decode())
        elif plain:
            cut = plain[skip:]
            skip = max(0, skip - len(plain))
            text.append(cut.decode(page, "replace"))
    for par in _lines("".join(text)):
        out.add(clean_text(par))


def _read_msg(data: bytes, out: Extracted) -> None:
    read_msg(data, out, rtf=read_rtf, page=html_to_text)


def _cell(value: object) -> str:
    """A cell of an old workbook as text."""
    if isinstance(value, bool):
        return "prawda" if value else "falsz"
    if isinstance(value, float):
        return cell_text(repr(value), "n", False)
    if isinstance(value, datetime):
        return value.date().isoformat() if value.time().isoformat() == "00:00:00" else value.replace(microsecond=0).isoformat(" ")
    return clean_text(str(value))


def read_xls(data: bytes, out: Extracted) -> None:
    """Rows under a header if the sheet's first row has text alone, else under the sheet's name."""
    for title, cells in xls_sheets(data):
        texts = {r: {c: t for c, v in sorted(row.items()) if (t := _cell(v))} for r, row in sorted(cells.items())}
        texts = {r: row for r, row in texts.items() if row}
        if not texts:
            continue
        out.add(f"Arkusz: {title}", "sheet", sheet=title)
        header = None
        if len(texts) > 1 and all(isinstance(v, str) for v in cells.get(0, {0: None}).values()):
            first = texts.pop(0)
            header = [first.get(i, "") for i in range(max(first) + 1)]
            out.add(" | ".join(filter(None, header)), "table_header", sheet=title)
        label = " | ".join(filter(None, header or [])) or title
        for number, line in texts.items():
            out.add(row_text([line.get(i, "") for i in range(max(line) + 1)], header), "table_row", row=number + 1, sheet=title, heading=label)


@dataclass(frozen=True)
class Reader:
    name: str
    priority: int
    extensions: frozenset[str]
    types: frozenset[str]
    read: Callable[[bytes, Extracted], None]


def _reader(name: str, priority: int, extensions: str, read, types: str = "") -> Reader:
    from quillspark.sources.detect import EXTENSION_TYPES

    own = frozenset(extensions.split())
    return Reader(name, priority, own, frozenset(EXTENSION_TYPES[e] for e in own if e in EXTENSION_TYPES) | frozenset(types.split()), read)


NO_LIMITS = Limits()


def _library_archive(module: str, members: Callable[[object, io.BytesIO], Iterator[tuple[str, int, Callable[[], bytes]]]]):
    """A reader of archives by a library that may be installed."""

    def read(data: bytes, out: Extracted) -> None:
        library = importlib.import_module(module)
        found = list(members(library, io.BytesIO(data)))
        for i in range(0, len(found), 50):
            out.add("\n".join(n for n, _, _ in found[i : i + 50]), "archive_listing")
        total = 0
        for name, size, content in found:
            if len(out.attachments) >= MOST_MEMBERS or total + size > MOST_UNPACKED or (size >= BOMB_BYTES and size > BOMB_RATIO * len(data)):
                out.warnings.append(f"member beyond limits: {name}")
                continue
            total += size
            out.attachments.append((name, content()))

    return read


def _members_7z(library, data: io.BytesIO):
    with library.SevenZipFile(data) as z:
        if z.needs_password():
            raise PermissionError("encrypted")
        sizes = {f.filename: f.uncompressed for f in z.list() if not f.is_directory}
    for name, size in sizes.items():
        yield name, size, lambda name=name: library.SevenZipFile(io.BytesIO(data.getvalue())).read([name])[name].read()


def _members_rar(library, data: io.BytesIO):
    z = library.RarFile(data)
    if z.needs_password():
        raise PermissionError("encrypted")
    for m in z.infolist():
        if not m.is_dir():
            yield m.filename, m.file_size, lambda m=m: z.read(m)


def _optional() -> Iterator[Reader]:
    for name, module, members in (("7z", "py7zr", _members_7z), ("rar", "rarfile", _members_rar)):
        if importlib.util.find_spec(module):
            yield _reader(name, 100, "." + name, _library_archive(module, members))


READERS = [
    _reader("csv", 120, ".csv .tsv", read_csv),
    _reader("pdf", 110, ".pdf", read_pdf),
    _reader("docx", 110, ".docx .docm", read_docx),
    _reader("pptx", 110, ".pptx .pptm .ppsx .ppsm", read_pptx),
    _reader("msg", 110, ".msg", _read_msg),
    _reader("xls", 110, ".xls .xlt", read_xls),
    _reader("xlsx", 110, ".xlsx .xlsm", read_xlsx),
    _reader("eml", 110, ".eml .mht .mhtml", read_mail),
    _reader("html", 100, ".html .htm .xhtml", read_html),
    _reader("rtf", 100, ".rtf", read_rtf, "text/rtf"),
    _reader("zip", 100, ".zip", read_zip),
    _reader("image", 90, ".png .jpg .jpeg .tif .tiff .bmp .gif .webp", read_image),
    _reader("doc", 60, ".doc .dot", read_doc),
    _reader("ppt", 60, ".ppt .pps .pot", read_ppt),
    _reader("text", 90, ".txt .log .md .json .xml .ini .cfg .yaml .yml", read_text),
]


READERS += _optional()


def extract(content: bytes | None, name: str, limits: Limits = NO_LIMITS) -> tuple[Extracted, str, str | None]:
    """What the first reader that succeeds finds, its name, and the last error if none does."""
    data = content or b""
    if limits.most_bytes is not None and len(data) > limits.most_bytes:
        return Extracted(warnings=[f"larger than {limits.most_bytes} bytes"]), "", "skipped: too_large"
    mime, sealed = file_type(data, name)
    if sealed:
        return Extracted(), "", "password_protected"
    extension = "." + name.rpartition(".")[2].lower() if "." in name else ""
    fitting = [r for r in READERS if mime in r.types or extension in r.extensions]
    if not fitting and (mime.startswith("text/") or mime == "application/octet-stream") and looks_like_text(data[:4096]):
        fitting = [r for r in READERS if r.name == "text"]
    error = "unsupported"
    for reader in sorted(fitting, key=lambda r: -r.priority):
        out = Extracted(limits=limits)
        try:
            with contextlib.suppress(Enough):
                reader.read(data, out)
            return out, reader.name, None
        except InterruptedError:
            raise
        except PermissionError:
            return Extracted(), "", "password_protected"
        except Exception as e:  # any defect of a file is its own, and is reported with it
            error = f"corrupted: {type(e).__name__}"
    return Extracted(), "", error


SECTIONS = "source_id string, external_id string, ord int, text string, kind string, page int, sheet string, row int, heading string, origin string, parser string, error string, warnings string, pages int"
MOST_DEPTH = 3
MOST_HELD, MOST_ROWS = 8_000_000, 10_000  # characters and sections that a task holds before it hands them on


def _documents(content: bytes | None, key: str, name: str, limits: Limits = NO_LIMITS, depth: int = 0) -> Iterator[tuple[str, Extracted, str, str | None]]:
    out, parser, error = extract(content, name, limits)
    yield key, out, parser, error
    for inner, data in out.attachments if depth < MOST_DEPTH else ():
        yield from _documents(data, f"{key}#att:{inner}", inner, limits, depth + 1)


def sections(files: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """scan() rows to sections; attachments and archive members become documents of their own, three levels deep.

    A document without sections gives one row with null text, and its error if it has one.
    """
    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in SECTIONS.split(", "))])

    def flushed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for source, key, name, content in zip(*b.columns, strict=True):
                source = source.as_py()
                for doc, out, parser, error in _documents(content.as_py(), key.as_py(), name.as_py(), limits):
                    base = {"source_id": source, "external_id": doc, "parser": parser, "error": error, "origin": "native", "warnings": "; ".join(out.warnings) or None, "pages": int(out.meta.get("pages") or 0) or None}
                    rows += [{**base, "ord": i, **s} for i, s in enumerate(out.sections)] or [base]
                    size += out.chars
                if size > MOST_HELD or len(rows) > MOST_ROWS:
                    yield flushed(rows)
                    rows, size = [], 0
            yield flushed(rows)

    return files.select("source_id", "external_id", "name", "content").mapInArrow(run, SECTIONS)
