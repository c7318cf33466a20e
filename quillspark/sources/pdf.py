"""Text of PDF files, page by page, by the public specification (ISO 32000): objects, streams, fonts' character maps, text operators.

Objects are found by their headers, so that a broken cross reference does no
harm. Text that only a drawing or a font without a character map tells is not
seen; pages with little text are for OCR.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from quillspark.functions.text import clean_text

MOST_PAGES = 5000  # fixed value
_SPACE = b" \t\r\n\f\x00"
_TOKEN = re.compile(rb"[^\s()<>\[\]{}/%\x00]+")
_HEADER = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_END = re.compile(rb"\r?\n?endstream")


class Name(str):
    """/Name"""


class Word(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    fields: dict
    raw: bytes


class Lexer:
    """Objects of a piece of PDF, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 0x25:  # a comment
                ends = [e for e in (d.find(b"\n", self.at), d.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(d))
            else:
                return

    def next(self):
        """The next object or Word; None at the end."""
        self._skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        two, c = d[at : at + 2], d[at : at + 1]
        if two == b"<<":
            self.at += 2
            return self._dictionary()
        if c == b"<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._string()
        if c == b"[":
            self.at += 1
            return list(iter(self._item, "]"))
        if c == b"/":
            m = _TOKEN.match(d, at + 1)
            self.at = m.end() if m else at + 1
            name = m[0] if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), name).decode("latin-1"))
        m = _TOKEN.match(d, at)
        if not m:  # ], >>, braces, stray brackets
            self.at += 2 if two == b">>" else 1
            return Word(two.decode("latin-1") if two == b">>" else c.decode("latin-1"))
        self.at = m.end()
        text = m[0].decode("latin-1")
        if re.fullmatch(r"[+-]?\d+", text):
            return int(text)
        if re.fullmatch(r"[+-]*\d*\.\d*", text) and any(map(str.isdigit, text)):
            return float(re.sub(r"^[+-]*(?=[+-])", "", text))
        return {"true": True, "false": False}.get(text, Word(text))

    def _item(self):
        """The next object, references resolved to Ref; "]" at the end of an array."""
        value = self.next()
        if value is None or (isinstance(value, Word) and value in ("]", ">>", "endobj")):
            return "]"
        if isinstance(value, int) and not isinstance(value, bool):
            m = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(value)
        return None if isinstance(value, Word) and value == "null" else value

    def _dictionary(self) -> dict:
        out = {}
        while True:
            key = self._item()
            if key == "]":
                return out
            if isinstance(key, Name):
                value = self._item()
                if value == "]":
                    return out
                out[str(key)] = value

    def _string(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while at < len(d):
            c = d[at]
            if c == 0x5C and at + 1 < len(d):
                e = d[at + 1]
                m = re.compile(rb"[0-7]{1,3}").match(d, at + 1)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                if e in (10, 13):
                    at += 3 if d[at + 1 : at + 3] == b"\r\n" else 2
                    continue
                out.append(plain.get(e, e))
                at += 2
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
            at += 1
        self.at = at + 1
        return bytes(out)


def _unpredicted(data: bytes, fields: dict) -> bytes:
    """PNG and TIFF predictors undone."""
    kind, colors, bits = fields.get("Predictor", 1), fields.get("Colors", 1), fields.get("BitsPerComponent", 8)
    width = max(1, (fields.get("Columns", 1) * colors * bits + 7) // 8)
    step = max(1, colors * bits // 8)
    if kind < 10:
        return data
    out, above = bytearray(), bytes(width)
    for i in range(0, len(data) - 1, width + 1):
        how, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for k in range(len(row)):
            left, up = row[k - step] if k >= step else 0, above[k] if k < len(above) else 0
            corner = above[k - step] if k >= step else 0
            if how == 1:
                row[k] = (row[k] + left) & 255
            elif how == 2:
                row[k] = (row[k] + up) & 255
            elif how == 3:
                row[k] = (row[k] + (left + up) // 2) & 255
            elif how == 4:
                guess = left + up - corner
                row[k] = (row[k] + min((left, up, corner), key=lambda v: abs(guess - v))) & 255
        out += row
        above = bytes(row)
    return bytes(out)


def _inflated(data: bytes) -> bytes:
    """As much as can be read."""
    engine, out = zlib.decompressobj(), b""
    try:
        out = engine.decompress(data) + engine.flush()
    except zlib.error:
        for i in range(0, len(data), 256):
            try:
                if not i:
                    engine, out = zlib.decompressobj(), b""
                out += engine.decompress(data[i : i + 256])
            except zlib.error:
                break
    return out


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.partition(b"~>")[0]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        group += [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        for m in _HEADER.finditer(data):
            self._enter(int(m[1]), data, m.end())
        for m in re.finditer(rb"\btrailer\b", data):
            fields = Lexer(data, m.end()).next()
            if isinstance(fields, dict):
                self.trailer |= fields
        if "Encrypt" in self.trailer:
            raise PermissionError("encrypted")
        for o in [o for o in self.objects.values() if isinstance(o, Stream) and o.fields.get("Type") == "ObjStm"]:
            self._unfold(o)

    def _enter(self, number: int, data: bytes, at: int) -> None:
        lexer = Lexer(data, at)
        value = lexer._item()
        if isinstance(value, dict):
            m = re.compile(rb"\s*stream(\r\n|\n|\r)?").match(data, lexer.at)
            if m:
                length = value.get("Length")
                end = m.end() + length if isinstance(length, int) else -1
                if end < 0 or not _END.match(data, end):
                    close = _END.search(data, m.end())
                    end = close.start() if close else len(data)
                if value.get("Type") == "XRef":
                    self.trailer = {**value, **self.trailer}
                value = Stream(value, data[m.end() : end])
        self.objects[number] = value

    def _unfold(self, stream: Stream) -> None:
        body = self.body(stream)
        first, n = self.get(stream.fields.get("First"), 0), self.get(stream.fields.get("N"), 0)
        head = Lexer(body[:first])
        places = [(head.next(), head.next()) for _ in range(n)]
        for number, at in places:
            if isinstance(number, int) and isinstance(at, int) and number not in self.objects:
                self.objects[number] = Lexer(body, first + at)._item()

    def get(self, value, default=None):
        for _ in range(32):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(value.number)
        return default if value is None else value

    def body(self, stream: Stream) -> bytes:
        data = stream.raw
        filters, params = self.get(stream.fields.get("Filter"), []), self.get(stream.fields.get("DecodeParms"), [])
        filters = filters if isinstance(filters, list) else [filters]
        params = params if isinstance(params, list) else [params]
        for i, f in enumerate(filters):
            how = self.get(f)
            options = self.get(params[i], {}) if i < len(params) else {}
            if how in ("FlateDecode", "Fl"):
                data = _unpredicted(_inflated(data), {k: self.get(v) for k, v in options.items()} if isinstance(options, dict) else {})
            elif how in ("ASCIIHexDecode", "AHx"):
                data = Lexer(b"<" + data.partition(b">")[0] + b">").next()
            elif how in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            else:
                return b""  # images
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        todo, seen, found = [(self.get(root.get("Pages"), {}), {})], set(), False
        while todo:
            node, above = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = {**above, **{k: v for k, v in node.items() if k in ("Resources", "Contents")}}
            if "Kids" in node:
                todo += [(self.get(k, {}), own) for k in reversed(self.get(node["Kids"], []))]
            else:
                found = True
                yield own
        if not found:  # no tree: pages as they come
            yield from (o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Page")

    def info(self) -> dict[str, str]:
        fields = self.get(self.trailer.get("Info"), {})
        said = {k.lower(): self.get(v) for k, v in fields.items()} if isinstance(fields, dict) else {}
        return {k: text for k, v in said.items() if isinstance(v, bytes) and (text := text_string(v).strip())}


def text_string(data: bytes) -> str:
    """A text string outside of page contents."""
    if data.startswith(b"\xfe\xff"):
        return data[2:].decode("utf-16-be", "replace")
    return data[3:].decode("utf-8", "replace") if data.startswith(b"\xef\xbb\xbf") else data.decode("cp1252", "replace")


# --- fonts

# Names of glyphs that are no letters, and of marks on letters.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "endash": "–", "emdash": "—", "bullet": "•",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "ellipsis": "…", "section": "§", "degree": "°", "Euro": "€", "minus": "−",
    "lslash": "ł", "Lslash": "Ł", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "fi": "fi", "fl": "fl", "dotlessi": "ı",
}
MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "caron": "̌", "ogonek": "̨", "cedilla": "̧", "ring": "̊", "dotaccent": "̇", "hungarumlaut": "̋", "macron": "̄", "breve": "̆"}


def glyph(name: str) -> str:
    """The text of a named glyph; empty if the name tells nothing."""
    name = name.partition(".")[0]
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        codes = [m[2]] if m[2] else [m[1][i : i + 4] for i in range(0, len(m[1]), 4)]
        return "".join(chr(int(c, 16)) for c in codes if int(c, 16) < 0x110000)
    mark = MARKS.get(name[1:])
    return unicodedata.normalize("NFC", name[0] + mark) if mark else ""


class Font:
    def __init__(self, doc: Document, fields: dict):
        self.wide = fields.get("Subtype") == "Type0"
        self.map: dict[bytes, str] = {}
        self.sizes = {2} if self.wide else {1}
        unicode_map = doc.get(fields.get("ToUnicode"))
        if isinstance(unicode_map, Stream):
            self._read(doc.body(unicode_map))
        encoding = doc.get(fields.get("Encoding"))
        base = encoding if isinstance(encoding, str) else doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else None
        page = {"MacRomanEncoding": "mac_roman"}.get(base, "cp1252")
        self.codes = ["" if self.wide else bytes([i]).decode(page, "ignore") for i in range(256)]
        if isinstance(encoding, dict):
            at = 0
            for x in doc.get(encoding.get("Differences"), []):
                x = doc.get(x)
                if isinstance(x, Name):
                    if at < 256:
                        self.codes[at] = glyph(x)
                    at += 1
                elif isinstance(x, int):
                    at = x

    def _read(self, data: bytes) -> None:
        """A character map: codes, ranges and lists of what they stand for."""
        lexer, held = Lexer(data), []
        text = lambda b: b.decode("utf-16-be", "ignore")
        while (x := lexer.next()) is not None:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == "endcodespacerange":
                self.sizes = {len(b) for b in held if isinstance(b, bytes)} or self.sizes
            elif x == "endbfchar":
                self.map |= {a: text(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif x == "endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                    if not isinstance(low, bytes) or not isinstance(high, bytes):
                        continue
                    first, n = int.from_bytes(low, "big"), len(low)
                    for i in range(min(65_536, int.from_bytes(high, "big") - first + 1)):
                        if isinstance(to, list):
                            own = text(to[i]) if i < len(to) and isinstance(to[i], bytes) else ""
                        else:
                            own = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big")) if len(to) >= 2 else ""
                        self.map[(first + i).to_bytes(n, "big")] = own
            held = []

    def text(self, data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            code = next((data[at : at + n] for n in sorted(self.sizes, reverse=True) if data[at : at + n] in self.map), None)
            if code is None:
                code = data[at : at + min(self.sizes)]
                out.append(self.codes[code[0]] if len(code) == 1 else "")
            else:
                out.append(self.map[code])
            at += max(1, len(code))
        return "".join(out)


# --- page contents


class Painter:
    """Text operators of a page as lines: a step down starts a new one, a gap becomes a blank."""

    def __init__(self, doc: Document):
        self.doc, self.out = doc, []
        self.fonts: dict[int, Font] = {}
        self.size = 1.0

    def _font(self, resources: dict, name: str) -> Font | None:
        fields = self.doc.get(self.doc.get(resources.get("Font"), {}).get(name))
        if not isinstance(fields, dict):
            return None
        if id(fields) not in self.fonts:
            self.fonts[id(fields)] = Font(self.doc, fields)
        return self.fonts[id(fields)]

    def _break(self, mark: str) -> None:
        if self.out and not self.out[-1].endswith(("\n", " ") if mark == " " else "\n"):
            self.out.append(mark)

    def _move(self, x: float, y: float) -> None:
        """The start of a line moves."""
        if abs(y) > 0.2 * max(1.0, self.size):
            self._break("\n\n" if abs(y) > 1.9 * max(1.0, self.size) and y < 0 else "\n")
        elif x:
            self._break(" ")

    def paint(self, data: bytes, resources: dict, depth: int = 0) -> None:
        lexer, held, font, leading = Lexer(data), [], None, 0.0
        place = (0.0, 0.0)

        def show(*parts) -> None:
            for p in parts:
                if isinstance(p, bytes):
                    self.out.append(font.text(p) if font else p.decode("cp1252", "ignore"))
                elif isinstance(p, int | float) and p < -180:
                    self._break(" ")

        while (x := lexer.next()) is not None:
            if not isinstance(x, Word):
                held.append(x)
                continue
            numbers = [v for v in held if isinstance(v, int | float)]
            if x == "Tf" and len(held) >= 2:
                font, self.size = self._font(resources, held[-2]), abs(float(held[-1] or 1)) if isinstance(held[-1], int | float) else 1.0
            elif x in ("Tj", "'", '"') and held:
                if x != "Tj":
                    self._move(0, -(leading or self.size))
                show(held[-1])
            elif x == "TJ" and held and isinstance(held[-1], list):
                show(*held[-1])
            elif x in ("Td", "TD") and len(numbers) >= 2:
                leading = -numbers[-1] if x == "TD" else leading
                self._move(*numbers[-2:])
            elif x == "T*":
                self._move(0, -(leading or self.size))
            elif x == "TL" and numbers:
                leading = numbers[-1]
            elif x == "Tm" and len(numbers) >= 6:
                scale = abs(numbers[-3]) or 1.0
                self._move((numbers[-2] - place[0]) / scale, (numbers[-1] - place[1]) / scale)
                place = tuple(numbers[-2:])
            elif x == "BT":
                place = (0.0, 0.0)
                self._break("\n")
            elif x == "Do" and held and depth < 8:
                form = self.doc.get(self.doc.get(resources.get("XObject"), {}).get(held[-1]))
                if isinstance(form, Stream) and form.fields.get("Subtype") == "Form":
                    self.paint(self.doc.body(form), self.doc.get(form.fields.get("Resources"), resources), depth + 1)
            elif x == "BI":  # an image inside the contents
                m = re.compile(rb"\sEI(?=\s|$)").search(data, lexer.at)
                lexer.at = m.end() if m else len(data)
            held = []


def pages(data: bytes) -> tuple[list[str], dict[str, str]]:
    """The text of each page, and the document's information."""
    doc = Document(data)
    out = []
    for page in doc.pages():
        if len(out) >= MOST_PAGES:
            break
        contents = doc.get(page.get("Contents"), [])
        parts = [doc.get(c) for c in contents] if isinstance(contents, list) else [contents]
        painter = Painter(doc)
        painter.paint(b"\n".join(doc.body(p) for p in parts if isinstance(p, Stream)), doc.get(page.get("Resources"), {}))
        out.append(clean_text("".join(painter.out)))
    return out, doc.info()


def read_pdf(data: bytes, out) -> None:
    """A section for each page with text; ``meta`` has the number of pages and which of them are for OCR."""
    texts, info = pages(data)
    for number, text in enumerate(texts, 1):
        out.add(text, "page", page=number)
    out.meta |= {k: info[k] for k in ("title", "author", "subject", "keywords", "creationdate") if k in info}
    out.meta["pages"] = str(len(texts))
