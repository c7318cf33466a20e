"""Small files of every format, made byte by byte, for demonstrations and checks of the readers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from datetime import UTC, datetime
from email.message import EmailMessage

from quillspark.sources import ole


def compound(streams, sector=512):
    """A compound file with the streams, by path."""
    entries, children = [["Root Entry", 5, 0, 0, b""]], {"": []}
    for path in sorted(streams):
        parts = path.split("/")
        for i in range(1, len(parts)):
            above = "/".join(parts[:i])
            if above not in children:
                children["/".join(parts[: i - 1])].append(len(entries))
                children[above] = []
                entries.append([parts[i - 1], 1, above, 0, b""])
        children["/".join(parts[:-1])].append(len(entries))
        entries.append([parts[-1], 2, None, 0, streams[path]])
    small = {i: e for i, e in enumerate(entries) if e[1] == 2 and len(e[4]) < 4096}
    mini, mini_fat = b"", []
    for e in small.values():
        n = -(-len(e[4]) // 64)
        e[3] = len(mini) // 64 if n else 0xFFFFFFFE
        mini_fat += [*range(e[3] + 1, e[3] + n), 0xFFFFFFFE] if n else []
        mini += e[4].ljust(64 * n, b"\x00")
    fat, body = [], b""

    def place(data):
        nonlocal body
        n = -(-len(data) // sector)
        start = len(fat)
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE] if n else [])
        body += data.ljust(sector * n, b"\x00")
        return start if n else 0xFFFFFFFE

    for i, e in enumerate(entries):
        if e[1] == 2 and i not in small:
            e[3] = place(e[4])
    root_start = place(mini)
    mini_start = place(b"".join(struct.pack("<I", x) for x in mini_fat))
    rows = []
    for i, (name, kind, key, start, data) in enumerate(entries):
        own = children.get("" if i == 0 else key, []) if kind != 2 else []
        brothers = next((c for c in children.values() if i in c), [])
        right = brothers[brothers.index(i) + 1] if i in brothers and brothers.index(i) + 1 < len(brothers) else 0xFFFFFFFF
        raw = name.encode("utf-16-le")
        row = raw.ljust(64, b"\x00") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, right, own[0] if own else 0xFFFFFFFF)
        rows.append(row.ljust(116, b"\x00") + struct.pack("<IQ", root_start if i == 0 else start, len(mini) if i == 0 else len(data)))
    directory = place(b"".join(rows))
    fat_at = len(fat)
    n_fat = -(-(len(fat) + 1) // (sector // 4))
    fat += [0xFFFFFFFD] * n_fat
    table = b"".join(struct.pack("<I", x) for x in fat).ljust(sector * n_fat, b"\xff")
    head = ole.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", n_fat, directory, 0, 4096, mini_start, 1 if mini_fat else 0, 0xFFFFFFFE, 0)[:28]
    head = head[:72] + struct.pack("<I", 0) + struct.pack("<109I", *[fat_at + i if i < n_fat else 0xFFFFFFFF for i in range(109)])
    return head.ljust(sector, b"\x00") + body + table


def word(text, wide="", flags=0x0200):
    """A document of two pieces, one of single bytes and one of two."""
    raw = text.encode("cp1252") + wide.encode("utf-16-le")
    main = bytearray(2048)
    struct.pack_into("<H8xH", main, 0, 0xA5EC, flags)
    struct.pack_into("<I", main, 0x4C, len(text) + len(wide))
    main += raw
    plc = struct.pack("<III", 0, len(text), len(text) + len(wide)) + struct.pack("<HIH", 0, 2 * 2048 | 0x40000000, 0) + struct.pack("<HIH", 0, 2048 + len(text), 0)
    clx = b"\x01\x02\x00ab" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x01A2, 5, len(clx))
    return compound({"WordDocument": bytes(main), "1Table": b"-----" + clx})


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def long_text(t):
    return struct.pack("<HB", len(t), 1) + t.encode("utf-16-le")


def workbook(split=False, protect=False):
    strings = ["Imię", "Kwota", "Kiedy", "Łucja", "x" * 40]
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(map(long_text, strings))
    parts = [sst]
    if split:  # the border lies inside the characters of the last string, whose rest comes in single bytes
        cut = len(sst) - 30
        parts = [sst[:cut], b"\x00" + b"x" * 15]
    cells = [
        record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), record(0xFD, struct.pack("<HHHI", 0, 2, 0, 2)),
        record(0xFD, struct.pack("<HHHI", 2, 0, 0, 3)), record(0x203, struct.pack("<HHHd", 2, 1, 0, 314.5)), record(0x203, struct.pack("<HHHd", 2, 2, 1, 42209.0)),
        record(0xFD, struct.pack("<HHHI", 3, 0, 0, 4)), record(0x27E, struct.pack("<HHHI", 3, 1, 0, 7 << 2 | 2)), record(0x205, struct.pack("<HHHBB", 3, 2, 0, 1, 0)),
        record(0xBD, struct.pack("<HH", 4, 0) + struct.pack("<HI", 0, (125 << 2) | 3) + struct.pack("<HI", 2, 10 << 2 | 2) + struct.pack("<H", 1)),
        record(0x06, struct.pack("<HHH", 5, 0, 0) + b"\x00" * 6 + b"\xff\xff" + bytes(8)), record(0x207, long_text("suma")),
        record(0x06, struct.pack("<HHHd", 5, 1, 0, -2.0) + bytes(8)), record(0x205, struct.pack("<HHHBB", 5, 2, 0, 7, 1)),
    ]
    bof, eof = record(0x809, bytes(16)), record(0x0A, b"")
    styles = record(0x41E, struct.pack("<H", 164) + long_text("yyyy-mm-dd")) + b"".join(record(0xE0, struct.pack("<HH16x", 0, f)) for f in (0, 14, 164))
    name = "Dane".encode()
    sheet = lambda at: record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name)
    middle = styles + record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:]) + eof
    start = len(bof) + (4 + 2) * protect + len(sheet(0)) + len(middle)
    return compound({"Workbook": bof + (record(0x2F, b"\x00\x00") if protect else b"") + sheet(start) + middle + bof + b"".join(cells) + eof})


def atom(kind, body, version=0, instance=0):
    return struct.pack("<HHI", instance << 4 | version, kind, len(body)) + body


def slides(texts: list[str]) -> bytes:
    """A presentation of slides with a text each."""
    body = b"".join(atom(0x03F3, bytes(20)) + atom(0x0FA0, t.encode("utf-16-le")) for t in texts)
    return compound({"PowerPoint Document": atom(0x03E8, atom(0x0FF0, body, 15, 0), 15)})


def mail(prefix="", attached=None, body="Treść\r\n\r\nDruga", **more):
    put = lambda n, t: {f"{prefix}__substg1.0_{n}001F": t.encode("utf-16-le")}
    ticks = int((datetime(2015, 7, 24, 10, tzinfo=UTC) - datetime(1601, 1, 1, tzinfo=UTC)).total_seconds()) * 10**7
    head = bytes(24 if prefix else 32)
    streams = put("0037", "Temat listu") | put("0C1A", "Ala") | put("0C1F", "ala@example.org") | put("0E04", "Ola")
    streams |= {f"{prefix}__properties_version1.0": head + struct.pack("<HHIQ", 0x0040, 0x0039, 6, ticks)}
    if body:
        streams |= put("1000", body)
    for i, (name, content) in enumerate(attached or []):
        at = f"{prefix}__attach_version1.0_#{i:08d}/"
        streams |= {f"{at}__substg1.0_3707001F": name.encode("utf-16-le")}
        streams |= content(f"{at}__substg1.0_3701000D/") if callable(content) else {f"{at}__substg1.0_37010102": content}
    return streams | {prefix + k: v for k, v in more.items()}


def pdf_file(pages, fonts="/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", extra=(), packed=True, objstm=False, trailer=b""):
    """A file with the given page contents; ``extra`` are more objects from number 100 on."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Title (Tytu\\263) /Author <FEFF0041006C0061> /CreationDate (D:20150724) >>"}
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    objects[2] = f"<< /Type /Pages /Kids [ {kids} ] /Count {len(pages)} /Resources << /Font << {fonts} >> /XObject << /Fm1 100 0 R >> >> >>".encode()
    for i, content in enumerate(pages):
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        body = zlib.compress(content) if packed else content
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream"
    objects |= {100 + i: x for i, x in enumerate(extra)}
    if objstm:
        inner = {k: v for k, v in objects.items() if b"stream" not in v}
        places, body = [], b""
        for k, v in inner.items():
            places.append(f"{k} {len(body)}")
            body += v + b" "
        head = " ".join(places).encode() + b" "
        data = zlib.compress(head + body)
        objects = {k: v for k, v in objects.items() if k not in inner}
        objects[200] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(inner), len(head), len(data)) + data + b"\nendstream"
    out = b"%PDF-1.5\n%\xe2\xe3\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items())
    return out + b"trailer\n<< /Root 1 0 R /Info 3 0 R " + trailer + b">>\n%%EOF"


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(*paragraphs: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>"})


def xlsx(title: str, rows: list[list[str | float]]) -> bytes:
    def cell(r: int, c: int, v: str | float) -> str:
        at = f"{chr(65 + c)}{r}"
        return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v!r}</v></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets><sheet name="{title}" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>",
    })


def pptx(*slides_: list[str]) -> bytes:
    parts = {"ppt/presentation.xml": "<a/>"}
    for i, texts in enumerate(slides_, 1):
        shapes = "".join(f"<p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>" for t in texts)
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a">{shapes}</p:sld>'
    return zipped(parts)


def eml(subject: str, text: str, attached: tuple[str, bytes] | None = None) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "biuro@firma.example", "klient@firma.example", subject
    m.set_content(text)
    if attached:
        m.add_attachment(attached[1], maintype="application", subtype="octet-stream", filename=attached[0])
    return m.as_bytes()


def png(width: int, height: int) -> bytes:
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = zlib.compress((b"\x00" + bytes(3 * width)) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def sheet(name: str, rows: list[list[str | float]]) -> bytes:
    """An old workbook of one sheet."""
    strings = list(dict.fromkeys(v for row in rows for v in row if isinstance(v, str)))
    shared = record(0xFC, struct.pack("<II", len(strings), len(strings)) + b"".join(map(long_text, strings)))
    cells = b"".join(
        record(0xFD, struct.pack("<HHHI", r, c, 0, strings.index(v))) if isinstance(v, str) else record(0x203, struct.pack("<HHHd", r, c, 0, v))
        for r, row in enumerate(rows) for c, v in enumerate(row)
    )
    title = name.encode()
    bof, eof = record(0x809, bytes(16)), record(0x0A, b"")
    head = lambda at: record(0x85, struct.pack("<IBBBB", at, 0, 0, len(title), 0) + title)
    start = len(bof) + len(head(0)) + len(shared) + len(eof)
    return compound({"Workbook": bof + head(start) + shared + eof + bof + cells + eof})
