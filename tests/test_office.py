import struct

import pytest

from quillspark.sources import detect, extract, images, legacy, ole, pdf
from quillspark.sources.samples import atom, compound, mail, pdf_file, word, workbook


def texts(name, data):
    out, parser, error = extract.extract(data, name)
    assert error is None, error
    return [s["text"] for s in out.sections], out, parser


# --- compound files


def test_compound_file():
    streams = {"small": b"abc", "dir/big": bytes(range(256)) * 40, "dir/sub/x": b"y" * 100, "empty": b""}
    file = ole.CompoundFile(compound(streams))
    assert file.streams() == sorted(streams) and {p: file.read(p) for p in streams} == streams
    assert file.storages() == ["dir"] and file.storages("dir/") == ["dir/sub"]
    for bad in (b"", b"x" * 600, ole.SIGNATURE + bytes(600)):
        with pytest.raises(ValueError):
            ole.CompoundFile(bad)


def test_word():
    found, out, parser = texts("a.doc", word("Title\rBody \x13 HYPERLINK x \x14link\x15 end\rName\x07Age\x07\x07\r", "Zażółć gęślą\x0bjaźń\r"))
    assert parser == "doc" and found == ["Title", "Body link end", "Name | Age", "Zażółć gęślą", "jaźń"]
    assert out.sections[2]["kind"] == "table_row"
    assert extract.extract(word("x", flags=0x0300), "a.doc")[2] == "password_protected"
    assert extract.extract(compound({"WordDocument": b"zz"}), "a.doc")[2].startswith("corrupted")
    assert detect.file_type(word("x"), "wrong.xls") == ("application/msword", False)


@pytest.mark.parametrize("split", [False, True])
def test_excel(split):
    found, out, parser = texts("a.xls", workbook(split))
    assert parser == "xls" and found == [
        "Arkusz: Dane", "Imię | Kwota | Kiedy", "Imię: Łucja | Kwota: 314.5 | Kiedy: 2015-07-24", f"Imię: {'x' * 40} | Kwota: 7 | Kiedy: prawda",
        "Imię: 1.25 | Kwota: 1900-01-09", "Imię: suma | Kwota: -2",
    ]
    assert [s.get("row") for s in out.sections] == [None, None, 3, 4, 5, 6]


def test_excel_protected():
    assert extract.extract(workbook(protect=True), "a.xls")[2] == "password_protected"


def test_powerpoint():
    outline = atom(0x0FF0, atom(0x03F3, bytes(20)) + atom(0x0FA0, "Tytuł".encode("utf-16-le")) + atom(0x03F3, bytes(20)) + atom(0x0FA8, b"Second\rline"), 15, 0)
    notes = atom(0x0FF0, atom(0x03F3, bytes(20)) + atom(0x0FA8, b"note"), 15, 2)
    slides = atom(0x03EE, atom(0xF00D, atom(0x0FA8, b"Box"), 15), 15) + atom(0x03EE, atom(0x0FA8, b"Second\rline"), 15)
    data = compound({"PowerPoint Document": atom(0x03E8, outline + notes, 15) + slides})
    found, out, parser = texts("a.ppt", data)
    assert parser == "ppt" and found == ["Tytuł", "Box", "Second\nline"] and [s["page"] for s in out.sections] == [1, 1, 2]


def test_outlook():
    found, out, parser = texts("m.msg", compound(mail(attached=[("a.txt", b"inner"), ("inner", lambda p: mail(p, body="W środku"))])))
    head = "Od: Ala <ala@example.org>\nDo: Ola\nData: 2015-07-24T10:00:00+00:00\nTemat: Temat listu"
    assert parser == "msg" and found == [head, "Treść", "Druga", "Załącznik: a.txt", "Załącznik: inner", head, "W środku"]
    assert out.attachments == [("a.txt", b"inner")] and out.meta["title"] == "Temat listu"
    page = compound(mail(body="", **{"__substg1.0_10130102": b"<p>One</p><p>Two</p>"}))
    assert texts("m.msg", page)[0][1:] == ["One\nTwo"] or texts("m.msg", page)[0][1:] == ["One", "Two"]


def test_compressed_rtf():
    """The specification's own two examples, and a message whose body is only there."""
    packed = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")
    rtf = b"{\\rtf1\\ansi\\ansicpg1252\\pard hello world}\r\n"
    assert legacy.unpacked_rtf(packed) == rtf
    loop = bytes.fromhex("1a0000001c0000004c5a4675e2d44b51410004205758595a0d6e7d010eb0")
    assert legacy.unpacked_rtf(loop) == b"{\\rtf1 WXYZWXYZWXYZWXYZWXYZ}"
    assert texts("m.msg", compound(mail(body="", **{"__substg1.0_10090102": packed})))[0][1:] == ["hello world"]


# --- PDF


@pytest.mark.parametrize("objstm", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed, objstm):
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ T* (third\\041) Tj ET % note (\n"
    two = b"q BT /F1 10 Tf 1 0 0 1 72 700 Tm (Left) Tj 1 0 0 1 200 700 Tm (right) Tj 1 0 0 1 72 686 Tm <4E6578 74> Tj ET Q"
    found, out, parser = texts("a.pdf", pdf_file([one, two, b""], packed=packed, objstm=objstm))
    assert parser == "pdf" and found == ["Hello (world)\nSecond line\nthird!", "Left right\nNext"]
    assert [s["page"] for s in out.sections] == [1, 2] and out.meta == {"title": "Tytu³", "author": "Ala", "creationdate": "D:20150724", "pages": "3"}


def test_pdf_fonts():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <017B> <0002> <00660066> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0142> <00F3>] endbfrange"
    cmap_object = b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"
    form = b"BT /F1 9 Tf (in a form) Tj ET"
    form_object = b"<< /Type /XObject /Subtype /Form /Length %d >>\nstream\n" % len(form) + form + b"\nendstream"
    fonts = (
        "/F1 << /Type /Font /Subtype /Type1 /Encoding << /Differences [ 65 /aogonek /Lslash 67 /uni017C /eacute /zero ] >> >> "
        "/F2 << /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 101 0 R >>"
    )
    page = b"BT /F1 12 Tf (ABCDEx) Tj 0 -40 Td /F2 12 Tf <000100100011001200020020 0021> Tj ET /Fm1 Do BI /W 1 ID (\xff( EI BT /F1 9 Tf 0 -20 Td (end) Tj ET"
    found, *_ = texts("a.pdf", pdf_file([page], fonts, [form_object, cmap_object]))
    assert "\n".join(found) == "ąŁżé0x\n\nŻabcffłó\nin a form\nend"


def test_pdf_filters_and_defects():
    assert pdf._ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    rows = b"\x00\x01\x02\x03" + b"\x01\x01\x01\x01" + b"\x02\x01\x01\x01" + b"\x04\x01\x00\x00"
    assert pdf._unpredicted(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 3, 4])
    data = pdf_file([b"BT /F1 12 Tf (whole) Tj ET"])
    assert texts("a.pdf", data.replace(b"/Length ", b"/Wrong "))[0] == ["whole"]
    assert texts("a.pdf", data.replace(b"trailer", b"nothing"))[0] == ["whole"]
    assert extract.extract(pdf_file([b""], trailer=b"/Encrypt 9 0 R "), "a.pdf")[2] == "password_protected"
    assert texts("a.pdf", b"%PDF-1.4\n")[0] == []
    cut = data[: data.index(b"endstream") - 3]
    assert extract.extract(cut, "a.pdf")[2] is None  # what can be read is read


# --- images


def test_image_facts():
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + bytes(4)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Author\x00Ala") + chunk(b"IEND", b"")
    assert images.facts(png) == {"width": "30", "height": "20", "author": "Ala"}
    entry = lambda tag, kind, n, v: struct.pack("<HHI", tag, kind, n) + v
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 3) + entry(0x100, 3, 1, struct.pack("<HH", 7, 0)) + entry(0x101, 4, 1, struct.pack("<I", 9))
    tiff += entry(0x0110, 2, 6, struct.pack("<I", 50)) + struct.pack("<I", 0) + b"M100\x00\x00"
    assert images.facts(tiff) == {"width": "7", "height": "9", "model": "M100", "pages": "1"}
    exif = b"Exif\x00\x00" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 40, 50) + bytes(12)
    assert images.facts(jpeg) == {"model": "M100", "width": "50", "height": "40"}
    assert images.facts(b"GIF89a" + struct.pack("<HH", 3, 4)) == {"width": "3", "height": "4"}
    assert images.facts(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == {"width": "5", "height": "6"}
    assert images.facts(b"RIFF....WEBPVP8X" + bytes(8) + b"\x09\x00\x00\x07\x00\x00") == {"width": "10", "height": "8"}
    out, parser, error = extract.extract(png, "scan.png")
    assert (parser, error, out.sections) == ("image", None, []) and out.meta["width"] == "30"
    assert extract.extract(b"\xff\xd8\xff", "x.jpg")[2].startswith("corrupted")


def test_encodings_and_types():
    assert detect.decode("Москва, слова".encode("cp1251"), "cp1251") == ("Москва, слова", "cp1251")
    for name, mark in (("utf-32-le", b"\xff\xfe\x00\x00"), ("utf-32-be", b"\x00\x00\xfe\xff"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        assert detect.decode(mark + "zażółć".encode(name)) == ("zażółć", name)
    for name in ("utf-16-le", "utf-16-be"):
        assert detect.guess("plain words of a text".encode(name)) == name
    for name in ("cp1250", "iso-8859-2"):
        assert detect.decode("Zażółć gęślą jaźń, ŁÓDŹ".encode(name))[0] == "Zażółć gęślą jaźń, ŁÓDŹ"
    assert detect.decode("汉字".encode("gb2312"), "gb2312")[1] != "gb2312"  # a declared encoding that reads foreign scripts is not believed
    assert detect.candidates(b"abc", "CP_1250")[:2] == ["cp-1250", "utf-8"] and len(set(detect.candidates(b"abc"))) == len(detect.candidates(b"abc"))
    assert detect.text_score("") == 0 and detect.text_score("ab") == 1 and detect.text_score("ą") == 3 and detect.text_score("\x00") == -8
    assert detect.file_type(b"\x1f\x8b\x08", "a.gz")[0] == "application/gzip" and detect.EXTENSION_TYPES[".pps"] == "application/vnd.ms-powerpoint"
    assert detect.file_type(compound({"EncryptedPackage": b"x"}), "a.docx")[1]


def test_warnings_of_what_is_left_out():
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb.txt", b"0" * 11 * 2**20)
        for i in range(202):
            z.writestr(f"{i}.txt", "x")
    out = extract.extract(b.getvalue(), "a.zip")[0]
    assert len(out.attachments) == 200 and out.warnings == ["member bomb: bomb.txt", "member beyond limits: 200.txt", "member beyond limits: 201.txt"]


def test_limits():
    data = "\n\n".join(f"akapit {i}" for i in range(100)).encode()
    out, parser, error = extract.extract(data, "a.txt", extract.Limits(chars=50))
    assert sum(len(s["text"]) for s in out.sections) <= 50 and out.warnings == ["read up to 50 characters"] and (parser, error) == ("text", None)
    rows = "a;b\n" + "x;y\n" * 20
    out = extract.extract(rows.encode(), "a.csv", extract.Limits(rows=5))[0]
    assert len([s for s in out.sections if s["kind"] == "table_row"]) == 5 and out.warnings == ["read up to 5 rows"]
    assert extract.extract(data, "a.txt", extract.Limits(seconds=-1))[0].warnings == ["read up to -1 seconds"]
    assert extract.extract(data, "a.txt", extract.Limits(most_bytes=10))[2] == "skipped: too_large"
    with pytest.raises(InterruptedError):
        extract.extract(data, "a.txt", extract.Limits(cancelled=lambda: True))
    assert not extract.extract(data, "a.txt")[0].warnings


def test_archives_by_libraries_that_may_be_there(monkeypatch):
    """A stand-in for a library: listing, members within limits, passwords."""
    import sys
    import types

    class Archive:
        def __init__(self, data):
            self.names = data.read().decode().split(",")

        def needs_password(self):
            return "secret" in self.names

        def infolist(self):
            return [types.SimpleNamespace(filename=n, file_size=10**9 if n == "big" else 3, is_dir=lambda n=n: n.endswith("/")) for n in self.names]

        def read(self, m):
            return m.filename.encode()

    monkeypatch.setitem(sys.modules, "fakerar", types.SimpleNamespace(RarFile=Archive))
    read = extract._library_archive("fakerar", extract._members_rar)
    out = extract.Extracted()
    read(b"a.txt,d/,big,b.txt", out)
    assert out.attachments == [("a.txt", b"a.txt"), ("b.txt", b"b.txt")] and out.warnings == ["member beyond limits: big"] and out.sections[0]["text"] == "a.txt\nbig\nb.txt"
    with pytest.raises(PermissionError):
        read(b"secret", extract.Extracted())
