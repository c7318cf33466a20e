import io
import zipfile
from email.message import EmailMessage

from quillspark.sources import detect, extract
from quillspark.sources.files import Crawl, scan


def texts(name, data):
    out, parser, error = extract.extract(data, name)
    assert error is None, error
    return [s["text"] for s in out.sections], out, parser


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    return b.getvalue()


def test_csv():
    found, out, _ = texts("a.csv", "data;kwota;opis\n2015-07-24;314,00;\n;;\n2015-07-25;1;x;extra\n".encode())
    assert found == ["data | kwota | opis", "data: 2015-07-24 | kwota: 314,00", "data: 2015-07-25 | kwota: 1 | opis: x | extra"]
    assert [s["kind"] for s in out.sections] == ["table_header", "table_row", "table_row"]
    assert texts("b.csv", b"1,2\n3,4\n")[0] == ["1 | 2", "3 | 4"]


def test_html():
    page = "<html><head><title>T</title><meta name=author content='A B'></head><body><script>x</script><h2>Head</h2><p>One<br>two</p><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    found, out, _ = texts("x.html", page.encode())
    assert found == ["Head", "One", "two", "a b"] and out.meta == {"author": "A B", "title": "T"}
    assert out.sections[1]["heading"] == "Head"
    assert extract.html_to_text("a<p>b</p>&amp; c") == "a\nb\n& c" and extract.html_to_text(None) == ""


def test_mail_and_archives():
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@b.example", "c@d.example", "Hej"
    m.set_content("First.\n\nSecond.")
    m.add_attachment(b"inner text", maintype="text", subtype="plain", filename="in.txt")
    found, out, _ = texts("m.eml", m.as_bytes())
    assert found[0].startswith("Od: a@b.example") and found[1:] == ["First.", "Second.", "Załącznik: in.txt"]
    assert out.attachments == [("in.txt", b"inner text")]
    found, out, _ = texts("z.zip", zipped({"d/a.txt": "x", ".hidden": "y", "bomb": "0" * 11 * 2**20}))
    assert len(found) == 1 and [n for n, _ in out.attachments] in (["d/a.txt"], ["d/a.txt", "bomb"])
    assert extract.extract(b"7z\xbc\xaf\x27\x1c", "x.7z")[2] == "unsupported" and extract.extract(b"PK\x03\x04junk", "x.zip")[2].startswith("corrupted")


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{s and f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>"}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    doc = f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('Body')}<w:tbl>{row('Name', 'Age')}{row('Ola', '7')}</w:tbl></w:body></w:document>"
    found, out, parser = texts("a.docx", zipped({"word/document.xml": doc}))
    assert found == ["Title", "Body", "Name | Age", "Name: Ola | Age: 7"] and parser == "docx" and out.sections[1]["heading"] == "Title"
    book = '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    styles = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    cells = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Kto</t></is></c><c r="B1" t="inlineStr"><is><t>Kiedy</t></is></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" s="1"><v>42209</v></c><c r="C3"><v>5.0</v></c></row></sheetData></worksheet>'
    found, out, _ = texts("a.xlsx", zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": cells}))
    assert found == ["Arkusz: S1", "Kto | Kiedy", "Kto: PRAWDA | Kiedy: 2015-07-24 | 5"] and out.sections[2]["row"] == 3
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:sp></p:sld>'
    found, out, _ = texts("a.pptx", zipped({"ppt/presentation.xml": "<a/>", "ppt/slides/slide1.xml": slide}))
    assert found == ["Slide", "Point"] and out.sections[1]["page"] == 1


def test_rtf_and_text():
    found, *_ = texts("a.rtf", rb"{\rtf1\ansi\ansicpg1250{\fonttbl{\f0 Arial;}}Za\'bf\'f3\'b3\u322?\par Drugi \b akapit\b0}")
    assert found == ["Zażółł", "Drugi akapit"]
    assert texts("a.txt", "Łódź\n\nDrugi".encode("cp1250"))[0] == ["Łódź", "Drugi"]


def test_detection():
    assert detect.file_type(b"%PDF-1", "x")[0] == "application/pdf" and detect.file_type(b"a\x00b", "x")[0] == "application/octet-stream"
    assert detect.file_type(b"hello", "noext")[0] == "text/plain" and detect.file_type(b"", "a.CSV")[0] == "text/csv"
    assert detect.decode("zażółć gęślą".encode("iso-8859-2"))[0] == "zażółć gęślą"
    assert detect.decode(b"\xff\xfea\x00")[0] == "a"


def test_scan_and_sections(spark, tmp_path):
    for name, data in {"a.txt": b"one", "sub/b.csv": b"x,y\n1,2", ".hidden/c.txt": b"no", "sub/~tmp.txt": b"no", "big.txt": b"z" * 99, "e.txt": b" \n", "n.zip": zipped({"in.txt": "inner"})}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = scan(spark, Crawl(str(tmp_path), excluded_globs=["*~*"], most_bytes=50_000))
    got = {r.external_id: r for r in files.collect()}
    assert set(got) == {"a.txt", "sub/b.csv", "big.txt", "e.txt", "n.zip"} and got["a.txt"].etag.startswith("3-")
    rows = extract.sections(files).collect()
    by = {}
    for r in rows:
        by.setdefault(r.external_id, []).append((r.ord, r.text, r.error))
    assert sorted(by["sub/b.csv"]) == [(0, "x | y", None), (1, "x: 1 | y: 2", None)]
    assert by["n.zip#att:in.txt"] == [(0, "inner", None)] and by["e.txt"] == [(None, None, None)]  # Spark's reader leaves out files of no bytes
