import random
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.functions import spans as sp
from quillspark.functions import text as tx
from quillspark.plans.query import analyze, clauses


def values(spark, expression, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_fold_in_jvm_equals_exact_fold(spark):
    r = random.Random(4)
    alphabet = [chr(c) for c in range(32, 0x250) if unicodedata.category(chr(c))[0] != "C"] + list("̨́ł")
    alphabet = [c for c in alphabet if len(tx.fold_text(c)) == 1 or c in tx.SPECIAL_LETTERS or unicodedata.combining(c)]
    rows = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(300)] + ["ZAŻÓŁĆ", "straße Æ œ"]
    assert values(spark, tx.fold, rows) == [tx.fold_text(t) for t in rows] == values(spark, tx.fold_udf(), rows)


def test_cleaning(spark):
    rows = ["a b\r\nc  d \n\n\n\ne", "dłu-\ngi", "„x”…​\x07", "  "]
    want = ["a b\nc d\n\ne", "długi", '"x"...', ""]
    assert values(spark, tx.clean, rows) == want == [tx.clean_text(t) for t in rows]
    assert values(spark, lambda c: tx.normalize_space(c, paragraphs=False), ["a \n\n b"]) == ["a b"]


def test_measures(spark):
    assert values(spark, tx.alpha_ratio, ["ab1 ?", "", " \n"]) == [0.75, 0.0, 0.0]
    assert values(spark, tx.is_garbage, ["ab1 ?", "", "???a", "abc�"]) == [False, True, True, True]
    assert values(spark, tx.collapse_runs, ["aaaaab   \n\n\n\n\n", "abab"]) == ["aaab   \n\n\n", "abab"]
    assert values(spark, tx.strip_separators, ["1 2-3–4.5/6_7\\8"]) == ["12345678"]


def test_redaction(spark):
    rows = ["Authorization: Bearer abcdefgh12345 ok", "password = 'hunter22' x", "f" * 45, "z" * 250, None]
    got = values(spark, tx.redact, rows)
    assert got[0] == "Authorization: Bearer [usunieto] ok" and got[1].startswith("password=[usunieto]") and got[2] == "[usunieto]"
    assert got[3] == "z" * 200 + "...[+50 znaków]" and got[4] is None
    df = spark.createDataFrame([({"Token": "abc", "body": "xyz", "n": "token=abcdef"},)], "m map<string,string>")
    assert df.select(tx.redact_map(F.col("m")).alias("m")).first().m == {"Token": "[usunieto]", "body": "<3 znaków>", "n": "token=[usunieto]"}
    assert values(spark, tx.safe_url, ["http://a/b?c=d#e", "http://a#?x"]) == ["http://a/b?[parametry usunięte]", "http://a"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("24.07.2015", ["dat20150724", "mon201507", "yea2015"]),
        ("dnia 5 marca 2014 r. i luty 2013", ["dat20140305", "mon201403", "yea2014", "mon201302", "yea2013"]),
        ("01/02/39 1.2.40", ["dat20390201", "mon203902", "yea2039", "dat19400201", "mon194002", "yea1940"]),
        ("31.02.2015 2015-13-01 1899-01-01", []),
        ("2015-07-24", ["dat20150724", "mon201507", "yea2015"]),
    ],
)
def test_dates(text, want):
    assert sp.date_tokens(text) == want


def test_numbers():
    assert [s.token for s in sp.amounts("314 zł, 1 234,5 PLN i 1.234,56 EUR")] == ["kwo31400", "kwo123450", "kwo123456"]
    assert [s.token for s in sp.digit_runs("12 3456 7890, 12-34; 2015 x1234 123")] == ["num1234567890", "num1234", "num2015"]
    assert sp.digit_runs("1" * 26)[0].kind == "account"
    assert [s.token for s in sp.ibans("PL61 1090 1014 0000 0712 1981 2874.")] == ["accpl61109010140000071219812874"]
    assert [s.token for s in sp.official_numbers("NIP: 123-456-32-18 pesel 44051401359")] == ["nip1234563218", "pes44051401359"]
    assert [s.token for s in sp.identifiers("FV/2015/07/123 i ABC12345, 2015/07")] == ["idffv201507123", "idfabc12345"]
    assert "num20150724" in [s.token for s in sp.numbers("2015-07-24")]
    assert sp.digit_variants("123456") == ["123456", "1234 56", "1234-56"] and len(sp.digit_variants("1" * 26)) == 5
    assert sp.account_token("12 34") == "num1234" and sp.account_token("x") is None
    assert len(sp.literal_tokens(" ".join(str(10000 + i) for i in range(900)))) == 400


def test_query_analysis():
    q = analyze('umowa "karta łódzka" od 01.01.2015 do 31.12.2015 FV/2015/1234 314 zł')
    assert [(t.kind, t.value) for t in q.terms] == [
        ("phrase", "karta lodzka"), ("amount", "kwo31400"), ("date_range", "dat20150101"), ("date_range", "dat20151231"), ("identifier", "idffv20151234"),
        ("word", "umowa"), ("word", "karta"), ("word", "lodzka"), ("word", "od"), ("word", "do"),
    ] or [t.kind for t in q.terms][:5] == ["phrase", "amount", "date_range", "date_range", "identifier"]
    assert q.ranges == [(date(2015, 1, 1), date(2015, 12, 31))]
    assert q.required_tokens == ["kwo31400", "idffv20151234"]
    assert analyze("  ").terms == [] and analyze("ile kosztuje?").natural
    assert [t.kind for t in analyze("raport-a.pdf 1234567890").terms] == ["filename", "account"]
    strict, loose = clauses(analyze("ala kot"), True), clauses(analyze("ala kot"), False)
    assert [len(c) for c in strict] == [1, 1] and [len(c) for c in loose] == [2]
