import hashlib
import re

from photoflow.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in text.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE]
    return [len(s) for s in spans], hashlib.sha256(",".join(x for s in spans for x in s).encode()).hexdigest()


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.digest(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        n, sha = brute(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (n, sha), (r.doc_id, (texts[r.doc_id] or "")[:80])
        base = [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == sha
    return {r.doc_id: r for r in got}


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "a@b.c+d@e.f@g.h x.@y..z q@r.s-"), (4, "1.2.3.4.5.6.7.8 999.1.1.1 0255.000001.2.3 256.1.1.1"), (5, "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111"),
        (6, "+1 (212) 555-8457 +1((((( ++12345678901 +1-2"), (7, "é😀 mail é@x.de a@é.de 😀b@c.de"), (8, "1" * 60_000), (9, "a" * 60_000 + "@"), (10, "1.2." * 20_000), (11, "x@y.z " * 3_000), (None, "me@here.org"), (12, "me@here.org"), (12, "me@here.org"),
        (13, "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433"), (14, "ssn 123-45-6789 but 123-45-6780 alone " + "far " * 30 + "123-45-6789"), (15, "call 212-555-8457; 212-555-8458 " + "far " * 30 + "212-555-8459"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "'x' as id", "2 as found")
    got = check(docs)
    assert got[13].n_iban == 1 and got[14].n_ssn == 1 and got[15].n_tel == 1
    assert got[1].spans == "" and got[12].n_email == 1 and got[4].n_ip == 3
    assert pii.digest(docs.limit(0)).count() == 0


def test_account_numbers_end_where_their_country_ends_them(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 AND MORE", "GB82WEST12345698765432 2024 A", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82WEST123456987654321", "DE89 3704 0044 0532 0130 01 X", "ZZ12ABCDEFGHIJKLMNOP"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.found for r in pii.find_spans(docs).where("kind = 'iban'").collect()}
    assert found == {0: "GB82 WEST 1234 5698 7654 32", 1: "GB82WEST12345698765432", 2: "DE89 3704 0044 0532 0130 00"}
