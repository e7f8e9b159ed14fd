"""Personal data: the base against its patterns, added kinds on planted texts, the query row by row."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.conftest import SF
from vidcohort.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    return kind == "email" or (13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def plain(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def base(text):
    return [(pii.KINDS[k], s, e) for k, s, e in pii.finder()(text) if k < 4]


def added(text):
    return [(pii.KINDS[k], text[s:e]) for k, s, e in pii.finder()(text) if k > 3]


def test_base_against_its_patterns():
    rng = random.Random(4)
    parts = ["@", ".", "-", "+", " ", "a", "B9", "é", "1", "25", "256", "0", "(", ")", "+1 ", "4111 1111 1111 1111", "10.0.0.1", "x@y.z", "中", "\n", "::", "://"]
    for n in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        assert base(text) == plain(text), text
        text = "".join(rng.choice("+@.- 019a") for _ in range(rng.randrange(1, 40)))
        assert base(text) == plain(text), text


def test_known_boundaries():
    assert base("a@b.c@d.e x@y") == [("email", 0, 5)]
    assert base("1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4") == [("ip", 0, 7), ("ip", 8, 15), ("ip", 26, 36)]
    assert base("4111-1111 1111-1111, 4111111111111112") == [("card", 0, 19)]
    assert base("+1 (743) 555-3220.") == [("phone", 0, 17)]


def test_added_kinds():
    assert added('see ftp://joe:pw1@host/x and http://host/@a token = "ab12cd34ef" Token: short1') == [("login", "joe:pw1"), ("account", "ab12cd34ef")]
    assert added("IBAN: GB82 WEST 1234 5698 7654 32 thanks; iban DE89370400440532013000x, IBAN GB82 WEST 1234 5698 7654 33") == [
        ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000"),
    ]
    assert added("Account no. 00123456, accounts 991234567, Passport X1234567.") == [("account", "00123456"), ("account", "X1234567")]
    assert added("at 12 Old Mill Street, Hauptstraße 5a, rue de la Paix 7, the street 9, main road") == [
        ("address", "12 Old Mill Street"), ("address", "Hauptstraße 5a"), ("address", "rue de la Paix 7"),
    ]


def test_query_against_plain(spark):
    sf = SF.replace("0.001", "0.01")
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = pii.op12_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in BASE]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
        kinds = [pii.KINDS.index(x.split(":")[0]) for x in r.spans.split(",") if x]
        assert kinds == sorted(kinds)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 40


def test_odd_rows(spark):
    long = "1" * 3000 + " " + "a" * 3000 + "@b.co " + "+1" + "." * 3000 + " 9" * 3000 + "1." * 2000
    rows = [(1, None), (1, ""), (1, "a@b.co"), (1, "a@b.co"), (None, "10.0.0.1"), (2, long), (3, "𝒳 a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("n_ip", F.lit(9))
    got = sorted(map(tuple, pii.digests(docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        found = plain(t)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        want.append((i, *[sum(k == x for k, *_ in found) for x in BASE], sha(listed), listed))
    assert got == sorted(want, key=str)
    assert pii.spans(docs).where("doc_id = 3").first().spans[0].start == 2
    assert [r.text for r in pii.masked(docs).where("doc_id <> 2").orderBy("doc_id", "text").collect()] == [None, "", "<email>", "<email>", "𝒳 <email>"]


def test_very_long_texts_in_one_pass():
    text = "1" * 400_000 + " " + "a" * 200_000 + "@b.co " + "+1" + "." * 100_000 + " 9" * 100_000 + "1." * 50_000
    assert ("email", 400_001, 600_006) in base(text)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(empty).count() == 0 and pii.masked(empty).count() == 0
