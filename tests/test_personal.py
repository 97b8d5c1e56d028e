import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.functions import personal as P


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def found(spark, text, kind):
    return spark.createDataFrame([(text,)], "t string").select(P.matches(F.col("t"), kind)).first()[0]


def test_checksums_equal_plain_python(spark):
    rng = random.Random(1)
    digits = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 20))) for _ in range(200)]
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"] + [f"DE{k:02d}370400440532013000" for k in range(100)]
    rows = spark.createDataFrame([(d, None) for d in digits] + [(None, i) for i in ibans], "d string, i string")
    got = rows.select("d", "i", P.luhn(F.col("d")), P.iban(F.col("i"))).collect()
    for d, i, is_card, is_iban in got:
        assert d is None or is_card == plain_luhn(d)
        assert i is None or is_iban == plain_iban(i)
    assert sum(r[3] for r in got if r[1]) >= 4


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("card", "pay 4111 1111 1111 1111, not 4111 1111 1111 1112; 5500-0000-0000-0004.", ["4111 1111 1111 1111", "5500-0000-0000-0004"]),
        ("card", "0000 0000 0000 0000 and 41111111111111110000000", []),
        ("ip_address", "at 10.0.0.255 or 999.999.999.999, version 1.2.3.4, v1.2.3.4, 1.2.3.4.5, 01.2.3.4", ["at 10.0.0.255"]),
        ("ip_address", "8.8.8.8", ["8.8.8.8"]),
        ("iban", "GB00 AAAA AAAA AAAA but DE89 3704 0044 0532 0130 00 and FE5949719B6B82BC439E9329", ["DE89 3704 0044 0532 0130 00"]),
        ("email", "a.b@mail7.example.co, no@one, x@y.z1", ["a.b@mail7.example.co"]),
        ("phone", "+1 (017) 555-7713 or 212-555-0187, not 00581169930 nor 1 2 3", ["+1 (017) 555-7713", "212-555-0187"]),
    ],
)
def test_matches(spark, kind, text, want):
    assert [x.strip() for x in found(spark, text, kind)] == want


def test_null_empty_and_long(spark):
    df = spark.createDataFrame([(None,), ("",), ("4" * 200_000,), ("a" * 200_000,), ("1.2.3.4 " * 20_000,), ("A1" * 100_000,)], "t string")
    rows = df.select(*[F.size(P.matches(F.col("t"), k)) for k in P.CANDIDATES], P.masked(F.col("t")).alias("m")).collect()
    assert rows[0][:5] == (0,) * 5 and rows[0].m is None and rows[1].m == "" and rows[4].m == "[ip_address] " * 20_000


def test_masked_texts(spark):
    text = "Mail a.b@c.org or call +1 (017) 555-7713; card 4111 1111 1111 1111, host at 10.0.0.1 (version 1.2.3.4)."
    want = "Mail [email] or call [phone]; card [card], host at [ip_address] (version 1.2.3.4)."
    assert spark.createDataFrame([(text,)], "t string").select(P.masked(F.col("t"))).first()[0] == want


def test_the_tables_personal_data(spark):
    """Documents hold e-mail addresses, phone numbers, IP addresses and card numbers of one form each: all are found, and nothing else is masked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    forms = {"email": r"[a-zßà-ÿ]+\.\d+@mail\d+\.example\.co", "phone": r"\+1 \(\d{3}\) 555-\d{4}", "ip_address": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", "card": r"(?<![\dA-Za-z])\d{16}(?![\dA-Za-z])"}
    rows = docs.select("text", P.masked(F.col("text")).alias("m"), *[P.matches(F.col("text"), k).alias(k) for k in forms]).collect()
    said = {k: sum(k != "card" or plain_luhn(x) for r in rows for x in re.findall(f, r.text)) for k, f in forms.items()}
    got = {k: sum(len(r[k]) for r in rows) for k in forms}
    assert got == said and min(said.values()) > 5
    assert all(r.m == r.text for r in rows if not any(r[k] for k in forms))
