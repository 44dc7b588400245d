import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import pseudonyms as P


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


@pytest.fixture(scope="module")
def run(spark):
    def go(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return [r.text for r in P.op1(df, P.DEMO_KEY).orderBy("doc_id").collect()]

    return go


def test_cards_keep_their_check_digit_and_link(run):
    a, b, c, d = run("pay 4111 1111 1111 1111 now", "4111111111111111!!", "4111111111111112", "x 378282246310005 y")
    digits = re.sub(r"\D", "", a)
    assert digits == re.sub(r"\D", "", b) and luhn(digits) and digits != "4111111111111111"
    assert re.fullmatch(r"pay \d{4} \d{4} \d{4} \d{4} now", a)
    assert c == "4111111111111112" and luhn(re.sub(r"\D", "", d)) and "378282246310005" not in d


def test_dates_stay_dates_in_their_format(run):
    got = run("on 1990-02-28.", "on 28.02.1990, or", "02/28/1990 and 31/12/1999", "1990-02-29 13-13-2000")
    iso = re.search(r"\d{4}-\d\d-\d\d", got[0])[0]
    day = datetime.date.fromisoformat(iso)
    assert iso != "1990-02-28" and day.strftime("%d.%m.%Y") in got[1] and day.strftime("%m/%d/%Y") in got[2]
    assert got[3] == "1990-02-29 13-13-2000"


def test_other_kinds(run):
    got = run("a.b+c@mail7.example.com", "10.0.0.1 and 300.1.1.1", "+1 (974) 555-3436", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "DE89 3704 0044 0532 0130 00", "123-45-6789 666-12-1234")
    assert re.fullmatch(r"[a-z]\.[a-z]\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", got[0]) and "mail7" not in got[0]
    assert "10.0.0.1" not in got[1] and got[1].endswith(" and 300.1.1.1") and all(int(x) < 256 for x in got[1].split()[0].split("."))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[2]) and "555-3436" not in got[2]
    assert re.fullmatch(r'token = "[a-z0-9]{40}"', got[3]) and "b44e15" not in got[3]
    iban = got[4].replace(" ", "")
    assert len(iban) == 22 and iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} 666-12-1234", got[5]) and "123-45-6789" not in got[5]


def test_permutations_have_no_collisions(spark):
    n = 7 * 11
    got = spark.range(n).select(P.permuted_number(F.col("id"), 7, 11, "k", "t").alias("x")).toPandas().x
    assert sorted(got) == list(range(n))
    three = spark.range(1000).select(P.permuted_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x")).toPandas().x
    assert three.nunique() == 1000 and three.str.fullmatch(r"\d{3}").all()
    other = spark.range(1000).select(P.permuted_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k2", "t").alias("x")).toPandas().x
    assert (three != other).mean() > 0.9


def test_edge_rows(spark, edge_docs, no_docs):
    got = P.pseudonymised(edge_docs, "k")
    assert got.columns == [*edge_docs.columns, "n_found", "n_replaced"]
    have = {(r.doc_id, r.text) for r in got.collect()}
    assert have == {(r.doc_id, r.text) for r in edge_docs.collect()}
    assert P.op1(no_docs, "k").count() == 0
    plan = P.op1(edge_docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_text(run):
    text = "word " * 200_000 + "4111111111111111 " + "9" * 5000
    (got,) = run(text)
    assert got.startswith("word word") and "4111111111111111" not in got and got.endswith("9" * 5000)


def digest(key, kind, number, half):
    return hashlib.sha256(f"{key}|{kind}|{number}|{half}".encode()).hexdigest()


def feistel_string(s, key, kind, rounds=8):
    """The permutation in plain Python, from its description: halves swap, one is shifted by the digest of the other."""

    def shift(c, by):
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                return chr((ord(c) - ord(first) + by) % size + ord(first))
        return c

    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, rounds + 1):
        d = digest(key, kind, i, right)
        left, right = right, "".join(shift(c, int(d[2 * (j % 32) : 2 * (j % 32) + 2], 16)) for j, c in enumerate(left))
    return left + right


def feistel_number(x, a, b, key, kind, rounds=4):
    left, right = x // b, x % b
    for i in range(1, rounds + 1):
        left = (left + int(digest(key, kind, 2 * i, right)[:15], 16)) % a
        right = (right + int(digest(key, kind, 2 * i + 1, left)[:15], 16)) % b
    return left * b + right


def test_permutations_are_those_of_plain_python(spark):
    texts = ["4111111", "a.B+9@x-Z", "0", "", "zz", "ab" * 100, "A1-" * 33]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.permuted_string(F.col("t"), "key", "kind").alias("p"))
    assert {r.t: r.p for r in df.collect()} == {t: feistel_string(t, "key", "kind") for t in texts}
    for a, b in ((7, 11), (189, 773), (1 << 16, 1 << 16)):
        got = spark.range(40).select((F.col("id") * (a * b // 41)).alias("x")).select("x", P.permuted_number(F.col("x"), a, b, "key", "n").alias("p")).collect()
        assert {r.x: r.p for r in got} == {r.x: feistel_number(r.x, a, b, "key", "n") for r in got}


def test_whole_values_are_those_of_plain_python(run):
    key = P.DEMO_KEY
    secret, mail = "b44E15e0-9", "first.last@mail.example.com"
    days = (datetime.date(1990, 2, 28) - datetime.date(1800, 1, 1)).days
    day = datetime.date(1800, 1, 1) + datetime.timedelta(feistel_number(days, 189, 773, key, "date"))
    ip = feistel_number(10 << 24 | 1, 1 << 16, 1 << 16, key, "ip")
    got = run(f'password: "{secret}"', mail, "1990-02-28", "10.0.0.1", "+14155552671 +1 415 555 2671")
    assert got[0] == f'password: "{feistel_string(secret, key, "secret")}"' and got[1] == feistel_string(mail[:-4], key, "email") + ".com"
    assert got[2] == day.isoformat() and got[3] == ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0))
    assert re.fullmatch(r"\+\d{11} \+1 \d{3} \d{3} \d{4}", got[4]) and "5552671" not in got[4] and "555 2671" not in got[4]


def test_secrets_of_any_length_and_either_quote(run):
    long, short = "s3cret" * 80, "ab1"
    got = run(f'password = "{long}"', f"token='{short}'", f"api_key   :\t'{long}' and \"kept\"", 'secret = ""', 'mail ' + "x" * 300 + "@a.example.org.")
    assert len(got[0]) == len(f'password = "{long}"') and "s3cret" not in got[0] and got[0].startswith('password = "')
    assert re.fullmatch(r"token='[a-z]{2}\d'", got[1]) and got[1] != f"token='{short}'"
    assert "s3cret" not in got[2] and got[2].endswith('\' and "kept"') and got[3] == 'secret = ""'
    assert "x" * 20 not in got[4] and got[4].endswith(".org.")


def test_any_columns_and_rows(spark):
    rows = [(1, "card 4111111111111111", 1, 2, 3, 4), (1, "card 4111111111111111", 1, 2, 3, 4), (None, "on 1990-02-28", 1, 2, 3, 4), (2, None, 1, 2, 3, 4), (3, "", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int, new int, row int, n_found int").withColumn("__pii_found", F.lit(5)).withColumn("a b.c", F.lit(6))
    got = P.pseudonymised(docs, "k")
    assert got.columns == ["doc_id", "text", "found", "new", "row", "__pii_found", "a b.c", "n_found", "n_replaced"]
    by = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert by[0] == by[1] and "4111111111111111" not in by[0].text and (by[0].n_found, by[0].n_replaced, by[0].found, by[0].new) == (1, 1, 1, 2)
    assert by[-1].text != "on 1990-02-28" and by[-1].n_replaced == 1
    assert [(r.text, r.n_found) for r in by[2:4]] == [(None, 0), ("", 0)]
    with pytest.raises(ValueError):
        P.pseudonymised(docs, "")
