import hashlib
import re

import duckdb
import pytest

from tideline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in zip(range(len(d), 0, -1), map(int, d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


ODD = [
    None, "", "a@b.com", "a@b", "x a@b.com_c@d.org.. a@b@c.de", "a@b.com._x@y.z", "%@-.-", "é@b.com ü a@ü.com a@b.comü", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0003.255 1.2.3", "9.9.9.9@x.y",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1 (310) 555-4510 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49.30-123456+1 22 333 4444", "日本 +81 3-1234-5678 🙂 a@b.cd",
    "a." * 1000 + "@" + "b." * 1000 + "c", "1 " * 3000, "4111111111111111 " * 400, "x" * 6_000 + "@", "7" * 6_000, "+1" + " " * 6_000, "a@" * 4_000,
]


@pytest.fixture(scope="module")
def selector(spark):
    return pii.train(spark)


def found(spark, texts, selector):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [tuple(x) for x in r.found] for r in pii.find_spans(df, selector).collect()}


def test_base_spans_equal_the_plain_patterns(spark, selector):
    got = found(spark, ODD, selector)
    for i, t in enumerate(ODD):
        assert [x for x in got[i] if x[0] in pii.BASE] == brute(t), (t or "")[:80]


def test_whole_table(spark):
    rows = {r.doc_id: r for r in pii.op8_pii(spark, "/root/testdata/sf0.01").collect()}
    for doc, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        base, r = brute(text), rows.pop(doc)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in PLAIN)
        said = ",".join("%s:%d:%d" % x for x in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)
        # All planted keys are found, and nothing else is.
        keys = [m.span(1) for m in re.finditer(r'(?:password=|token = "|\b(?=AKIA))([A-Za-z0-9]{16,})', text)]
        more = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("secret")]
        assert more == keys, text[max(0, (more + keys)[0][0] - 40) :][:120]
    assert not rows


@pytest.mark.parametrize("text,kind", [("please call (310) 555-4510 now", "phone_local"), ("her ssn 123-45-6789 is", "id_number"), ("iban DE89 3704 0044 0532 0130 00 please", "iban"), ("mail me: anna (at) home (dot) com", "email_text"), ("api_key: 9f8e7d6c5b4a39281706f5e4d3c2b1a0", "secret")])
def test_proposals_are_selected_by_context(spark, selector, text, kind):
    assert [x[0] for x in found(spark, [text], selector)[0]] == [kind]


@pytest.mark.parametrize("text", ["lot 123-45-6789 of", "commit da39a3ee5e6b4b0d3255bfef95601890afd80709 fixed", "internationalisation-of-communication", "isbn 978 316 1484 and 123 456 7890"])
def test_other_numbers_are_left(spark, selector, text):
    assert found(spark, [text], selector)[0] == []


def test_redaction_and_columns(spark, selector):
    rows = [(1, "a@b.com é 1.2.3.4 (a@b.com)", "x", "y"), (2, None, "x", "y"), (2, "clean", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, T string, base string")
    out = pii.redact(df, selector)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id", "text").collect()] == ["<email> é <ip> (<email>)", None, "clean"]
    assert pii.find_spans(df.limit(0), selector).collect() == []


def test_very_long_runs_end(spark, selector):
    got = found(spark, ["x" * 1_000_000 + "@", "7" * 1_000_000, "1 " * 300_000, "+1" + " " * 1_000_000, "a@" * 200_000, "a." * 200_000 + "@b.c"], selector)
    assert [len([x for x in got[i] if x[0] in pii.BASE]) for i in range(6)] == [0, 0, 0, 0, 0, 1]
