"""Personal data against patterns of Python's re, and odd texts."""

import re

import pytest

from inkstream.llm.pii import IBAN_LENGTHS, KINDS, NEAR, pii_spans

from .conftest import texts

CARD = "4539 1488 0343 6467"
CASES = [
    ("write to a.b+c@mail.example.com or x@y", {"email": ["a.b+c@mail.example.com"]}),
    ("a@b.c@d.e and a@b.c_x@d.e.", {"email": ["a@b.c", "a@b.c", "_x@d.e"]}),
    ("1.2.3.4.5 256.1.1.1 0255.000001.1.1 1.2.3 1.2.3.x9.9.9.9", {"ip": ["1.2.3.4", "0255.000001.1.1", "9.9.9.9"]}),
    (f"{CARD}; 4539148803436468; 1-2-3; {CARD.replace(' ', '-')}", {"card": [CARD, CARD.replace(" ", "-")]}),
    ("+1 (888) 555-6841. +12 +1234567 and +1 234 5678 90", {"phone": ["+1 (888) 555-6841", "+1 234 5678 90"]}),
    ("iban GB82 WEST 1234 5698 7654 32 AND GB82WEST12345698765433 XDE89370400440532013000 DE89370400440532013000", {"iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]}),
    ("ssn 123-45-6789, 000-12-3456, 123-00-6789", {"ssn": ["123-45-6789"]}),
    ("the number 123-45-6789 alone", {}),
    ("call (555) 123-4567 or fax 555.123.4567; +1 (555) 123-4567", {"local": ["(555) 123-4567", "555.123.4567"], "phone": ["+1 (555) 123-4567"]}),
    ("a number: 555 123 4567", {}),
    ('x token = "99168226c4d3cee7e9938118ec" password: hunterhunterhunter', {"secret": ["99168226c4d3cee7e9938118ec"]}),
    ("日本 é\U0001f600 q@r.st \x01 u@v.w", {"email": ["q@r.st", "u@v.w"]}),
    (None, {}),
    ("", {}),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "k") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in pii_spans(df).collect()}
    for i, (text, want) in enumerate(CASES):
        found = {}
        for s in got[i]:
            found.setdefault(s.kind, []).append(text[s.start : s.end])
        assert found == want, text


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _plain(text):
    out = []
    for k in [k for k in KINDS if k.base]:
        for m in re.finditer(k.plain, text):
            x = m[0]
            d = re.sub("[^0-9]", "", x)
            ok = {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if k.name == "ip" else 0, "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[k.name]
            if ok:
                out.append((k.name, *m.span()))
    return out


def test_base_kinds_as_plain_patterns_find_them(spark):
    import random

    r = random.Random(3)
    bits = ["a", "b@", "@", ".c", ".", "-", " ", "+1", "1.2", "255", ".7", "4539148803436467", " 0", "(5)", "é", "+", "mail@x.y", "0" * 30, "\U0001f600", "_", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(400)] + list(enumerate(texts(), 400))
    rows += [(900, "a" * 3_000), (901, "1 " * 100_000), (902, "1" * 150_000), (903, "a@b.c " * 20_000), (904, "+1" + "(" * 100_000), (905, "1." * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pii_spans(df).selectExpr("doc_id", "filter(spans, s -> s.base) AS spans").collect()
    assert len(got) == len(rows)
    texts_ = dict(rows)
    for row in got:
        assert [(s.kind, s.start, s.end) for s in row.spans] == _plain(texts_[row.doc_id] or ""), row.doc_id


def test_long_runs_take_no_square_of_their_length(spark):
    df = spark.createDataFrame([(1, "a" * 400_000), (2, "1" * 400_000 + "@")], "doc_id long, text string")
    assert [list(r.spans) for r in pii_spans(df).collect()] == [[], []]


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "x")], "doc_id long, text string")
    assert sorted(len(r.spans) for r in pii_spans(df).collect()) == [0, 1, 1]
    assert pii_spans(df.limit(0)).collect() == []
    plan = pii_spans(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("near", [0, NEAR])
def test_words_nearby_raise_the_score(spark, near):
    df = spark.createDataFrame([(1, "iban: DE89370400440532013000"), (2, "x DE89370400440532013000")], "doc_id long, text string")
    got = {r.doc_id: r.spans[0].score for r in pii_spans(df, near=near).collect()}
    assert got[2] == 0.7 and got[1] == (1.0 if near else 0.7)
    assert all(15 <= n <= 34 for n in IBAN_LENGTHS.values())
