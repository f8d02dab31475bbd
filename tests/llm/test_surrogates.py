"""Numbers beside other numbers."""

import pytest

from weft.llm.surrogates import find

CARD, PHONE, IP = "4111111111111111", "+1 (826) 555-4081", "190.137.223.204"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"call {PHONE} {IP} now", {("phone", PHONE), ("ip", IP)}),
        (f"{IP} {PHONE}", {("phone", PHONE), ("ip", IP)}),
        (f"{PHONE} 2024 items", {("phone", PHONE)}),
        (f"+44 20 7946 0958 {IP}", {("phone", "+44 20 7946 0958"), ("ip", IP)}),
        (f"card {CARD} 123 x", {("card", CARD)}),
        (f"card {CARD} 7 x", {("card", CARD)}),
        (f"12 {CARD}", {("card", CARD)}),
        ("4605 8043 2775 0358 123", {("card", "4605 8043 2775 0358")}),
        ("12 34 4605 8043 2775 0358", {("card", "4605 8043 2775 0358")}),
        (f"{CARD} 4605 8043 2775 0358", {("card", CARD), ("card", "4605 8043 2775 0358")}),
        (f"{CARD} {PHONE}", {("card", CARD), ("phone", PHONE)}),
        (f"123-45-6789 {CARD}", {("ssn", "123-45-6789"), ("card", CARD)}),
        ("DE89 3704 0044 0532 0130 00 and GB33BUKB20201555555555 2024", {("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB33BUKB20201555555555")}),
        ("3782 822463 10005", {("card", "3782 822463 10005")}),
        (f"{CARD[:-1]}2 123 x", set()),
        ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", set()),
    ],
)
def test_neighbouring_numbers(text, want):
    assert {(kind, text[a:z]) for a, z, kind, _ in find(text)} == want


def test_a_long_run_of_numbers_ends():
    text = " ".join(str(i) for i in range(200_000))
    assert all(kind in ("card", "phone") for _, _, kind, _ in find(text))


def names(text):
    return {text[a:z] for a, z, kind, _ in find(text) if kind.startswith(("given", "surname"))}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. John Smith spoke. Later Smith left, and John waved. Contact John Smith.", {"John", "Smith"}),
        ("Then Sarah Johnson's car. JOHNSON said no; Johnson-led; a johnson", {"Sarah", "Johnson", "JOHNSON"}),
        ("Иван Петров пришёл. Петров ушёл.", {"Иван", "Петров"}),
        ("Dr Xu Wei spoke to Wei", {"Xu", "Wei"}),
        ("Mary O'Brien and O'Brien's", {"Mary", "O'Brien"}),
        ("Smith left and John waved", set()),
        ("The Brown fox and John the cook", set()),
    ],
)
def test_names_and_their_mentions(text, want):
    assert names(text) == want
    for name in want:
        places = {(a, z) for a, z, *_ in find(text)}
        assert all((i, i + len(name)) in places for i in range(len(text)) if text.startswith(name, i) and not text[i - 1 : i].isalpha() and not text[i + len(name) : i + len(name) + 1].isalpha())


@pytest.mark.parametrize("phone", ["555.123.4567", "212 555 0187", "1-555-123-4567", "(212) 555-0187", "212-555-0187"])
def test_phone_layouts(phone):
    assert [(k, f"call {phone}."[a:z]) for a, z, k, _ in find(f"call {phone}.")] == [("phone", phone)]


def test_time_grows_with_the_text():
    import time

    text = "".join(f"user{i}@host{i % 977}.example.org 10.{i % 251}.{i % 241}.{i % 239} " for i in range(100_000)) + "Mr. John Smith and Smith " * 20_000
    began = time.perf_counter()
    found = find(text)
    assert len(found) == 200_000 + 60_000 and time.perf_counter() - began < 20


def test_no_key_no_surrogates(spark, odd):
    from weft.llm import pii

    with pytest.raises(ValueError, match="secret key"):
        pii.replace(odd)


def test_odd_rows(odd):
    from weft.llm import pii

    want = sorted((str(r.doc_id), str(r.text)) for r in odd.collect())
    got = sorted((str(r.doc_id), str(r.text)) for r in pii.op9(odd, b"k").collect())
    assert got == want and pii.op9(odd.limit(0), b"k").count() == 0
    assert pii.replace(odd, key=b"k").columns == odd.columns


def replaced(rows, key):
    """By a plain loop: surrogates drawn in rounds until all differ, then put in place."""
    from weft.llm.surrogates import render, surrogate

    real = {x[2:] for r in rows for x in find(r.text)}
    settled, pending, attempt = {}, set(real), 0
    while pending:
        drawn = {e: surrogate(key, *e, attempt) for e in pending}
        used = {(kind, new) for (kind, _), (new, _) in settled.items()}
        for e in sorted(pending):
            if (e[0], drawn[e]) not in real and (e[0], drawn[e]) not in used:
                used.add((e[0], drawn[e]))
                settled[e] = drawn[e], attempt
        pending, attempt = pending - settled.keys(), attempt + 1
    out = {}
    for r in rows:
        text = r.text
        for a, z, kind, value in reversed(find(r.text)):
            text = text[:a] + render(text[a:z], kind, settled[kind, value][0]) + text[z:]
        out[r.doc_id] = text
    return out


def test_rows_equal_brute_force(spark):
    from weft.llm import pii

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(-1, "Mr. John Smith and Mary Smith; Peter met John. a@b.example, A@B.EXAMPLE"), (-2, "Smith Mary Jones 10.0.0.1 +1 (376) 555-2305")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    assert {r.doc_id: r.text for r in pii.op9(docs, b"k").collect()} == replaced(docs.collect(), b"k")
