import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raresift.llm import pii

NAMES = pii.Pseudonyms(b"test")
VALID = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005"],
    "phone": ["+1 (389) 555-5010", "+1-389-555-5010", "+49 30 1234 5678", "+442071838750"],
    "local": ["(389) 555-5010", "389-555-5010"], "ip": ["97.51.17.173", "255.255.255.255"], "ssn": ["078-05-1120"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "iso": ["2024-02-29", "1999-12-31"],
    "day": ["29.02.2024", "2/29/2024", "31/12/1999", "1.2.2003"], "email": ["und.34@mail7.example.com", "A.B+c@Example.org"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
}
INVALID = ["4111111111111112", "9807915762804490", "300.1.2.3", "01.2.3.4", "000-12-3456", "666-12-3456", "912-34-5678", "2024-02-30", "32.01.2000",
           "13/13/2000", "GB82 WEST 1234 5698 7654 33", "1.2.3", "12345678", "someone@nowhere", "0000000000000000", "1850-01-01"]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4099])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k")
    image = [f.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and [f.permute(y, n, "t", back=True) for y in image] == list(range(n))
    if n > 90:
        assert image != [pii.Feistel(b"l").permute(x, n, "t") for x in range(n)] != [f.permute(x, n, "u") for x in range(n)]


@given(st.integers(0, 10**40 - 1))
@settings(max_examples=50, deadline=None)
def test_feistel_of_large_numbers(x):
    f = pii.Feistel(b"k")
    assert f.permute(f.permute(x, 10**40, "t"), 10**40, "t", back=True) == x


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALID.items() for v in vs])
def test_valid_values_keep_their_format(kind, value):
    text = f"before token = {value} after" if kind == "secret" else f"before {value} after"
    new, n = pii.replace(text, NAMES)
    assert n == 1 and value not in new and new.startswith("before ") and new.endswith(" after")
    got = new[len(text) - len(value) - len(" after"):-len(" after")]
    assert pii.replace(text.replace(value, got), NAMES)[1] == 1  # the pseudonym is valid, too
    if kind not in ("ip", "day"):
        assert re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", got))) == re.sub(
            r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value))) or kind in ("secret",)
    if kind == "card":
        digits = re.sub(r"\D", "", got)
        assert pii.luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iso":
        assert date.fromisoformat(got)


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert pii.replace(f"x {value} y", NAMES) == (f"x {value} y", 0)


def test_equal_values_stay_linked():
    of = lambda t: pii.replace(t, NAMES)[0]
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(of("4111111111111111")) == digits(of("4111 1111 1111 1111")) == digits(of("4111-1111-1111-1111"))
    assert digits(of("+1 (389) 555-5010")) == digits(of("+1-389-555-5010")) == "1" + digits(of("389-555-5010"))
    assert of("A@B.org").lower() == of("a@b.org")
    assert of("x@mail.org").split("@")[1] == of("yy@mail.org").split("@")[1]
    y, m, d = of("2024-02-29").split("-")
    assert of("29.02.2024") == f"{d}.{m}.{y}"
    assert of("97.51.17.173") != pii.replace("97.51.17.173", pii.Pseudonyms(b"other"))[0]


def test_permuted_within_the_format():
    """Different values stay different."""
    days = [date.fromordinal(date(2000, 1, 1).toordinal() + i).isoformat() for i in range(800)]
    assert len({pii.replace(d, NAMES)[0] for d in days}) == 800
    numbers = [f"{i:03d}-45-6789" for i in range(1, 666)]
    assert len({pii.replace(x, NAMES)[0] for x in numbers}) == 665


def test_neighbours_and_overlaps():
    text = "+1 (017) 555-7713 4111111111111111 97.51.17.173,und.34@mail7.example.com!! 1188 4111111111111111 *** 4111111111111111$$$"
    new, n = pii.replace(text, NAMES)
    assert n == 6 and "4111111111111111" not in new and "555-7713" not in new and "1188" in new


def test_table(spark):
    rows = [(1, None, "a", 3), (2, "", "b", 3), (3, "mail a.b@c.org", None, None), (3, "mail a.b@c.org", None, None), (None, "x " * 300_000 + "4111111111111111", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_2 string, n_replaced int")
    got = pii.pseudonymise(df, b"test")
    assert got.schema == df.schema
    out = got.collect()
    assert len(out) == 5 and {r.text for r in out if r.doc_id == 1} == {None} and {r.text for r in out if r.doc_id == 2} == {""}
    assert {r.text for r in out if r.doc_id == 3} == {pii.replace("mail a.b@c.org", NAMES)[0]}
    counted = pii.pseudonymise(df, b"test", count_col="n_replaced")
    assert sorted((r.doc_id or 0, r.n_replaced) for r in counted.collect()) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert pii.pseudonymise(df.limit(0), b"test").collect() == []


@pytest.mark.parametrize("value", ["+49 170 1234567", "+49 30 901820", "+44 7911 123456", "+33 6 12 34 56 78", "+33\u00a06\u00a012\u00a034\u00a056\u00a078",
                                   "+49 (0)170/123 45 67", "+358-9-123456", "+7(495)123.45.67", "+1/389/555/5010", "+1 389 5555010"])
def test_usual_phone_forms(value):
    new, n = pii.replace(f"call {value}, then go", NAMES)
    assert n == 1 and value not in new and new.startswith("call +") and new.endswith(", then go")
    digits = re.sub(r"\D", "", new)
    assert pii.replace(f"call +{re.sub(r'\D', '', value)}, then go", NAMES)[0] == f"call +{digits}, then go"
    assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", f"call {value}, then go")


@pytest.mark.parametrize("after", ["97.51.17.173", "29.02.2024", "2024-02-29", "078-05-1120", "(389) 555-5010", "4111 1111 1111 1111", "4111111111111111", "+44 7911 123456"])
def test_a_phone_number_ends_before_the_next_value(after):
    alone = [pii.replace(v, NAMES)[0] for v in ("+49 30 901820", after)]
    assert pii.replace(f"+49 30 901820 {after}", NAMES) == (" ".join(alone), 2)


@pytest.mark.parametrize("value", ["+12 34 56", "+1 234 567", "+49 30 901820 1234 5678 901234", "+12345678901234567", "2 + 2 = 4, +49"])
def test_no_phone_numbers(value):
    new, n = pii.replace(f"x {value} y", NAMES)
    assert n == ("901820" in value) and (n or new == f"x {value} y")


IBANS = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "AT611904300234573201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]


@pytest.mark.parametrize("value", IBANS)
@pytest.mark.parametrize("after", ["EUR", "BIC", "100 Euro", "EURO 12", "2024 1234 5678 9012 3456", "Bank", "AT61 1904 3002 3457 3201"])
def test_account_numbers_end_before_the_next_word(value, after):
    alone = pii.replace(value, NAMES)[0]
    new, n = pii.replace(f"to {value} {after} now", NAMES)
    last, m = pii.replace(after, NAMES)
    assert alone != value and (new, n) == (f"to {alone} {last} now", 1 + m)


def test_account_numbers_behind_and_without_a_fixed_length():
    value = "AT61 1904 3002 3457 3201"
    assert pii.replace(f"REF AB12 1234 5678 {value} EUR", NAMES)[0] == f"REF AB12 1234 5678 {pii.replace(value, NAMES)[0]} EUR"
    plain = "ZZ" + pii._iban_check("ZZ", "1234567890123456") + "1234567890123456"
    assert pii.replace(f"{plain} EURO 1", NAMES) == (pii.replace(plain, NAMES)[0] + " EURO 1", 1)
    assert pii.replace("AT61 1904 3002 3457 3202 EUR", NAMES)[1] == 0
