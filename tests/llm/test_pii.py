import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallow.llm import pii

OWN = pii.Pseudonyms(b"key")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 73049])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k", "x", n)
    out = [f.forward(i) for i in range(n)]
    assert sorted(out) == list(range(n)) and [f.inverse(v) for v in out] == list(range(n))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 10**30), st.data())
def test_feistel_inverts(n, data):
    v = data.draw(st.integers(0, n - 1))
    f = pii.Feistel(b"k", "x", n)
    assert 0 <= f.forward(v) < n and f.inverse(f.forward(v)) == v


def test_formats_stay_valid():
    text = "4111 1111 1111 1111; +1 (017) 555-7713, ann.5@mail7.example.com; 233.254.104.120. GB82 WEST 1234 5698 7654 32 078-05-1120 2024-02-29 31.12.1999"
    out, spans = OWN.apply(text)
    assert [k for k, _, _ in spans] == ["card", "phone", "email", "ip", "iban", "ssn", "date", "date"]
    assert re.sub(r"[0-9]", "9", re.sub(r"(?<=GB\d\d )[A-Z ]{5}", "", out.split("; ")[0])) == "9999 9999 9999 9999"
    card = re.sub(r"\D", "", out.split(";")[0])
    assert pii.luhn_digit(card[:-1]) == card[-1] and card != "4111111111111111"
    iban = re.search(r"GB[0-9A-Z ]+(?= \d{3}-)", out)[0].replace(" ", "")
    assert pii.iban_check(iban[:2], iban[4:]) == iban[2:4]
    dt.date.fromisoformat(re.search(r"\d{4}-\d{2}-\d{2}", out)[0])
    assert all(int(x) < 256 for x in re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", out).groups())
    assert "@mail7.example.com" in out and "ann.5" not in out and "+1 (" in out


def test_equal_values_stay_linked_and_keys_differ():
    a, b = OWN.apply("x 9807915762804490 y")[0], OWN.apply("z 9807915762804490!")[0]
    assert re.search(r"\d{16}", a)[0] == re.search(r"\d{16}", b)[0] != "9807915762804490"
    assert pii.Pseudonyms(b"other").apply("x 9807915762804490 y")[0] != a
    assert OWN.apply("4111-1111-1111-1111")[0].replace("-", "") == OWN.apply("4111111111111111")[0]


@pytest.mark.parametrize("text", ["v4.0.", "1.2.3.4.5", "300.1.1.1", "2024-02-30", "32.01.2000", "999-00-1234", "no. 12345", "GB00 WEST 1234 5698 7654 32", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "me@host", "0000000000000000"])
def test_left_alone(text):
    assert OWN.apply(text) == (text, [])


def test_strict_cards():
    assert pii.luhn_digit("980791576280449") != "1"  # an account number, no card
    assert pii.Pseudonyms(b"key", strict_cards=True).apply("9807915762804491") == ("9807915762804491", [])
    assert OWN.apply("9807915762804491")[1] == [("card", 0, 16)]


def test_table(spark):
    rows = [(1, "call +1 (017) 555-7713", 5), (1, "call +1 (017) 555-7713", 5), (2, None, 6), (3, "", 7), (None, "plain " * 50_000 + "a@b.example", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_email long")
    got = pii.pseudonymise(docs).collect()
    assert len(got) == 5 and {r.text for r in got if r.doc_id == 2} == {None}
    assert [r.pii_phone for r in got if r.doc_id == 1] == [1, 1] and [r.pii_email for r in got if r.doc_id is None] == [1]
    assert len({r.text for r in got if r.doc_id == 1}) == 1 and "7713" not in got[0].text
    plain = pii.pseudonymise(docs, counts=False)
    assert plain.columns == docs.columns and sorted(r.pii_email for r in plain.collect()) == [5, 5, 6, 7, 8]
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_no_value_is_its_own_pseudonym():
    assert sorted(OWN.permute("t", v, 1000) for v in range(1000)) == list(range(1000))
    assert all(OWN.permute("t", v, 1000) != v for v in range(1000))
    emails = [f"{a}{b}@x.example" for a in "abcdefghij" for b in range(10)]
    assert not set(zip(emails, emails, strict=True)) & {(e, OWN.replace("email", e)) for e in emails}
    assert len({OWN.replace("email", e) for e in emails}) == len(emails)


CARD, ACCOUNT, IBAN = "4111 1111 1111 1111", "9807915762804491", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize(
    ("kind", "value", "text"),
    [
        ("card", CARD, f"{CARD} 12/25"),
        ("card", CARD, f"{CARD} 123 and more"),
        ("card", CARD, f"no. 12 {CARD}"),
        ("card", CARD, f"12 {CARD} 9"),
        ("card", CARD, f"1234 {CARD} 1234"),
        ("card", "4111-1111-1111-1111", "4111-1111-1111-1111 123"),
        ("card", "4111111111111111", "12 4111111111111111"),
        ("card", "4111111111111111", "4111111111111111-123"),
        ("card", "4111111111111111", "7-4111111111111111"),
        ("card", "3782 822463 10005", "3782 822463 10005 12/25"),
        ("card", CARD, f"+1 {CARD}"),
        ("card", ACCOUNT, f"{ACCOUNT} 13"),
        ("iban", IBAN, f"{IBAN} BIC"),
        ("iban", IBAN, f"{IBAN} 1234 EUR"),
        ("iban", IBAN, f"AB12 {IBAN} BIC"),
        ("iban", "GB82WEST12345698765432", "GB82WEST12345698765432 BIC"),
        ("ssn", "078-05-1120", "1 078-05-1120 123"),
        ("phone", "+44 20 7946 0958", "+44 20 7946 0958 2024 1234"),
    ],
)
def test_numbers_beside_a_value(kind, value, text):
    out, spans = OWN.apply(text)
    new = OWN.replace(kind, value)
    at = text.index(value)
    if kind == "phone":  # what follows up to 15 digits can't be told from the number
        assert len(spans) == 1 and spans[0][:2] == (kind, at) and value not in out
    else:
        assert (kind, at, at + len(value)) in spans and out == text.replace(value, new) and value not in out


def test_number_tables_end():
    text = "12 3 " * 20_000
    out, spans = OWN.apply(text)
    assert len(out) == len(text) and all(a < b <= c for (_, a, b), (_, c, _) in zip(spans, spans[1:], strict=False))


def plain_order(key, label, n):
    """0 .. n - 1 in the network's order, from the definition: eight rounds of (a, b) -> (b, a xor F(b)) on halves."""
    import hashlib

    bits = max(2, (n - 1).bit_length() + (n - 1).bit_length() % 2)
    half = bits // 2

    def once(v):
        a, b = divmod(v, 2**half)
        for r in range(8):
            own = hashlib.blake2b(f"{label}:{n}:{r}".encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
            f = int.from_bytes(hashlib.blake2b(b.to_bytes(16, "little"), key=own, digest_size=16).digest(), "little") % 2**half
            a, b = b, a ^ f
        return a * 2**half + b

    def place(v):
        v = once(v)
        while v >= n:
            v = once(v)
        return v

    return sorted(range(n), key=place)


@pytest.mark.parametrize(("label", "n"), [("x", 2), ("email@y.z9", 10), ("phone12", 100), ("t", 1000)])
def test_equals_the_plain_network(label, n):
    order = plain_order(b"key", label, n)
    want = {v: order[(i + 1) % n] for i, v in enumerate(order)}
    assert {v: OWN.permute(label, v, n) for v in range(n)} == want


def test_values_in_texts_equal_brute_force():
    """Digits of three-digit runs in e-mails, by the plain network, put into texts at known places."""
    order = plain_order(b"key", "email@a.example3", 1000)
    after = {v: order[(i + 1) % 1000] for i, v in enumerate(order)}
    for i in range(0, 1000, 37):
        text = f"write to {i:03d}@a.example, or {(i * 7) % 1000:03d}@A.example; not 17 or {i}."
        want = f"write to {after[i]:03d}@a.example, or {after[i * 7 % 1000]:03d}@A.example; not 17 or {i}."
        assert OWN.apply(text)[0] == want


@pytest.mark.parametrize("value", ["12/25/1990", "1/5/2020", "9.9.1999", "31.12.1999", "01/05/2020", "1/25/2020", "10/9/2001", "3.11.1950", "2/29/2024"])
def test_dates_keep_their_format(value):
    out, spans = OWN.apply(f"on {value} at")
    new = out[3:-3]
    assert [k for k, _, _ in spans] == ["date"] and new != value
    assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", value)

    def reading(v):
        a, b, y = map(int, re.split(r"[/.]", v))
        try:
            return "day", dt.date(y, b, a)
        except ValueError:
            return "month", dt.date(y, a, b)

    assert reading(new)[0] == reading(value)[0]


def test_dates_of_one_format_map_one_to_one():
    days = [dt.date(1990, 1, 1) + dt.timedelta(i) for i in range(1500)]
    texts = {f"{d.day}/{d.month}/{d.year}" for d in days} | {f"{d.month}/{d.day}/{d.year}" for d in days if d.day > 12} | {f"{d.day:02d}/{d.month:02d}/{d.year}" for d in days}
    assert len({OWN.replace("date", t) for t in texts}) == len(texts)


def test_networks_are_bounded(monkeypatch):
    monkeypatch.setattr(pii, "CACHE_NETWORKS", 50)
    own = pii.Pseudonyms(b"key")
    first = own.replace("email", "ann7@d0.example")
    for i in range(300):
        own.replace("email", f"ann7@d{i}.example")
    assert len(own._feistel) <= 50 and pii.Pseudonyms(b"key").replace("email", "ann7@d0.example") == first


def test_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "mail bob.77@x.example")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="public test key"):
        public = pii.pseudonymise(docs, counts=False).first().text
    assert public == pii.pseudonymise(docs, pii.TEST_KEY, counts=False).first().text
    spark.conf.set("spark.tallow.pii.key", "secret")
    try:
        assert pii.pseudonymise(docs, counts=False).first().text == pii.pseudonymise(docs, b"secret", counts=False).first().text != public
    finally:
        spark.conf.unset("spark.tallow.pii.key")
