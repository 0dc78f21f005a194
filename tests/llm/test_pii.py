import random
import time
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import pii
from tidemill.llm.pii import DEMO_KEY, KINDS, Permuter, find, iban_remainder, luhn_digit, op4_pii, pseudonymize, pseudonymize_text, reveal

TEXT = 'a card 4111 1111 1111 1111, +1 (487) 555-7209 and (212) 555-1234; 078-05-1120 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 97.51.17.173 on 2020-02-29, 31/12/1999 or 1.2.1999: und.34@mail7.example.com token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 5000])
def test_permutations(size):
    p, back = Permuter(b"k"), Permuter(b"k", forward=False)
    moved = [p(i, size, "x") for i in range(size)]
    assert sorted(moved) == list(range(size)) and [back(m, size, "x") for m in moved] == list(range(size))


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**30 - 1), st.binary(max_size=8))
def test_large_permutations(value, key):
    moved = Permuter(key)(value, 10**30, "x")
    assert 0 <= moved < 10**30 and Permuter(key, forward=False)(moved, 10**30, "x") == value


def test_every_kind_is_found_valid_and_reversible():
    new, spans = pseudonymize_text(TEXT, b"key")
    assert [s[2] for s in spans] == ["card", "phone", "phone", "ssn", "iban", "iban", "ip", "date", "date", "date", "email", "secret"]
    assert reveal(new, b"key") == TEXT and new != TEXT and len(find(new, Permuter(b"key"))) == len(spans)
    for start, end, kind, pseudonym in spans:
        old = TEXT[start:end]
        assert old not in new
        digits = "".join(c for c in pseudonym if c.isdigit())
        if kind == "card":
            assert luhn_digit(digits[:-1]) == digits[-1] and [c.isdigit() for c in old] == [c.isdigit() for c in pseudonym]
        if kind == "iban":
            assert iban_remainder(pseudonym.replace(" ", "")) == 1 and pseudonym[:2] == old[:2]
        if kind in ("phone", "ssn"):
            assert [c.isdigit() for c in old] == [c.isdigit() for c in pseudonym]
    assert pseudonymize_text(TEXT, b"other")[0] != new


def test_equal_values_stay_linked():
    a = pseudonymize_text("call +1 (487) 555-7209 or mail A.Bc@x.org", DEMO_KEY)[1]
    b = pseudonymize_text("+1 487 555 7209 / +14875557209; a.bC@x.org", DEMO_KEY)[1]
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(a[0][3]) == digits(b[0][3]) == digits(b[1][3]) and a[1][3].lower() == b[2][3].lower()
    iso, slashed = pseudonymize_text("2020-02-29 29/02/2020", DEMO_KEY)[1]
    assert iso[3].split("-") == slashed[3].split("/")[::-1]


@pytest.mark.parametrize("number", ["+33 1 23 45 67 89", "+44 20 7946 0958", "+49 (30) 901820", "+1-487-555-7209", "(487) 555-7209", "487.555.7209", "+14875557209"])
def test_phones(number):
    text = f"call {number}, or not"
    new, spans = pseudonymize_text(text, DEMO_KEY)
    assert [(s[0], s[1], s[2]) for s in spans] == [(5, 5 + len(number), "phone")] and reveal(new, DEMO_KEY) == text and number not in new


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "1234567890123456", "GB82 WEST 1234 5698 7654 33", "000-12-3456", "256.1.1.1", "2021-13-01", "31.02.2020", "Version 2.0.", "v1.2.3.4.5", "a @ b", "0000000000000000", "12345", "token of thanks = mine"])
def test_what_is_not_valid_stays(text):
    assert pseudonymize_text(text, DEMO_KEY) == (text, [])


def test_documents(spark, docs, odd, empty):
    for df in (docs, odd):
        old = sorted((r.text or "" for r in df.collect()))
        rows = op4_pii(df).collect()
        assert sorted(reveal(r.text or "", DEMO_KEY) for r in rows) == old
        assert all(r.n_values == sum(r[f"n_{k}"] for k in KINDS) for r in rows)
        assert {r.text for r in rows if r.n_values == 0} <= {r.text for r in df.collect()}
    assert op4_pii(empty).count() == 0
    clash = pseudonymize(odd.withColumn("PII", F.lit(1)).withColumn("note", F.lit("x")), DEMO_KEY)
    assert clash.columns == [*odd.columns, "note", "pii"] and clash.where("text is null").count() == 2


@pytest.mark.parametrize("n", [16, 64, 65, 320, 400, 10_000, 200_000])
@pytest.mark.parametrize("alphabet", ["0123456789abcdef", "0123456789ABCDEF", "abcXYZ0123456789", "ab-_/+9"])
def test_long_secrets(n, alphabet):
    rng = random.Random(n)
    value = "".join(rng.choice(alphabet) for _ in range(n - 2)) + ("a9" if "a" in alphabet else "A9")
    text = f"token={value} and the same token={value}"
    new, spans = pseudonymize_text(text, b"k")
    assert [s[2] for s in spans] == ["secret"] * 2 and spans[0][3] == spans[1][3] and len(new) == len(text) and value not in new and reveal(new, b"k") == text
    assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(text, new, strict=True)) or set(value) <= set("0123456789abcdef") or set(value) <= set("0123456789ABCDEF")


@pytest.mark.parametrize("n", [3, 64, 65, 480, 10_000])
def test_long_emails(n):
    local = ("ab1." * n)[: n - 1] + "z"
    text = f"to {local}@mail.example.com, {local.upper()}@mail.example.com."
    new, spans = pseudonymize_text(text, b"k")
    assert [s[2] for s in spans] == ["email"] * 2 and spans[0][3].lower() == spans[1][3].lower() and reveal(new, b"k") == text and local not in new


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([2, 10, 16, 26, 31])), min_size=1, max_size=90), st.binary(max_size=8))
def test_permutations_of_sequences(pairs, key):
    values, radices = [v % r for v, r in pairs], [r for _, r in pairs]
    moved = Permuter(key).many(values, radices, "x")
    assert all(0 <= m < r for m, r in zip(moved, radices, strict=True)) and Permuter(key, forward=False).many(moved, radices, "x") == values


def test_many_values_in_one_text():
    rng = random.Random(9)
    text = "\n".join(f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} 2020-02-{i % 28 + 1:02d} a{i}@b.org" for i in range(34_000))
    began = time.process_time()
    new, spans = pseudonymize_text(text, b"k")
    assert len(spans) == 102_000 and time.process_time() - began < 60
    assert [a for a, *_ in spans] == sorted(a for a, *_ in spans) and all(b <= c for (_, b, *_), (c, *_) in zip(spans, spans[1:]))
    short = "\n".join(text.split("\n")[:300])
    assert reveal(pseudonymize_text(short, b"k")[0], b"k") == short


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute(text):
    """Cards, SSNs, addresses and dates, by trying every stretch of digits and marks that stands alone; no pattern is used."""
    found = set()
    digit = lambda i: 0 <= i < len(text) and text[i] in "0123456789"
    mark = lambda i, chars: 0 <= i < len(text) and text[i] in chars
    for a in range(len(text)):
        if not digit(a) or digit(a - 1):
            continue
        for b in range(a + 7, min(len(text), a + 24) + 1):
            if not digit(b - 1) or digit(b):
                continue
            s = text[a:b]
            shape = "".join("9" if c in "0123456789" else c for c in s)
            if shape.strip("9") == "" and 13 <= len(s) <= 19 or shape in ("9999 9999 9999 9999", "9999-9999-9999-9999", "9999 999999 99999", "9999-999999-99999"):
                digits = "".join(c for c in s if c in "0123456789")
                if not (digit(a - 2) and mark(a - 1, ".,-")) and not (mark(b, ".,-") and digit(b + 1)) and luhn(digits) and len(set(digits)) > 1:
                    found.add((a, b, "card"))
            if shape == "999-99-9999" and not mark(a - 1, "-") and not mark(b, "-"):
                if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
                    found.add((a, b, "ssn"))
            if shape.count(".") == 3 and set(shape) <= {"9", "."} and not mark(a - 1, ".") and not (mark(b, ".") and digit(b + 1)):
                if all(p and str(int(p)) == p and int(p) <= 255 for p in s.split(".")):
                    found.add((a, b, "ip"))
            if not mark(a - 1, "/.-") and not mark(b, "/-"):
                for sep in "-/.":
                    parts = s.split(sep)
                    if len(parts) == 3 and all(p and set(p) <= set("0123456789") for p in parts):
                        if sep == "-" and [len(p) for p in parts] == [4, 2, 2]:
                            orders = [(0, 1, 2)]
                        elif sep != "-" and len(parts[2]) == 4 and all(len(p) <= 2 for p in parts[:2]):
                            orders = [(2, 1, 0), (2, 0, 1)]
                        else:
                            continue
                        for y, m, d in orders:
                            try:
                                if 1900 <= date(int(parts[y]), int(parts[m]), int(parts[d])).year <= 2099:
                                    found.add((a, b, "date"))
                            except ValueError:
                                pass
    return found


def test_against_brute_force(docs, odd):
    n = 0
    for df in (docs, odd):
        for r in df.collect():
            spans = pseudonymize_text(r.text or "", b"k")[1]
            others = [(a, b) for a, b, kind, _ in spans if kind in ("secret", "email", "iban", "phone")]
            want = {s for s in brute(r.text or "") if not any(s[0] < b and a < s[1] for a, b in others)}
            assert {(a, b, kind) for a, b, kind, _ in spans if kind in ("card", "ssn", "ip", "date")} == want
            n += len(want)
    assert n > 10


def test_the_key_is_needed(docs):
    with pytest.raises(TypeError):
        pseudonymize(docs)
    assert pii.op4_pii(docs, b"one").collect() != pii.op4_pii(docs, b"two").collect()
