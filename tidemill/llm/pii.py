"""Format-preserving pseudonyms for personal data.

Each kind of value is validated, numbered within its format's domain, and moved by a keyed Feistel permutation of that
domain: equal values get equal pseudonyms in every document, different ones of a kind get different ones, and the pseudonym is
again a valid value of the same format. With the key, ``reveal`` gives the value back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import extended, slices, without

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
#: Of the registered query and of tests, where ``spark.tidemill.pii.key`` is unset. Not a default of the library: who knows the key can reverse it.
DEMO_KEY = b"not a secret"
ROUNDS = 10
#: Characters of a value that is moved as one number; a longer one is moved character by character, in time that grows with its length.
MOST_AS_NUMBER = 64
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Permuter:
    """A keyed permutation of a format's values: a Feistel network with a keyed hash as its round function."""

    def __init__(self, key: bytes, forward: bool = True):
        self.key, self.forward = hashlib.blake2b(key, digest_size=32).digest(), forward

    def _noise(self, said: bytes, n: int) -> bytes:
        """``n`` bytes that the key and ``said`` decide; beyond one digest's 64 by counting."""
        if n <= 64:
            return b"" if not n else hashlib.blake2b(said, key=self.key, digest_size=n).digest()
        seed = hashlib.blake2b(said, key=self.key, digest_size=64).digest()
        return b"".join(hashlib.blake2b(seed + i.to_bytes(8, "big"), key=self.key, digest_size=64).digest() for i in range(-(-n // 64)))[:n]

    def __call__(self, value: int, size: int, kind: str) -> int:
        """A permutation of 0 to ``size - 1`` for each kind and size, of numbers of some hundred bits at most: balanced on the next even number of
        bits, walked until the result is within the domain."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, half // 8 + 1
        while True:
            left, right = value >> half, value & mask
            for i in range(ROUNDS) if self.forward else reversed(range(ROUNDS)):
                said = b"%s|%d|%d|%d" % (kind.encode(), size, i, right if self.forward else left)
                noise = int.from_bytes(self._noise(said, max(8, width)), "big") & mask
                left, right = (right, left ^ noise) if self.forward else (right ^ noise, left)
            value = left << half | right
            if value < size:
                return value

    def many(self, values: list[int], radices: list[int], kind: str) -> list[int]:
        """A permutation of the sequences of numbers below their ``radices``, for each kind and radices: the halves in turn are
        moved on by what the other half decides, each number within its radix."""
        at = len(values) // 2
        radix = np.array(radices, np.uint64)
        halves, radix_of = [np.array(values[:at], np.uint64), np.array(values[at:], np.uint64)], (radix[:at], radix[at:])
        tweak = hashlib.blake2b(b"%s|%s" % (kind.encode(), radix.tobytes()), key=self.key, digest_size=32).digest()
        for i in range(ROUNDS) if self.forward else reversed(range(ROUNDS)):
            moved, by = i % 2, halves[1 - i % 2]
            noise = np.frombuffer(self._noise(b"%d|" % i + tweak + by.tobytes(), 8 * len(halves[moved])), "<u8") % radix_of[moved]
            halves[moved] = (halves[moved] + (noise if self.forward else radix_of[moved] - noise)) % radix_of[moved]
        return [*halves[0].tolist(), *halves[1].tolist()]


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def iban_remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _by_class(text: str, move: Permuter, kind: str) -> str:
    """Digits stay digits, ASCII letters letters of their case, all else stays; the whole is one mixed-radix number, or a sequence of digits if it is long.

    Letters of either case count alike, so values that differ only in case stay linked.
    """
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    radices = [10 if text[i].isdigit() else 26 for i in at]
    values = [int(text[i]) if r == 10 else ord(text[i].lower()) - 97 for i, r in zip(at, radices, strict=True)]
    shape = "".join("0" if c.isascii() and c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in text)
    out = list(text)
    for i, r, v in zip(at, radices, _number_moved(values, radices, move, f"{kind}:{shape}"), strict=True):
        out[i] = str(v) if r == 10 else chr((65 if text[i].isupper() else 97) + v)
    return "".join(out)


def _number_moved(values: list[int], radices: list[int], move: Permuter, kind: str) -> list[int]:
    if len(values) > MOST_AS_NUMBER:
        return move.many(values, radices, kind)
    number, size = 0, 1
    for v, r in zip(values, radices, strict=True):
        number, size = number * r + v, size * r
    number, out = move(number, size, kind), []
    for r in reversed(radices):
        number, v = divmod(number, r)
        out.append(v)
    return out[::-1]


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _moved(digits: str, move: Permuter, kind: str) -> str:
    return str(move(int(digits), 10 ** len(digits), kind)).zfill(len(digits))


def card(m: re.Match, move: Permuter) -> str | None:
    d = _digits(m.group())
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    payload = _moved(d[:-1], move, "card")
    return _refill(m.group(), payload + luhn_digit(payload))


def iban(m: re.Match, move: Permuter) -> str | None:
    flat = m.group().replace(" ", "")
    if not 15 <= len(flat) <= 34 or iban_remainder(flat) != 1:
        return None
    body = _by_class(flat[4:], move, f"iban{flat[:2]}")
    new = f"{flat[:2]}{98 - iban_remainder(f'{flat[:2]}00{body}'):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in m.group())


def ssn(m: re.Match, move: Permuter) -> str | None:
    area, group, serial = map(int, m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    number = move(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    number, serial = divmod(number, 9999)
    area, group = divmod(number, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(m: re.Match, move: Permuter) -> str | None:
    d = _digits(m.group())
    if m.group().startswith("+"):
        country = 1 if d[0] in "17" else 2
        if not 8 <= len(d) <= 15:
            return None
    else:
        country = 0
    return _refill(m.group(), d[:country] + _moved(d[country:], move, "phone"))


def ip(m: re.Match, move: Permuter) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    n = move(int.from_bytes(map(int, parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def day(m: re.Match, move: Permuter) -> str | None:
    a, mark, b, c = re.match(r"(\d+)(\D)(\d+)\D(\d+)", m.group()).groups()
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy")
    for order in orders:
        f = dict(zip(order, (a, b, c), strict=True))
        try:
            old = date(int(f["y"]), int(f["m"]), int(f["d"]))
        except ValueError:
            continue
        if not _FIRST_DAY <= old <= _LAST_DAY:
            return None
        size = (_LAST_DAY - _FIRST_DAY).days + 1
        new = _FIRST_DAY + timedelta(move((old - _FIRST_DAY).days, size, "date"))
        width = 2 if len(f["m"]) == len(f["d"]) == 2 else 1
        text = {"y": f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
        return mark.join(text[k] for k in order)
    return None


def email(m: re.Match, move: Permuter) -> str | None:
    return f"{_by_class(m['local'], move, 'email@' + m['domain'].lower())}@{m['domain']}"


def secret(m: re.Match, move: Permuter) -> str | None:
    value = m["value"]
    if not (re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        new = "".join("0123456789abcdef"[v] for v in _number_moved([int(c, 16) for c in value], [16] * len(value), move, "hex"))
        new = new.upper() if value.upper() == value else new
    else:
        new = _by_class(value, move, "secret")
    start = m.start("value") - m.start()
    return m.group()[:start] + new + m.group()[start + len(value) :]


#: kind -> (pattern, pseudonym). Earlier kinds win where spans overlap.
RULES: dict[str, tuple[re.Pattern, Callable]] = {
    "secret": (re.compile(r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|password|passwd)[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_\-]{16,}=*)"), secret),
    "email": (re.compile(r"(?<![\w.+%-])(?P<local>[\w+%-]+(?:\.[\w+%-]+)*)@(?P<domain>(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})"), email),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"), iban),
    "card": (re.compile(r"(?<!\d)(?<!\d[.,-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![.,-]?\d)", re.A), card),
    "ssn": (re.compile(r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", re.A), ssn),
    "phone": (re.compile(r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+(?!1\D)\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4}){2,6}(?!\d)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])", re.A), phone),
    "ip": (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", re.A), ip),
    "date": (re.compile(r"(?<![\d/.-])(?:\d{4}-\d\d-\d\d|\d\d?([/.])\d\d?\1\d{4})(?![\d/-])", re.A), day),
}
_DIGIT, _MARK = re.compile(r"\d", re.A), re.compile(r"[=:]")


def find(text: str, move: Permuter) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value, in order and apart from each other."""
    has_digit = _DIGIT.search(text) is not None
    found: list[tuple[int, int, str, str]] = []
    taken: bytearray | None = None
    for kind, (pattern, change) in RULES.items():
        if not (("@" in text) if kind == "email" else has_digit and (kind != "secret" or _MARK.search(text))):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if (taken is None or taken.find(1, start, end) < 0) and (new := change(m, move)) is not None:
                found.append((start, end, kind, new))
                taken = taken or bytearray(len(text))
                taken[start:end] = b"\1" * (end - start)
    return sorted(found)


@lru_cache(8)
def _permuter(key: bytes, forward: bool) -> Permuter:
    return Permuter(key, forward)


def pseudonymize_text(text: str, key: bytes, forward: bool = True) -> tuple[str, list[tuple[int, int, str, str]]]:
    spans = find(text, _permuter(key, forward))
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), spans


def reveal(text: str, key: bytes) -> str:
    """The text before ``pseudonymize_text``, where its values are still found apart."""
    return pseudonymize_text(text, key, forward=False)[0]


def pseudonymize(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``df`` with its values in ``text`` replaced, and ``pii``: an array of (start, end, kind, pseudonym), by code points of the old text.

    Null text stays null with an empty array, an empty one stays empty; repeated rows get the same result, an empty table gives an empty one, an older
    ``pii`` is replaced. Values of any length are moved, texts of any length and number of values read in time that grows with them; where matches
    overlap the earlier kind of ``RULES`` wins, then the earlier match. Nothing is shuffled. The key goes to the executors with the
    function and appears in no column.
    """
    df = without(df, "pii")
    names, at, kind = df.columns, df.columns.index(text), "array<struct<start:int,end:int,kind:string,pseudonym:string>>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at]):
            done = [(None, []) if t is None else pseudonymize_text(t, key) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            keys = ("start", "end", "kind", "pseudonym")
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[dict(zip(keys, s, strict=True)) for s in spans] for _, spans in done], spans_type)], [*names, "pii"])

    return df.mapInArrow(run, extended(df, pii=kind))


def op4_pii(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    """Every document's text with pseudonyms, and the number of values of each kind. The key is ``spark.tidemill.pii.key``, or one for show."""
    told = documents.sparkSession.conf.get("spark.tidemill.pii.key", None)
    out = pseudonymize(documents.select("doc_id", "text"), key or (told.encode() if told else DEMO_KEY))
    return out.selectExpr("doc_id", "text", "cast(size(pii) as bigint) n_values", *[f"cast(size(filter(pii, p -> p.kind = '{k}')) as bigint) n_{k}" for k in KINDS])
