"""Format-preserving Feistel pseudonyms for personal data.

Found and validated: payment cards (13 to 19 digits, Luhn), international phone numbers, US social security
numbers, IBANs (checksum), IPv4 addresses, dates (ISO, day-first, and month-first where no day-first reading is a date),
and e-mail addresses. Each value is
normalised, permuted under a key inside its own format, and written back with its separators, so that equal
values stay linked in every document and each pseudonym is again a valid value of its kind:

* numbers: a balanced Feistel network over the free digits, walking on until the result is in the domain; the
  pseudonym is the value that comes next in the network's order, so that none is its own pseudonym
  (cards keep their first six digits' length class and get a new Luhn digit; octets stay under 256);
* dates: the day number within 1900-01-01 .. 2099-12-31 is permuted, walking on until the date can be written in the
  same way: in as many digits, and month-first only where it can't be read day-first;
* e-mail: letters and digits of the local part are permuted as base-26 and base-10 numbers; the domain stays.

A 16-digit run is taken as a card only if its Luhn digit holds or `strict_cards` is off: then any lone run
of 16 digits counts, which is how card-like account numbers are logged.

A number beside a value may be taken for a part of it. So where the longest match isn't valid, shorter ones that
end at a token's edge are tried, for cards later starts too, and the search goes on right after the failed start.

The key comes from the caller, or from the session's `spark.tallow.pii.key`; without either the public TEST_KEY is
used and a warning given, since anyone can then undo the pseudonyms.

Edge cases: a null text stays null with zero counts; repeated rows each give a row; all other columns pass
through unchanged, but with counts the table's own columns named pii_<kind> or pii_spans give way to the new ones; an
empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
KINDS = ("email", "card", "phone", "ssn", "iban", "ip", "date")
#: Public key of tests and of the registered queries, which must give the same result for everyone.
TEST_KEY = b"tallow pseudonyms v1"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
CACHE_VALUES = 200_000
#: Permutations kept at a time; e-mail domains have their own, and there is no end to them.
CACHE_NETWORKS = 4096

FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w\-])\d{3}-\d{3}-\d{4}(?![\w\-]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w\-/])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\w\-/]))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w]|-\d))",
    re.ASCII,
)

#: The digits from a card's start on, far enough for the longest card after the most digits that may be passed over.
_CARD_RUN = re.compile(r"\d(?:[ \-]?\d){12,24}", re.ASCII)
_DIGITS, _LETTER, _HYPHEN = (re.compile(p, re.ASCII) for p in (r"\d+", r"\w", r"-\d"))
_EDGES = re.compile(r"(?<=[^\W_])[ .\-]+", re.ASCII)
#: Shortest and longest card, and how their digits are usually grouped, beside one group of all.
CARD_DIGITS = (13, 19)
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (6, 13)}


class Feistel:
    """A keyed permutation of 0 .. n - 1: a balanced binary network, walked until it lands inside."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{label}:{n}:{r}".encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest() for r in range(ROUNDS)]

    def _mix(self, r: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(v.to_bytes(16, "little"), key=self.keys[r], digest_size=16).digest(), "little") & self.mask

    def _once(self, v: int) -> int:
        a, b = v >> self.half, v & self.mask
        for r in range(ROUNDS):
            a, b = b, a ^ self._mix(r, b)
        return a << self.half | b

    def _back(self, v: int) -> int:
        a, b = v >> self.half, v & self.mask
        for r in reversed(range(ROUNDS)):
            a, b = b ^ self._mix(r, a), a
        return a << self.half | b

    def forward(self, v: int) -> int:
        v = self._once(v)
        while v >= self.n:
            v = self._once(v)
        return v

    def inverse(self, v: int) -> int:
        v = self._back(v)
        while v >= self.n:
            v = self._back(v)
        return v


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, bban: str) -> str:
    number = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Pseudonyms:
    """All permutations of one key, with a bounded cache of values."""

    def __init__(self, key: bytes = TEST_KEY, strict_cards: bool = False):
        self.key, self.strict_cards = key, strict_cards
        self._feistel: dict[tuple[str, int], Feistel] = {}
        self._cache: dict[tuple[str, str], str | None] = {}

    def permute(self, label: str, v: int, n: int) -> int:
        own = self._feistel.get((label, n))
        if own is None:
            if len(self._feistel) >= CACHE_NETWORKS:
                self._feistel.clear()
            own = self._feistel[label, n] = Feistel(self.key, label, n)
        # one step along the permuted order: a permutation too, and one that leaves no value as it was
        return own.inverse((own.forward(v) + 1) % n)

    def digits(self, label: str, text: str) -> str:
        return f"{self.permute(f'{label}{len(text)}', int(text), 10 ** len(text)):0{len(text)}d}" if text else ""

    @staticmethod
    def refill(shape: str, new: str) -> str:
        """Put the characters of `new` where `shape` has letters or digits."""
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def replace(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value isn't a valid one of its kind."""
        found = self._cache.get((kind, value), "")
        if found != "":
            return found
        if len(self._cache) > CACHE_VALUES:
            self._cache.clear()
        out = self._cache[kind, value] = getattr(self, f"_{kind}")(value)
        return out

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        valid = luhn_digit(digits[:-1]) == digits[-1]
        if len(set(digits)) == 1 or not (valid or (not self.strict_cards and len(digits) == 16)):
            return None
        if valid:
            body = self.digits("card", digits[:-1])
            return self.refill(value, body + luhn_digit(body))
        # stay outside the Luhn-valid numbers, so that the two kinds never meet
        body, step = self.digits("account", digits[:-1]), (int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10
        return self.refill(value, body + str((int(luhn_digit(body)) + step) % 10))

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        code = len(re.match(r"\+(\d{1,3})(?=[ .\-(])", value)[1]) if re.match(r"\+\d{1,3}[ .\-(]", value) else 1 if value[0] == "+" else 0
        return self.refill(value, digits[:code] + self.digits("phone" + digits[:code], digits[code:]))

    def _ssn(self, value: str) -> str | None:
        """Area 001-899 but 666, group 01-99, serial 0001-9999."""

        def good(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = value.replace("-", "")
        if not good(digits):
            return None
        new = self.digits("ssn", digits)
        while not good(new):
            new = self.digits("ssn", new)
        return self.refill(value, new)

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, check, bban = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, bban) != check:
            return None
        new = self._runs("iban" + country, bban)
        return self.refill(value, country + iban_check(country, new) + new)

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        v = 0
        for p in parts:
            v = v << 8 | int(p)
        new = self.permute("ip", v, 1 << 32)
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))

    def _date(self, value: str) -> str | None:
        iso = value[4] == "-"
        first, second, year = re.split(r"[-/.]", value)[:: -1 if iso else 1]
        if not iso and value[-5] not in value[:-5]:
            return None
        widths = (len(first), len(second))
        for month_first in (False,) if iso else (False, True):
            d, m = (second, first) if month_first else (first, second)
            try:
                day = dt.date(int(year), int(m), int(d)).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            while True:
                day = FIRST_DAY + self.permute("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1)
                new = dt.date.fromordinal(day)
                numbers = (new.month, new.day) if month_first else (new.day, new.month)
                if (not month_first or new.day > 12) and all(w == 2 or x < 10 for w, x in zip(widths, numbers, strict=True)):
                    break
            if iso:
                return new.isoformat()
            sep = value[-5]
            return sep.join([*(f"{x:0{w}d}" for x, w in zip(numbers, widths, strict=True)), f"{new.year:04d}"])
        return None

    def _runs(self, label: str, text: str) -> str:
        """Permute each run of letters of one case and of digits within its length."""

        def one(m: re.Match) -> str:
            run = m[0]
            if run[0].isdigit():
                return self.digits(label, run)
            first = "A" if run[0].isupper() else "a"
            v = 0
            for c in run:
                v = v * 26 + ord(c) - ord(first)
            v = self.permute(f"{label}{first}{len(run)}", v, 26 ** len(run))
            out = []
            for _ in run:
                v, d = divmod(v, 26)
                out.append(chr(d + ord(first)))
            return "".join(reversed(out))

        return re.sub(r"[a-z]{1,24}|[A-Z]{1,24}|\d{1,30}", one, text)

    def _email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        return f"{self._runs('email@' + domain.lower(), local)}@{domain}"

    def _card_at(self, text: str, m: re.Match, least: int = 3) -> tuple[int, int, str] | None:
        """Start, end and pseudonym of the card in or right behind a match that may hold other numbers too.

        In this order, up to `least`: 0 valid cards in usual groups; 1 the match itself; 2 other valid runs of groups;
        3 account numbers.
        """
        low, high = CARD_DIGITS
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), _CARD_RUN.match(text, m.start()).end())]
        found = [(1, m.start(), -len(m[0]), m.end())]
        passed = 0
        for i, (a, _) in enumerate(groups):
            if passed > high - low:
                break
            n, sizes = 0, ()
            for c, b in groups[i:]:
                n, sizes = n + b - c, (*sizes, b - c)
                if n > high:
                    break
                if n < low or _LETTER.match(text, b):
                    continue
                digits = re.sub(r"\D", "", text[a:b])
                usual = len(sizes) == 1 or sizes in CARD_GROUPS
                if luhn_digit(digits[:-1]) == digits[-1]:
                    found.append((0 if usual else 2, a, a - b, b))
                elif usual and text[a - 1 : a] != "-" and not _HYPHEN.match(text, b):
                    found.append((3, a, a - b, b))
            passed += groups[i][1] - a
        for rank, a, _, b in sorted(found):
            if rank > least:
                break
            new = self.replace("card", text[a:b])
            if new is not None:
                return a, b, new
        return None

    def _valid_at(self, text: str, m: re.Match) -> tuple[int, int, str] | None:
        """Start, end and pseudonym of the valid value at a match: the longest that ends at a token's edge."""
        kind = m.lastgroup
        if kind == "card":
            return self._card_at(text, m)
        new = self.replace(kind, m[0])
        if new is not None:
            return m.start(), m.end(), new
        if kind in ("iban", "phone"):
            edges = list(_EDGES.finditer(text, m.start(), m.end()))
            if any((c := FIND.match(text, e.end())) and c.lastgroup == "card" and self._card_at(text, c, 0) for e in edges):
                return None
            for edge in reversed(edges):
                part = FIND.match(text, m.start(), edge.start())
                if part and part.lastgroup == kind and part.end() == edge.start() and (new := self.replace(kind, part[0])) is not None:
                    return part.start(), part.end(), new
        return None

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each value in the given text."""
        spans: list[tuple[str, int, int]] = []
        parts, at, seek = [], 0, 0
        while m := FIND.search(text, seek):
            valid = self._valid_at(text, m)
            if valid is None:
                seek = m.start() + 1
                continue
            start, end, new = valid
            spans.append((m.lastgroup, start, end))
            parts += (text[at:start], new)
            at = seek = end
        if not spans:
            return text, spans
        return "".join(parts) + text[at:], spans


def _session_key(docs: DataFrame) -> bytes:
    found = docs.sparkSession.conf.get("spark.tallow.pii.key", None)
    if found:
        return found.encode()
    warnings.warn("no key for pseudonyms: the public test key is used", stacklevel=3)
    return TEST_KEY


def pseudonymise(docs: DataFrame, key: bytes | None = None, column: str = "text", strict_cards: bool = False, counts: bool = True) -> DataFrame:
    """docs with `column` replaced; with counts, also pii_<kind> (int) for each kind and pii_spans."""
    key = _session_key(docs) if key is None else key
    schema = T.StructType([f for f in docs.schema.fields if not counts or f.name not in _extra()] + (_fields() if counts else []))
    docs = docs.select(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not counts or f.name not in _extra()])
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, strict_cards)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch.column(place)
                # only texts with a digit or an @ can hold a value
                some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_pylist()
                done = [own.apply(t.as_py()) if s else (t.as_py(), []) for t, s in zip(texts, some, strict=True)]
                columns = list(batch.columns)
                columns[place] = pa.array([d[0] for d in done], texts.type)
                names = list(batch.schema.names)
                if counts:
                    for kind in KINDS:
                        columns.append(pa.array([sum(s[0] == kind for s in d[1]) for d in done], pa.int32()))
                        names.append(f"pii_{kind}")
                    columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in d[1]] for d in done], _SPANS))
                    names.append("pii_spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _fields() -> list[T.StructField]:
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return [*(T.StructField(f"pii_{k}", T.IntegerType()) for k in KINDS), T.StructField("pii_spans", T.ArrayType(span))]


def _extra() -> set[str]:
    return {f.name for f in _fields()}
