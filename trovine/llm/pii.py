"""Format-preserving pseudonyms: a keyed Feistel permutation of each validated number within its format.

Values are found by pattern and validated (check digit, octet range, calendar), brought to one canonical form, permuted
among the values of that form, and written back in the format in which they stood. Equal values get equal pseudonyms in
all documents, whatever their spacing; the permutation has an inverse for those who hold the key.

| kind | validated by | permuted |
|-|-|-|
| card | 13 to 19 digits, Luhn check | all digits but the check digit, which is made anew |
| iban | mod 97 | letters and digits of the account part, each within its class and its country; check digits made anew |
| ssn | US number groups | nine digits |
| phone | 10 to 15 digits with +, parentheses or separators | the last ten digits |
| ip | four octets | 32 bits |
| date | calendar dates, 1900 to 2099 | the days of that range, days of the month up to 12 and over 12 each among themselves |
| email | address syntax | letters and digits of the address but its last label, each within its class |
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
ROUNDS = 10
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049


class Feistel:
    """A keyed permutation of 0 .. size - 1, by an alternating network on two factors and cycle walking."""

    def __init__(self, key: bytes, label: str, size: int):
        self.size, self.key = size, hmac.new(key, f"{label}:{size}".encode(), hashlib.sha256).digest()
        self.a = 1
        while self.a * self.a < size:
            self.a += max(1, self.a // 64)
        self.b = -(-size // self.a)

    def _f(self, k: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%d" % (k, x), key=self.key, digest_size=16).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(ROUNDS):
            if k % 2:
                right = (right + self._f(k, left)) % self.b
            else:
                left = (left + self._f(k, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(ROUNDS)):
            if k % 2:
                right = (right - self._f(k, left)) % self.b
            else:
                left = (left - self._f(k, right)) % self.a
        return left * self.b + right

    def _walk(self, x: int, step: Callable[[int], int]) -> int:
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x

    def __call__(self, x: int) -> int:
        return self._walk(x, self._once)

    def inverse(self, x: int) -> int:
        return self._walk(x, self._back)


def luhn_digit(body: str) -> str:
    total = 0
    for k, ch in enumerate(reversed(body)):
        d = int(ch) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


_PATTERN = re.compile(
    r"""
    (?P<email>[^\W_](?:[\w.+-]{0,62}[\w])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w]))
    | (?<![\w.])(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
    | (?<![\w.+-])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)
    | (?<![\w./-])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?=T\d{2}:\d{2}|(?![\w/-]|\.\d))
    | (?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    | (?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])
    | (?<![\w.])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|-\d)
    """,
    re.VERBOSE,
)


#: Where a shorter part of a card's or an IBAN's match may begin or end.
_EDGE = re.compile(r"[ -]+")


def parts(kind: str, value: str) -> Iterator[tuple[int, int]]:
    """Where shorter cards or IBANs may stand in a match that is none: whole groups, from the left, the longest first."""
    gaps = [m.span() for m in _EDGE.finditer(value)]
    begins, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(value)]
    for a in begins:
        for b in reversed(ends):
            if b > a and (a, b) != (0, len(value)) and (kind == "card" or a == 0):
                yield a, b


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


class Pseudonyms:
    """Replaces validated values of a text; remembers nothing but the permutations."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def _permute(self, kind: str, size: int, x: int, back: bool = False) -> int:
        f = self.known.get((kind, size))
        if f is None:
            f = self.known[kind, size] = Feistel(self.key, kind, size)
        return f.inverse(x) if back else f(x)

    def _digits(self, kind: str, digits: str, back: bool) -> str:
        return str(self._permute(kind, 10 ** len(digits), int(digits), back)).zfill(len(digits))

    def replace(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if it is not valid; with ``back`` the value of a pseudonym."""
        digits = re.sub(r"\D", "", value)
        if kind == "card":
            if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
                return None
            body = self._digits(kind, digits[:-1], back)
            return _refill(value, body + luhn_digit(body))
        if kind == "iban":
            plain = value.replace(" ", "")
            country, rest = plain[:2], plain[4:]
            if not 15 <= len(plain) <= 34 or iban_check(country, rest) != plain[2:4]:
                return None
            rest = self._classes(f"{kind} {country}", rest, back)
            it = iter(country + iban_check(country, rest) + rest)
            return re.sub(r"[A-Z0-9]", lambda _: next(it), value)
        if kind == "ssn":
            if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
                return None
            x = self._ssn(digits)
            y = self._permute(kind, 898 * 99 * 9999, x, back)
            area, (group, serial) = y // (99 * 9999), divmod(y % (99 * 9999), 9999)
            area = area + 1 if area + 1 < 666 else area + 2
            return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            if not 10 <= len(digits) <= 15:
                return None
            return _refill(value, digits[:-10] + self._digits(kind, digits[-10:], back))
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
                return None
            y = self._permute(kind, 2**32, int.from_bytes(bytes(octets), "big"), back)
            return ".".join(map(str, y.to_bytes(4, "big")))
        if kind == "date":
            return self._date(value, back)
        return self._email(value, back)

    @staticmethod
    def _ssn(digits: str) -> int:
        area = int(digits[:3])
        return ((area - 1 - (area > 666)) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1

    def _date(self, value: str, back: bool) -> str | None:
        mark = re.search(r"\D", value)[0]
        parts = value.split(mark)
        order = "ymd" if len(parts[0]) == 4 else "mdy" if mark == "/" and int(parts[0]) <= 12 else "dmy"
        at = dict(zip(order, parts, strict=True))
        try:
            day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"])).toordinal() - _FIRST
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        # With slashes a day over 12 tells a day-first date; so such days stay among themselves, in every form alike.
        late = int(at["d"]) > 12
        while True:
            day = self._permute("date", _DAYS, day, back)
            new = datetime.date.fromordinal(day + _FIRST)
            if (new.day > 12) == late:
                break
        text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return mark.join(text[c] for c in order)

    def _email(self, value: str, back: bool) -> str:
        body, dot, last = value.rpartition(".")
        return self._classes("email", body, back) + dot + last

    def _classes(self, kind: str, body: str, back: bool) -> str:
        """``body`` with its digits and ASCII letters permuted, each place within its class; case stays."""
        sizes = [10 if c.isdigit() and c.isascii() else 26 if c.isascii() and c.isalpha() else 1 for c in body]
        x, size = 0, 1
        for c, n in zip(body.lower(), sizes, strict=True):
            if n > 1:
                x, size = x * n + (int(c) if n == 10 else ord(c) - 97), size * n
        y = self._permute(kind, size, x, back)
        out = []
        for c, n in zip(reversed(body), reversed(sizes), strict=True):
            if n > 1:
                y, k = divmod(y, n)
                c = str(k) if n == 10 else chr(k + (65 if c.isupper() else 97))
            out.append(c)
        return "".join(reversed(out))

    def text(self, text: str, back: bool = False) -> tuple[str, Counter]:
        """The text with pseudonyms (``back``: with the values again), and how many values of each kind it had."""
        found: Counter = Counter()

        if not _HINT.search(text):
            return text, found
        out, done, at = [], 0, 0  # text before ``done`` is written; the search goes on from ``at``
        while m := _PATTERN.search(text, at):
            kind, (a, b) = m.lastgroup, m.span(m.lastgroup)
            new = self.replace(kind, text[a:b], back)
            if new is None and kind in ("card", "iban"):
                for x, y in parts(kind, text[a:b]):
                    if (new := self.replace(kind, text[a + x : a + y], back)) is not None:
                        a, b = a + x, a + y
                        break
            if new is None:
                at = a + 1
                continue
            found[kind] += 1
            out += [text[done:a], new]
            done = at = b
        return "".join([*out, text[done:]]), found


#: A text without any of these holds no value.
_HINT = re.compile(r"[0-9@]")


def _rewrite(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, counts, size = [], [], 0
            ids, first = batch.column(0), 0
            for k, text in enumerate(batch.column(1)):
                new, found = names.text(text.as_py())
                texts.append(new)
                counts.append([found[kind] for kind in KINDS])
                size += len(new)
                if size > 8_000_000 or k == len(batch) - 1:
                    columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(len(KINDS))]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(texts, pa.string()), *columns], ["doc_id", "text", *(f"n_{x}" for x in KINDS)])
                    texts, counts, size, first = [], [], 0, k + 1

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms; null stays empty) and n_<kind> values replaced, per row of ``docs``.

    What fails validation stays as it is; of a card's or an IBAN's match that fails, the parts of whole groups are tried,
    and the search goes on one character later. Where patterns overlap, the leftmost match counts, in the order of the table
    above. Repeated rows give repeated rows. The key never leaves the closure that is sent to the workers. Other columns
    are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_rewrite(key), "doc_id long, text string, " + ", ".join(f"n_{x} long" for x in KINDS))
