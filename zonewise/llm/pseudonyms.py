"""Format-preserving pseudonyms for private values, by keyed Feistel permutations.

A value is validated (check digits, octets, calendar), read as a number within its format, permuted
among all numbers of that format by a keyed Feistel network, and written in the same format. Equal values get
equal pseudonyms in every document, different values different ones, and without the key none leads back.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from zonewise.llm import common

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ["email", "secret", "iban", "date", "ip", "phone", "card"]


def _draw(key: bytes, label: str, i: int, x: int, modulus: int) -> int:
    """Round function: near-uniform below ``modulus`` (16 bytes more than it needs are drawn)."""
    n = (modulus.bit_length() + 7) // 8 + 16
    data = f"{label}|{i}|{x}".encode()
    return int.from_bytes(hashlib.shake_256(key + hashlib.sha256(data).digest()).digest(n), "big") % modulus


def permute(x: int, size: int, key: bytes, label: str) -> int:
    """The keyed permutation of 0 .. size-1: an alternating Feistel network over a * b >= size, walked until inside."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    label = f"{label}|{size}"
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _draw(key, label, i, left, b)) % b
            else:
                left = (left + _draw(key, label, i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def restore(x: int, size: int, key: bytes, label: str) -> int:
    """Inverse of ``permute``."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    label = f"{label}|{size}"
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - _draw(key, label, i, left, b)) % b
            else:
                left = (left - _draw(key, label, i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


Step = Callable[[int, int, str], int]


def _alphabet(c: str) -> str | None:
    for first, n in (("0", 10), ("a", 26), ("A", 26)):
        if 0 <= ord(c) - ord(first) < n:
            return "".join(chr(ord(first) + i) for i in range(n))
    return None


def _characters(text: str, step: Step, label: str) -> str:
    """Digits become digits, letters letters of the same case; everything else stays in place."""
    alphabets = [_alphabet(c) for c in text]
    number, size = 0, 1
    for c, letters in zip(text, alphabets, strict=True):
        if letters:
            number, size = number * len(letters) + letters.index(c), size * len(letters)
    shape = "".join(letters[0] if letters else c for c, letters in zip(text, alphabets, strict=True))
    number = step(number, size, f"{label}|{shape}")
    out = []
    for c, letters in zip(reversed(text), reversed(alphabets), strict=True):
        if letters:
            number, i = divmod(number, len(letters))
            c = letters[i]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    doubled = [int(c) * 2 if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits exchanged for ``digits`` in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


def _card(text: str, step: Step) -> str | None:
    digits = re.sub(r"\D", "", text)
    if int(digits[-1]) != luhn_digit(digits[:-1]):
        return None
    n = len(digits) - 1
    body = str(step(int(digits[:-1]), 10**n, "card")).zfill(n)
    return _fill(text, body + str(luhn_digit(body)))


def _ip(text: str, step: Step) -> str | None:
    octets = [int(p) for p in text.split(".")]
    if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = step(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone(text: str, step: Step) -> str | None:
    head = re.match(r"\+\d{1,3}(?=\D)", text)
    head = head[0] if head else ""
    rest = text[len(head) :]
    digits = re.sub(r"\D", "", rest)
    return head + _fill(rest, str(step(int(digits), 10 ** len(digits), "phone")).zfill(len(digits)))


def _date(text: str, step: Step) -> str | None:
    """Slashes are read as month/day/year, or as day/month/year if that is no date; every part keeps its width.

    A date is permuted among those that are written and read in the same way, so that the way back finds it.
    """
    parts = re.split(r"\D", text)
    if len(parts[0]) == 4:
        orders = [(0, 1, 2)]
    else:
        orders = [(2, 0, 1), (2, 1, 0)] if "/" in text else [(2, 1, 0)]

    def read(values: list[str]) -> tuple[int, tuple[int, ...]] | None:
        for order in orders:
            try:
                return datetime.date(*(int(values[i]) for i in order)).toordinal(), order
            except ValueError:
                pass
        return None

    found = read(parts)
    if found is None or not FIRST_DAY <= found[0] <= LAST_DAY:
        return None
    day, order = found
    widths = [len(parts[i]) for i in order]
    label = "date"
    if widths != [4, 2, 2] or order != orders[0]:
        label = f"date|{order}|{widths}"
    while True:
        day = FIRST_DAY + step(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, label)
        new = datetime.date.fromordinal(day)
        values = dict(zip(order, (f"{v:0{w}}" for v, w in zip((new.year, new.month, new.day), widths, strict=True)), strict=True))
        fits = all(len(values[i]) == w for i, w in zip(order, widths, strict=True))
        if fits and read([values[i] for i in range(3)]) == (day, order):
            break
    return _fill(text, "".join(values[i] for i in range(3)))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _iban(text: str, step: Step) -> str | None:
    compact = text.replace(" ", "")
    country, check, body = compact[:2], compact[2:4], compact[4:]
    if not 11 <= len(body) <= 30 or int(check) != _iban_check(country, body):
        return None
    body = _characters(body, step, f"iban|{country}")
    new = iter(f"{country}{_iban_check(country, body):02}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _secret(text: str, step: Step) -> str:
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if not text.strip(digits):
            x = step(int(text, 16), 16 ** len(text), "hex")
            return "".join(digits[x >> 4 * i & 15] for i in reversed(range(len(text))))
    return _characters(text, step, "secret")


def _email(text: str, step: Step) -> str | None:
    # The top domain stays: it is no personal value, and pseudonyms stay well-formed.
    address, dot, top = text.rpartition(".")
    return _characters(address, step, "email") + dot + top


_FINDERS = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-])(?!\.\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)(?!\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<=[ .-])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d))"
)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key)["']?\s*[:=]\s*["']?)([A-Za-z0-9+/_-]{16,})""")
_BY_KIND = {"iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "card": _card}


class Pseudonyms:
    """Pseudonymises texts under a key. ``undo=True`` turns pseudonyms back into the values."""

    def __init__(self, key: bytes, undo: bool = False):
        function = restore if undo else permute
        self.step: Step = lambda x, size, label: function(x, size, key, label)

    def __call__(self, text: str) -> tuple[str, Counter]:
        """The text with pseudonyms, and how many values of each kind it had."""
        found: Counter = Counter()

        def exchanged(kind: str, value: str, make: Callable[[str, Step], str | None]) -> str:
            new = make(value, self.step)
            if new is None:
                return value
            found[kind] += 1
            return new

        if "@" in text:
            text = _EMAIL.sub(lambda m: exchanged("email", m[0], _email), text)
        if "=" in text or ":" in text:
            text = _SECRET.sub(
                lambda m: m[0][: m.start(1) - m.start()]
                + exchanged("secret", m[1], _secret),
                text,
            )
        text = _FINDERS.sub(lambda m: exchanged(m.lastgroup, m[0], _BY_KIND[m.lastgroup]), text)
        return text, found


def pseudonymise(docs: DataFrame, key: bytes, counts: bool = False, undo: bool = False) -> DataFrame:
    """The documents with private values of ``text`` exchanged for pseudonyms; other columns stay.

    With ``counts`` also a column n_<kind> for each of KINDS (replacing columns of these names). A null text stays
    null, an empty one empty; a text without private values passes unchanged. Rows are treated each on its own and
    may repeat; no rows give none. Numbers that fail their check (cards, IBANs, octets, calendar) are no private
    values and stay.
    """
    common.prepare(docs.sparkSession)
    added = [f"n_{kind}" for kind in KINDS] if counts else []
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*[docs[c] for c in names])
    schema = StructType([*rows.schema.fields, *(StructField(name, LongType()) for name in added)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        replace = Pseudonyms(key, undo)
        done = [(None, Counter()) if t is None else replace(t) for t in batch.column(names.index("text")).to_pylist()]
        columns = [
            pa.array([t for t, _ in done], pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)
        ]
        columns += [pa.array([found[kind] for _, found in done], pa.int64()) for kind in KINDS[: len(added)]]
        return pa.RecordBatch.from_arrays(columns, [*names, *added])

    return common.over_batches(rows, run, schema)


def digest(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, its checksum and the number of values of each kind."""
    done = pseudonymise(docs.select("doc_id", "text"), key, counts=True)
    return done.withColumn("text_crc32", F.crc32(F.col("text").cast("binary")).cast("bigint"))
