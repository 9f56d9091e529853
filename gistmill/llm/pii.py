"""PII by format-preserving Feistel pseudonyms: validated numbers and dates are permuted under a key, within their format.

Found and validated: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social-security numbers, international phone
numbers, IPv4 addresses, dates from 1900 to 2099 (year-month-day, day.month.year, day/month/year) and e-mail addresses
(the letters and digits before the @, of 64 characters at most there).  A value is read as a number below the size of its format, permuted by a balanced
Feistel network whose rounds are keyed HMACs (values outside the format are walked on), and written back with its own
separators; check digits are set anew.  The key and the value alone fix the pseudonym, so equal values stay linked across
documents and machines, and :func:`permute` with ``back=True`` restores them.

Defined cases: a null text stays null with nothing found, an empty one too; repeated rows change alike; where formats
overlap the earlier, then the longer, find wins; numbers that fail validation stay as they are; all columns stay, and
``pii`` replaces a column of that name.  Narrow: nothing is shuffled or kept beyond a batch but a bounded cache.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
#: Characters before the @ that an e-mail address may have at most; a longer run is none.
MAX_LOCAL = 64
CACHE_VALUES = 100_000
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)

_PATTERNS = {
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])",
}
PATTERNS = {kind: re.compile(p) for kind, p in _PATTERNS.items()}
_DIGIT = re.compile("[0-9]")
#: Groups of digits with one space or hyphen between them; a card is some neighbouring groups of such a run.
_DIGIT_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z])")
_DIGITS = re.compile("[0-9]+")
_LOCAL_END, _HOST = re.compile(r"[A-Za-z0-9._+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): Feistel rounds over a grid that covers it, walked until inside."""
    if size < 2:
        return value
    rows = isqrt(size - 1) + 1
    columns = -(-size // rows)

    def f(turn: int, half: int, modulus: int) -> int:
        return int.from_bytes(hmac.digest(key, f"{tweak}|{size}|{turn}|{half}".encode(), "sha256"), "big") % modulus

    while True:
        left, right = divmod(value, columns)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * f(turn, left, columns)) % columns
            else:
                left = (left + sign * f(turn, right, rows)) % rows
        value = left * columns + right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    each = iter(digits)
    return _DIGIT.sub(lambda _: next(each), shape)


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _valid_card(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if not _valid_card(digits):
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card", back)).zfill(len(digits) - 1)
    return _fill(text, body + luhn_digit(body))


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    solid = text.replace(" ", "")
    country, check, rest = solid[:2], solid[2:4], solid[4:]
    if not 11 <= len(rest) <= 30 or iban_check(country, rest) != check:
        return None
    digits = _digits(rest)
    if digits:
        made = str(permute(int(digits), 10 ** len(digits), key, f"iban{_DIGIT.sub('0', country + rest)}", back)).zfill(len(digits))
        rest = _fill(rest, made)
    solid = iter(country + iban_check(country, rest) + rest)
    return "".join(c if c == " " else next(solid) for c in text)


def _ssn_valid(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    n = int(_digits(text))
    if not _ssn_valid(n):
        return None
    while True:
        n = permute(n, 900_000_000, key, "ssn", back)
        if _ssn_valid(n):
            return _fill(text, f"{n:09d}")


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    head, body = digits[:-10], digits[-10:]
    return _fill(text, head + f"{permute(int(body), 10**10, key, 'phone' + head, back):010d}")


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(text: str, key: bytes, back: bool) -> str | None:
    iso = text[4] == "-"
    year, month, day = (text[:4], text[5:7], text[8:]) if iso else (text[6:], text[3:5], text[:2])
    try:
        n = (date(int(year), int(month), int(day)) - FIRST_DAY).days
    except ValueError:
        return None
    size = (LAST_DAY - FIRST_DAY).days + 1
    if not 0 <= n < size:
        return None
    made = FIRST_DAY + timedelta(days=permute(n, size, key, "date", back))
    return made.isoformat() if iso else f"{made.day:02d}{text[2]}{made.month:02d}{text[2]}{made.year:04d}"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, at, host = text.partition("@")
    alphabets = ["0123456789" if c.isdigit() else _LETTERS if c in _LETTERS else _LETTERS.upper() if c.isalpha() else "" for c in local]
    n, size = 0, 1
    for c, alphabet in zip(local, alphabets):
        if alphabet:
            n, size = n * len(alphabet) + alphabet.index(c), size * len(alphabet)
    shape = "".join(a[0] if a else c for c, a in zip(local, alphabets))
    n = permute(n, size, key, f"email{shape}", back)
    out = []
    for c, alphabet in reversed(list(zip(local, alphabets))):
        if alphabet:
            n, i = divmod(n, len(alphabet))
            c = alphabet[i]
        out.append(c)
    return "".join(reversed(out)) + at + host


def _card_spans(text: str) -> Iterator[tuple[int, int]]:
    """From each group of a run on, the longest stretch of whole groups with 13 to 19 digits that passes; the search goes on behind it."""
    for run in _DIGIT_RUN.finditer(text):
        if len(run[0]) < 13:
            continue
        groups = [m.span() for m in _DIGITS.finditer(text, run.start(), run.end())]
        i = 0
        while i < len(groups):
            total, j, best = 0, i, None
            while j < len(groups) and (total := total + groups[j][1] - groups[j][0]) <= 19:
                if total >= 13 and _valid_card(_digits(text[groups[i][0] : groups[j][1]])):
                    best = j
                j += 1
            if best is not None:
                yield groups[i][0], groups[best][1]
                i = best
            i += 1


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """For each @ the characters before it back to the last find, from the first letter or digit on, and the host after it."""
    done = 0
    for m in _HOST.finditer(text):
        first = m.start()
        while first > done and _LOCAL_END.match(text, first - 1):
            first -= 1
        while first < m.start() and text[first] in "._+-":
            first += 1
        if 0 < m.start() - first <= MAX_LOCAL:
            yield first, m.end()
            done = m.end()


def spans(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Places of possible values of a kind, in order; linear in the text."""
    if kind == "card":
        yield from _card_spans(text)
    elif kind == "email":
        yield from _email_spans(text)
    else:
        yield from (m.span() for m in PATTERNS[kind].finditer(text))


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email}


def find(text: str, key: bytes, cache: dict | None = None, back: bool = False) -> list[tuple[int, int, str, str]]:
    """The validated values of a text, in order and apart: (first, after last, kind, pseudonym)."""
    cache = {} if cache is None else cache
    found: list[tuple[int, int, str, str]] = []
    for kind, change in KINDS.items():
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for first, last in spans(text, kind):
            said = text[first:last]
            if (kind, said) not in cache:
                if len(cache) >= CACHE_VALUES:
                    cache.clear()
                cache[kind, said] = change(said, key, back)
            made = cache[kind, said]
            if made is not None:
                found.append((first, last, kind, made))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for first, last, _, made in found:
        out += [text[at:first], made]
        at = last
    return "".join([*out, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """All columns, the text with every validated value replaced, and ``pii``: array of (kind, first, pseudonym), places in the original text."""
    rows = docs.drop("pii")
    at = rows.columns.index(text)
    item = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("pseudonym", pa.string())])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts, all_found = [], []
            for value in batch.column(at).to_pylist():
                found = find(value, key, cache, back) if value else []
                texts.append(replace(value, found) if found else value)
                all_found.append([{"kind": k, "first": a, "pseudonym": p} for a, _, k, p in found])
            arrays = batch.columns
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(all_found, pa.list_(item))], [*batch.schema.names, "pii"])

    return rows.mapInArrow(each, fields + ", pii array<struct<kind:string,first:bigint,pseudonym:string>>")
