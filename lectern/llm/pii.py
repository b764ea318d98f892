"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Values are found by pattern and validated (Luhn, mod 97, calendar, number ranges). What varies in a value is read as a
number in a mixed radix, permuted with a keyed Feistel network, and written back in the same format: digits stay digits,
letters letters, separators where they were; check digits are made anew, so a pseudonym passes the validation its original
passed. The permutation depends on the key and the kind only: equal values get equal pseudonyms in all documents,
different ones stay different, and the holder of the key can go back.

One pass over whole texts in Arrow batches, no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
KEY = "lectern"
KINDS = ("email", "card", "phone", "ip", "date", "id", "secret")

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_FIRST_DAY = datetime.date(1000, 1, 1).toordinal()
_DAYS = datetime.date(2999, 12, 31).toordinal() - _FIRST_DAY + 1

#: No alternative can backtrack over more than a few dozen characters, so a text without blanks costs no more than prose.
PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)
    |(?P<secret>(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?)[A-Za-z0-9+/_-]{8,}+)
    |(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9]))
    |(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
    |(?P<iso>(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9]))
    |(?P<day>(?<![0-9./])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9]|[./][0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
    |(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])
        |(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]))
    |(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}
        |[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?![0-9]))""",
    re.VERBOSE,
)
_WORTH = re.compile(r"[0-9@=:]")


def _round(key: bytes, tweak: bytes, nth: int, value: int) -> int:
    size = max(8, (value.bit_length() + 7) // 8)
    digest = hashlib.blake2b(bytes([nth]) + tweak + b"\0" + value.to_bytes(size, "big"), key=key, digest_size=32).digest()
    return int.from_bytes(digest, "big")


def permute(symbols: list[int], radices: list[int], key: bytes, tweak: bytes, back: bool = False) -> list[int]:
    """A keyed bijection of the mixed-radix numbers: an alternating Feistel network over both halves of the places."""
    if not symbols:
        return []
    half = len(symbols) // 2
    sides, sizes = [], []
    for part in (slice(0, half), slice(half, None)):
        value = size = 0
        size = 1
        for s, r in zip(symbols[part], radices[part]):
            value, size = value * r + s, size * r
        sides.append(value)
        sizes.append(size)
    for nth in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = nth % 2 if half else 1
        step = _round(key, tweak, nth, sides[1 - side])
        sides[side] = (sides[side] - step if back else sides[side] + step) % sizes[side]
    out: list[int] = []
    for value, part in zip(sides, (radices[:half], radices[half:])):
        places = []
        for r in reversed(part):
            value, s = divmod(value, r)
            places.append(s)
        out += reversed(places)
    return out


def _letters(text: str, key: bytes, tweak: bytes, back: bool, hexadecimal: bool = False, nanp: tuple[int, ...] = ()) -> str:
    """Permutes digits and ASCII letters of ``text`` within their classes; places in ``nanp`` (by number of the digit)
    keep to 2-9."""
    places, alphabets = [], []
    digits = 0
    for at, c in enumerate(text):
        if hexadecimal and c in HEX:
            alphabet = HEX
        elif c in DIGITS:
            alphabet = DIGITS if digits not in nanp else DIGITS[2:] if c in DIGITS[2:] else DIGITS[:2]
            digits += 1
        elif c in LOWER:
            alphabet = LOWER
        elif c in UPPER:
            alphabet = UPPER
        else:
            continue
        places.append(at)
        alphabets.append(alphabet)
    symbols = [a.index(text[at]) for at, a in zip(places, alphabets)]
    moved = permute(symbols, [len(a) for a in alphabets], key, tweak + str([len(a) for a in alphabets]).encode(), back)
    out = list(text)
    for at, alphabet, s in zip(places, alphabets, moved):
        out[at] = alphabet[s]
    return "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` and it pass."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[ -]", "", text)
    if len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    moved = digits[0] + _letters(digits[1:-1], key, b"card", back)
    moved += luhn_digit(moved)
    new = iter(moved)
    return "".join(next(new) if c in DIGITS else c for c in text)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    return ".".join(map(str, permute([int(o) for o in octets], [256] * 4, key, b"ip", back)))


def _move_day(day: datetime.date, key: bytes, back: bool, short: bool = False) -> datetime.date | None:
    """``short``: among the days with a one-digit day or month."""
    at = day.toordinal() - _FIRST_DAY
    if not 0 <= at < _DAYS:
        return None
    side = 855  # 855^2 is the next square: walk on until the result is a day
    while True:
        high, low = permute(list(divmod(at, side)), [side, side], key, b"date", back)
        at = high * side + low
        if at < _DAYS:
            moved = datetime.date.fromordinal(_FIRST_DAY + at)
            if not short or moved.day < 10 or moved.month < 10:
                return moved


def _iso(text: str, key: bytes, back: bool) -> str | None:
    try:
        moved = _move_day(datetime.date.fromisoformat(text), key, back)
    except ValueError:
        return None
    return moved and moved.isoformat()


def _day(text: str, key: bytes, back: bool) -> str | None:
    """Day, month, year; where that is no date, month, day, year. One-digit parts stay unpadded."""
    sep = "." if "." in text else "/"
    a, b, year = text.split(sep)
    for day, month, order in ((a, b, 1), (b, a, -1)):
        try:
            moved = _move_day(datetime.date(int(year), int(month), int(day)), key, back, short=len(a) + len(b) < 4)
        except ValueError:
            continue
        width = 2 if len(a) == len(b) == 2 else 1
        parts = [f"{moved.day:0{width}d}", f"{moved.month:0{width}d}"][::order] if moved else None
        return parts and sep.join([*parts, f"{moved.year:04d}"])
    return None


def _ssn_ok(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    if not _ssn_ok(text):
        return None
    while True:
        text = _letters(text, key, b"ssn", back)
        if _ssn_ok(text):
            return text


def _iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    country, check, account = text[:2], text[2:4], text[4:]
    if _iban_check(country, account) != check:
        return None
    moved = _letters(account, key, b"iban", back)
    return country + _iban_check(country, moved) + moved


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country code stays; area and exchange keep to 2-9 in their first digit where they had one."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    at = code.end() if code else 0
    return text[:at] + _letters(text[at:], key, b"phone", back, nanp=(0, 3))


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return _letters(local, key, b"email", back) + "@" + domain if re.search("[A-Za-z0-9]", local) else None


def _secret(text: str, key: bytes, back: bool) -> str | None:
    # the value begins after the sign and an optional quote
    head = re.match(r"[^:=]*[:=]\s{0,3}[\"']?", text).end()
    value = text[head:]
    if not re.search("[0-9]", value):
        return None  # an ordinary word
    return text[:head] + _letters(value, key, b"secret", back, hexadecimal=not set(value) - set(HEX))


def _aws(text: str, key: bytes, back: bool) -> str | None:
    return text[:4] + _letters(text[4:], key, b"aws", back)


_RULES: dict[str, tuple[str, Callable]] = {
    "email": ("email", _email), "secret": ("secret", _secret), "aws": ("secret", _aws), "iban": ("id", _iban), "ip": ("ip", _ip),
    "iso": ("date", _iso), "day": ("date", _day), "ssn": ("id", _ssn), "phone": ("phone", _phone), "card": ("card", _card),
}


def pseudonyms(text: str, key: str = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind were. ``back`` undoes it."""
    counts = dict.fromkeys(KINDS, 0)
    if not _WORTH.search(text):
        return text, counts
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def swap(match: re.Match) -> str:
        name = next(n for n in _RULES if match.group(n) is not None)
        kind, rule = _RULES[name]
        new = rule(match.group(), secret, back)
        if new is None:
            return match.group()
        counts[kind] += 1
        return new

    return PATTERN.sub(swap, text), counts


_RESULT = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text", back: bool = False) -> DataFrame:
    """Replaces ``text`` and adds n_email, n_card, ... per kind. A null text stays null with zero counts.

    Digits that fail their validation (a number no card has, 999.1.1.1, 31 February) are no personal data and stay.
    Where two kinds could begin at one place, the first in the order of ``_RULES`` wins. An empty text stays empty; a very
    long one is searched whole, inside its row. Repeated rows get equal results. Columns n_email, n_card, ... of ``docs``
    are replaced, all others stay; the name _pii is reserved. An empty table gives an empty result with all columns.
    """

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [pseudonyms(t, key, back) if t is not None else (None, {}) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[1].get(k, 0) for r in rows], pa.int64()) for k in KINDS]],
                names=["text", *[f"n_{k}" for k in KINDS]],
            )

    found = docs.withColumn("_pii", run(F.col(text)))
    counts = [f"n_{k}" for k in KINDS]
    return found.select(
        *[F.col("_pii.text").alias(c) if c == text else F.col(c) for c in docs.columns if c not in counts],
        *[F.col(f"_pii.{c}").alias(c) for c in counts],
    )


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return pseudonymised(table(spark, folder, "documents").select("doc_id", "text"))
