"""Format-preserving pseudonyms: validated values are permuted by a keyed Feistel network within their format."""

from __future__ import annotations

import hashlib
import math
import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.frames import small_batches
from raresift.llm.words import slices

ROUNDS = 10
DAYS = (date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal())
REMEMBERED = 20_000  # pseudonyms a task keeps

LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

# The written forms that are looked for.
EMAIL_BEFORE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?$")
EMAIL_AFTER = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|api[_ -]?key|access[_ -]?key|private[_ -]?key)\b[\"']?\s*[=:]\s*[\"']?([0-9a-f]{32,})(?![0-9a-z])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Characters of an account number by country.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29
    ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21
    LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27
    SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}
_DIGIT = re.compile("[0-9]")
COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")  # calling codes, however the number is spaced
_SPACE = r"[ \u00a0\u202f]"
#: Between the digits of a phone number: one separator, brackets. Once it has eight digits, a space that leads into another value ends it.
_BETWEEN = rf"\)?(?:{_SPACE}|[./-])?\(?"
_NEXT = r"""(?:\d{1,3}\.){3}\d{1,3}(?!\d)|\d{1,2}[./]\d{1,2}[./]\d{4}(?!\d)|\d{4}-\d{2}-\d{2}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)
      |\(?\d{3}(?:\)[ .-]?|[ .-])\d{3}[.-]\d{4}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|\d{4}[ -]\d{6}[ -]\d{5}"""
_FURTHER = rf"\)?(?:{_SPACE}(?!{_NEXT})|[./-])?\(?"
NUMBERS = re.compile(r"""
    (?P<phone>\+1(?:BETWEEN\d){10}(?!\d) | \+[2-9](?:BETWEEN\d){7}(?:FURTHER\d){0,7}(?!\d)
      | \+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,2}(?!\d) | \+\d{8,15}(?!\d))
  | (?P<card>(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{5})(?!\d))
  | (?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<iso>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-]))
  | (?P<day>(?<![\d./])\d{1,2}([./])\d{1,2}\9\d{4}(?![\d]|[./]\d))
  | (?P<local>(?<!\d)(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\d))
""".replace("BETWEEN", _BETWEEN).replace("FURTHER", _FURTHER), re.X)


class Feistel:
    """Keyed permutation of 0 .. n - 1 for any n >= 1: an alternating Feistel network over a * b >= n, walked until inside."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, modulus: int) -> int:
        size = min(64, (modulus.bit_length() + 7) // 8 + 8)
        message = tweak + b"|%d|%d" % (i, value)
        return int.from_bytes(hashlib.blake2b(message, digest_size=size, key=self.key).digest(), "big") % modulus

    def _once(self, x: int, a: int, b: int, tweak: bytes) -> int:
        left, right = x // b, x % b
        for i in range(0, ROUNDS, 2):
            left = (left + self._round(tweak, i, right, a)) % a
            right = (right + self._round(tweak, i + 1, left, b)) % b
        return left * b + right

    def _back(self, y: int, a: int, b: int, tweak: bytes) -> int:
        left, right = y // b, y % b
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._round(tweak, i + 1, left, b)) % b
            left = (left - self._round(tweak, i, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """The image of x, or with ``back`` its origin."""
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        name = f"{tweak}|{n}".encode()
        step = self._back if back else self._once
        while True:
            x = step(x, a, b, name)
            if x < n:
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban_holds(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _poured(new: str, old: str) -> str:
    """The characters of ``new`` in the places of the letters and digits of ``old``."""
    at = iter(new)
    return "".join(next(at) if c.isalnum() else c for c in old)


class Pseudonyms:
    """Pseudonyms of single values. Equal values (written with other separators or case, too) get equal pseudonyms."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.of = lru_cache(REMEMBERED)(self._of)

    def _text(self, value: str, tweak: str, alphabets: dict[str, str]) -> str:
        """Permutes the characters of the alphabets' classes as one mixed-radix number; others stay."""
        classes = [next((n for n, a in alphabets.items() if c in a), "") for c in value]
        size, x = 1, 0
        for c, k in zip(value, classes):
            if k:
                x, size = x * len(alphabets[k]) + alphabets[k].index(c), size * len(alphabets[k])
        x = self.feistel.permute(x, size, f"{tweak}|{''.join(k or c for c, k in zip(value, classes))}")
        out = []
        for c, k in zip(reversed(value), reversed(classes)):
            if k:
                x, at = divmod(x, len(alphabets[k]))
                c = alphabets[k][at]
            out.append(c)
        return "".join(reversed(out))

    def _of(self, kind: str, value: str) -> str | None:
        """Pseudonym in the same format, or None if the value is not valid for its kind."""
        return getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str:
        local, _, domain = value.lower().rpartition("@")
        words = {"a": LETTERS, "0": DIGITS}
        name, _, top = domain.rpartition(".")
        new = self._text(local, f"email|{domain}", words) + "@" + self._text(name, "domain", words) + "." + top
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, value))

    def _secret(self, value: str) -> str:
        new = self._text(value.lower(), "secret", {"f": HEX})
        return new.upper() if value.upper() == value else new

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self._text(digits[:-1], "card", {"0": DIGITS})
        return _poured(body + luhn_digit(body), value)

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        country = COUNTRY.match(digits)[0]
        return _poured(country + self._text(digits[len(country):], f"phone|{country}", {"0": DIGITS}), value)

    def _local(self, value: str) -> str:
        return _poured(self._text(re.sub(r"\D", "", value), "phone|1", {"0": DIGITS}), value)

    def _ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        x = self.feistel.permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, account = plain[:2], plain[4:]
        if not _iban_holds(plain):
            return None
        new = self._text(account, f"iban|{country}", {"A": LETTERS.upper(), "0": DIGITS})
        return _poured(country + _iban_check(country, new) + new, value)

    def _date(self, day: date) -> date | None:
        if not DAYS[0] <= day.toordinal() <= DAYS[1]:
            return None
        return date.fromordinal(DAYS[0] + self.feistel.permute(day.toordinal() - DAYS[0], DAYS[1] - DAYS[0] + 1, "date"))

    def _iso(self, value: str) -> str | None:
        try:
            day = self._date(date.fromisoformat(value))
        except ValueError:
            return None
        return day.isoformat() if day else None

    def _day(self, value: str) -> str | None:
        mark = "." if "." in value else "/"
        first, second, year = value.split(mark)
        orders = (("m", "d"), ("d", "m")) if mark == "/" else (("d", "m"),)  # with slashes the month comes first if it can
        for order in orders:
            try:
                found = dict(zip(order, (int(first), int(second))))
                day = self._date(date(int(year), found["m"], found["d"]))
            except ValueError:
                continue
            if day is None:
                return None
            new = {"m": day.month, "d": day.day}
            wide = len(first) == 2 and len(second) == 2
            return mark.join([*(f"{new[k]:02d}" if wide else str(new[k]) for k in order), str(day.year)])
        return None


def accounts(text: str) -> list[tuple[int, int]]:
    """(start, end) of account numbers, without the words and numbers the written form runs on into.

    A number ends after the length fixed for its country; for a country without one, at the last gap at which the check digits
    hold. Where none does, the search goes on behind the first four characters, as a number may begin further on.
    """
    out, at = [], 0
    while found := IBAN.search(text, at):
        start, stop = found.span()
        ends = [i for i in range(stop, start, -1) if i == stop or text[i] == " "]
        fixed = IBAN_LENGTH.get(text[start:start + 2])
        if fixed:  # the whole written form may hold, too
            ends = [i for i in ends if i - start - text.count(" ", start, i) == fixed] + [stop]
        end = next((i for i in ends if _iban_holds(text[start:i].replace(" ", ""))), None)
        if end:
            out.append((start, end))
        at = end or start + 4
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the written forms in a text, without overlap: secrets, e-mail, account numbers, then numbers and dates."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in ("token", "secret", "password", "key")):
        spans += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    at = text.find("@")
    while at >= 0:
        before = EMAIL_BEFORE.search(text, max(0, at - 64), at)
        after = EMAIL_AFTER.match(text, at + 1)
        if before and after:
            spans.append((before.start(), after.end(), "email"))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        spans += [(start, end, "iban") for start, end in accounts(text)]
        spans += [(*m.span(), m.lastgroup) for m in NUMBERS.finditer(text)]
    return spans


def replace(text: str, names: Pseudonyms) -> tuple[str, int]:
    """The text with every valid value replaced, and how many were."""
    chosen = []
    for rank, (start, end, kind) in enumerate(find(text)):
        new = names.of(kind, text[start:end])
        if new is not None:
            chosen.append((start, rank, end, new))
    taken: list[tuple[int, int, int, str]] = []
    for span in sorted(chosen):  # of overlapping values the one found first by rank stays
        while taken and span[0] < taken[-1][2] and span[1] < taken[-1][1]:
            taken.pop()
        if not taken or span[0] >= taken[-1][2]:
            taken.append(span)
    out, last = [], 0
    for start, _, end, new in taken:
        out += [text[last:start], new]
        last = end
    return "".join([*out, text[last:]]), len(taken)


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with every valid value in ``text_col`` replaced by its pseudonym; with ``count_col`` also how many were.

    Payment card numbers (Luhn), account numbers (mod 97), social security numbers, phone numbers, IPv4 addresses, calendar dates from 1900 to
    2099, e-mail addresses and hexadecimal secrets named as such. A pseudonym is valid in the same format: a keyed
    permutation of all values of the format, so equal values stay linked across documents, different ones stay different, and only the
    key's holder can go back. Separators and check digits are kept or made anew; a value may by chance be its own image, as in any
    permutation. Invalid values stay.

    No shuffle; every row on its own. Null texts stay null, empty texts empty; repeated rows give equal results; all other columns, whatever
    their names, are passed on (a column named as ``count_col`` is replaced); an empty table gives no row.
    """
    small_batches(df.sparkSession)
    schema = df.schema
    if count_col is not None:
        df = df.drop(count_col).withColumn(count_col, F.lit(0).cast("long"))
        schema = df.schema

    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                found = [(None, 0) if t is None else replace(t, names) for t in part.column(text_col).to_pylist()]
                part = part.set_column(at, text_col, pa.array([t for t, _ in found], part.schema.field(at).type))
                if count_col is not None:
                    where = part.schema.get_field_index(count_col)
                    part = part.set_column(where, count_col, pa.array([n for _, n in found], pa.int64()))
                yield part

    return df.mapInArrow(run, schema)
