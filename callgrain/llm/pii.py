"""Personal data replaced by format-preserving Feistel pseudonyms.

A value is found by its form and checked (card and account check digits, calendar dates, address and
phone ranges). What may vary in it becomes one number below the size of its format's space: digits,
letters within their case, the 32 bits of an address, the days of two centuries. A keyed Feistel
network permutes that number, walking on while it leaves the space, and the result is written back in
the same format, with a new check digit where there is one. A permutation never joins two values and
always gives equal values the same pseudonym, so records stay linked across documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import fresh_name

ROUNDS = 8
_FIRST_DAY, _DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31


def permute(number: int, size: int, key: bytes, tweak: str) -> int:
    """The keyed permutation of 0..size-1 that ``tweak`` names, applied to ``number``."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt = key + b"\0" + tweak.encode() + b"\0" + str(size).encode() + b"\0"
    while True:
        left, right = number >> half, number & mask
        for r in range(ROUNDS):
            mixed = hashlib.shake_256(salt + bytes([r]) + right.to_bytes(width, "big")).digest(width)
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        number = left << half | right
        if number < size:
            return number


_RADIX = [("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26)]
_PLACE = {c: (i, letters) for letters, _ in _RADIX for i, c in enumerate(letters)}


def permute_chars(value: str, key: bytes, tweak: str) -> str:
    """Digits stay digits and letters keep their case; all other characters stay in place."""
    number, size = 0, 1
    for c in value:
        if c in _PLACE:
            place, letters = _PLACE[c]
            number, size = number * len(letters) + place, size * len(letters)
    form = "".join(_PLACE[c][1][0] if c in _PLACE else c for c in value)
    number, out = permute(number, size, key, tweak + form) if size > 1 else 0, []
    for c in reversed(value):
        if c in _PLACE:
            letters = _PLACE[c][1]
            number, place = divmod(number, len(letters))
            c = letters[place]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """Check digit to append to ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n // 10 + n % 10
    return -total % 10


def _with_digits(form: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def _card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or _luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = permute_chars(digits[:-1], key, "card")
    return _with_digits(value, body + str(_luhn(body)))


def _account_number(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain)) if plain.isalnum() else 0


def _is_account(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and _account_number(plain[4:] + plain[:4]) % 97 == 1


def _account(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    if not _is_account(plain):
        return None
    body = permute_chars(plain[4:], key, "account")
    left = iter(plain[:2] + f"{98 - _account_number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(left) for c in value)


def _address(value: str, key: bytes) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "address")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _phone(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 7 <= len(digits) <= 15:
        return None
    code = re.match(r"\+\d{1,3}(?=\D)", value)
    head = code[0] if code else ""
    return head + permute_chars(value[len(head) :], key, "phone")


def _social(value: str, key: bytes) -> str | None:
    if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000":
        return None
    return permute_chars(value, key, "social")


def _date(value: str, key: bytes) -> str | None:
    parts = re.split(r"([-/.])", value)
    a, b, c = (int(parts[i]) for i in (0, 2, 4))
    orders = [("y", "m", "d")] if len(parts[0]) == 4 else [("d", "m", "y"), ("m", "d", "y")] if parts[1] != "/" else [("m", "d", "y"), ("d", "m", "y")]
    for order in orders:
        got = dict(zip(order, (a, b, c), strict=True))
        try:
            day = (date(got["y"], got["m"], got["d"]) - _FIRST_DAY).days
        except ValueError:
            continue
        if 0 <= day < _DAYS:
            new = _FIRST_DAY + timedelta(permute(day, _DAYS, key, "date"))
            part = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return part[order[0]] + parts[1] + part[order[1]] + parts[3] + part[order[2]]
    return None


def _email(value: str, key: bytes) -> str | None:
    head, dot, top = value.rpartition(".")
    return permute_chars(head, key, "email") + dot + top


def _secret(value: str, key: bytes) -> str | None:
    known = re.match(r"(?:AKIA|ASIA|gh[opsur]_|sk-|xox[abprs]-)", value)
    head = known[0] if known else ""
    return head + permute_chars(value[len(head) :], key, "secret")


Rule = tuple[str, re.Pattern, Callable[[str, bytes], str | None]]
# A text is searched for rare marks first; each pattern is tried only where its mark stands.
_NUMBERS: list[Rule] = [
    ("date", re.compile(r"(?<![\w.])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w])(?!\.[0-9])"), _date),
    ("address", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])"), _address),
    ("social", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _social),
    # a look-ahead, so that each group of four is tried as the first one
    ("card", re.compile(r"(?<!\w)(?=(?P<v>[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}(?!\w)|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5}(?!\w)))"), _card),
    ("card", re.compile(r"(?<!\w)[0-9]{13,19}(?!\w)"), _card),
    (
        "phone",
        re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)|(?<!\w)\+[0-9]{8,15}(?!\w)"),
        _phone,
    ),
]
# a whole run of digits and signs at once: it is never tried again from its middle
_RUN = re.compile(r"[0-9 ().+/-]{7,}+")
_RUN_START = re.compile(r"[+(0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_ACCOUNT_START = re.compile(r"(?s)[A-Z]{2}[0-9]{2}(?<![^\W_].{4})")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?!\w)")
# characters of an account by its country
_ACCOUNT_SIZE = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}
_SECRETS = [
    (("AKIA", "ASIA"), re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"), 0),
    (("ghp_", "gho_", "ghs_", "ghu_", "ghr_"), re.compile(r"(?<!\w)gh[opsur]_[A-Za-z0-9]{20,}"), 0),
    (("sk-", "xox"), re.compile(r"(?<!\w)(?:sk|xox[abprs])-[A-Za-z0-9-]{16,}"), 0),
    (
        ("oken", "ecret", "assw", "key", "KEY", "OKEN", "ECRET", "ASSW"),
        re.compile(r"(?i)(?:token|secret|passw(?:or)?d|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_/+.-]{8,})"),
        1,
    ),
]

Found = tuple[int, int, str, str]


@lru_cache(1 << 16)
def _pseudonym(kind: str, value: str, key: bytes) -> str | None:
    rules = {k: f for k, _, f in _NUMBERS} | {"email": _email, "account": _account, "secret": _secret}
    return rules[kind](value, key)


Spans = Iterator[tuple[int, int]]


def _clusters(text: str) -> Spans:
    """Runs that may hold numbers, from their first sign of one to their last digit."""
    for run in _RUN.finditer(text):
        first = _RUN_START.search(text, run.start(), run.end())
        end = run.start() + len(run[0].rstrip(" ().+/-"))
        if first and end - first.start() >= 7:
            yield first.start(), end


def _emails(text: str) -> Spans:
    at, last = text.find("@"), 0
    while at >= 0:  # around each @, as far as addresses reach
        start = at
        while start > last and at - start < 64 and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = _EMAIL.match(text, start)
        if m:
            last = m.end()
            yield m.start(), last
        at = text.find("@", max(at + 1, last))


def _accounts(text: str, starts: list[int], known: bool) -> Spans:
    """From each start to the longest end at a word border whose check digits hold; with ``known``,
    only ends that give the size of the start's country. Without an end the next start is tried."""
    last = 0
    for start in starts:
        longest = _ACCOUNT.match(text, start) if start >= last else None
        if longest:
            ends = [longest.end(), *(i for i in range(longest.end() - 1, start, -1) if text[i] == " ")]
            plain = ((e, text[start:e].replace(" ", "")) for e in ends)
            last = next((e for e, p in plain if (not known or len(p) == _ACCOUNT_SIZE.get(p[:2])) and _is_account(p)), last)
            if last > start:
                yield start, last


def _blanked(text: str, spans: list[Found], base: int = 0) -> str:
    """``text``, which begins at ``base``, with a character in place of each of the spans' that no pattern takes."""
    out, at = [], 0
    for start, end, _, _ in spans:
        out += [text[at : start - base], "\0" * (end - start)]
        at = end - base
    return "".join([*out, text[at:]]) if spans else text


def find(text: str, key: bytes) -> list[Found]:
    """(start, end, kind, pseudonym) of every checked value, in order; the first kind found wins overlaps.

    Each pattern searches what the ones before it left: values taken are blanked, so spans never overlap
    and a value next to a taken one is still found.
    """
    taken: list[Found] = []

    def checked(kind: str, spans: Spans, base: int = 0) -> list[Found]:
        new, last = [], 0
        for start, end in spans:
            pseudonym = _pseudonym(kind, left[start - base : end - base], key) if start >= last else None
            if pseudonym is not None:
                new.append((start, end, kind, pseudonym))
                last = end
        taken.extend(new)
        return new

    left = text
    left = _blanked(left, checked("email", _emails(left)))
    for marks, pattern, group in _SECRETS:
        if any(m in left for m in marks):
            left = _blanked(left, checked("secret", (m.span(group) for m in pattern.finditer(left))))
    starts = [m.start() for m in _ACCOUNT_START.finditer(left)]
    for known in (True, False) if starts else ():  # a shorter or longer text in front holds by chance at times
        left = _blanked(left, checked("account", _accounts(left, starts, known)))
    whole = left
    for start, end in _clusters(whole):
        a, b = max(0, start - 2), min(len(whole), end + 2)
        left = whole[a:b]
        for kind, pattern, _ in _NUMBERS:
            value = "v" if "v" in pattern.groupindex else 0
            left = _blanked(left, checked(kind, ((a + m.start(value), a + m.end(value)) for m in pattern.finditer(left)), a), a)
    return sorted(taken)


def replace(text: str, key: bytes) -> tuple[str, list[Found]]:
    found, out, at = find(text, key), [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return ("".join([*out, text[at:]]), found) if found else (text, found)


# The setting that holds the key, and the key of sessions that do not set it: no secret, it only makes
# runs on test data repeatable.
KEY_SETTING, OPEN_KEY = "spark.callgrain.pii.key", "corpus"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, OPEN_KEY)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with replaced texts, and the name of an added column of spans (start, end, kind).

    Spans count code points of the text as it was. A null text stays null and an empty one empty,
    without spans. ``key`` is the secret: who has it can undo the pseudonyms. Only the digits 0-9
    count; a number with others is left as it is. Other columns pass through, whatever their names.
    """
    spans, secret = fresh_name(docs, "pii_spans"), key.encode()
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    @F.arrow_udf("text string, spans array<struct<start int, end int, kind string>>")
    def run(texts: pa.Array) -> pa.Array:
        new, marks = [], []
        for t in texts.to_pylist():
            out, found = (None, []) if t is None else replace(t, secret)
            new.append(out)
            marks.append([{"start": s, "end": e, "kind": k} for s, e, k, _ in found])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(marks, pa.list_(kind))], ["text", "spans"])

    both = fresh_name(docs, "pii_found")
    found = docs.withColumn(both, run(F.col(text_col)))
    out = [F.col(both)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return found.select(*out, F.col(both)["spans"].alias(spans)), spans
