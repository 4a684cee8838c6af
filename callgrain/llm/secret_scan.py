"""Secrets in texts: a keyword automaton finds where one may start, an anchored expression reads it
there, and a checksum inside the value decides where its format has one.

1. An Aho-Corasick automaton runs over the text with A-Z lower-cased and meets the keywords of all
   kinds in one pass. A hex key has no word to look for; its keyword is a shape: 24 times the same
   mark in a copy of the text where every hex digit is that mark.
2. A kind's expression is tried only at its hits, never searched for. Hits inside a match already
   taken are passed over, so the matches are the leftmost ones without overlap.
3. Kinds with an embedded checksum (base-62 CRC-32, bech32, base58 with double SHA-256) are kept only
   if it holds.

Everything is one pass over a text in one task: no shuffle, and memory in proportion to one text.

Null and empty texts have no spans; repeated rows are scanned each; a text of many megabytes costs
time in proportion to its length; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import fresh_name, text_slices

# Fixed values of public formats: digits of base 62, of bech32 (BIP 173) and of base 58.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_holds(token: str) -> bool:
    """``prefix_`` + 30 characters + their CRC-32 in six base-62 digits."""
    body, end = token[token.index("_") + 1 : -6], token[-6:]
    value = 0
    for c in end:
        value = 62 * value + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def bech32_holds(token: str) -> bool:
    """The six last digits make the checksum of prefix and data 1."""
    prefix, _, data = token.lower().rpartition("1")
    check = 1
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for bit, step in enumerate(BECH32_STEPS):
            if top >> bit & 1:
                check ^= step
    return check == 1


def base58_holds(token: str) -> bool:
    """The four last bytes are the head of the double SHA-256 of the others."""
    value = 0
    for c in token:
        value = 58 * value + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]  # lower case
    pattern: re.Pattern[bytes]  # tried where a keyword starts
    keep: Callable[[re.Match[bytes]], bool]


def _checked(holds: Callable[[str], bool]) -> Callable[[re.Match[bytes]], bool]:
    return lambda m: holds(m[0].decode())


# The base kinds in their listed order. A match that is too short still takes its characters.
BASE = (
    Kind(
        "assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[2]) >= 6,
    ),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Kind("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: True),
)
HEX_LENGTH = 24
# What the checksums add.
CHECKED = (
    Kind(
        "forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"), _checked(crc_holds),
    ),
    Kind("registry", ("npm_",), re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"), _checked(crc_holds)),
    Kind("age", ("age-secret-key-1",), re.compile(rb"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Za-z])"), _checked(bech32_holds)),
    Kind("nsec", ("nsec1",), re.compile(rb"nsec1[02-9ac-hj-np-z]{58}(?![0-9A-Za-z])"), _checked(bech32_holds)),
    Kind("xprv", ("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"), _checked(base58_holds)),
)
KINDS = BASE + CHECKED
NAMES = tuple(k.name for k in KINDS)

_MARK = ord("x")
_SHAPE = bytes(_MARK if b in b"0123456789abcdef" else ord(".") for b in range(256))


class Scanner:
    def __init__(self) -> None:
        self.words, self.shape = ahocorasick.Automaton(), ahocorasick.Automaton()
        for number, kind in enumerate(KINDS):
            for word in kind.keywords:
                self.words.add_word(word, (number, len(word)))
        self.shape.add_word(chr(_MARK) * HEX_LENGTH, (NAMES.index("hex"), HEX_LENGTH))
        self.words.make_automaton()
        self.shape.make_automaton()

    def _hits(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(kind, byte where its keyword starts), by start within each kind."""
        for end, (kind, size) in self.words.iter(raw.lower().decode("latin-1")):
            yield kind, end + 1 - size
        for end, (kind, size) in self.shape.iter(raw.translate(_SHAPE).decode("latin-1")):
            yield kind, end + 1 - size

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) in code points, by start, then by the kind's place in the list."""
        raw, found = text.encode(), []
        taken = [0] * len(KINDS)
        for kind, start in self._hits(raw):
            if start < taken[kind]:
                continue
            match = KINDS[kind].pattern.match(raw, start)
            if match is None:
                continue
            taken[kind] = match.end()
            if KINDS[kind].keep(match):
                found.append((match.start(), match.end(), kind))
        if found and len(raw) != len(text):
            place = _code_points(raw, sorted({p for s, e, _ in found for p in (s, e)}))
            found = [(place[s], place[e], k) for s, e, k in found]
        return sorted(found, key=lambda f: (f[0], f[2]))


def _code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Byte offsets, in ascending order, as code point offsets."""
    leads, out, at, count = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, {}, 0, 0
    for p in places:
        count += int(np.count_nonzero(leads[at:p]))
        out[p] = count
        at = p
    return out


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    """One per worker process."""
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


SPANS = "array<struct<kind string, start long, end long>>"


def find_secrets(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and the name of an added column of spans (kind, start, end), by start, then kind.

    Places count code points of the whole text, the end is exclusive. Spans of different kinds may
    overlap, those of one kind never do.
    """
    spans = fresh_name(docs, "secret_spans")
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        machine, sizes, rows = scanner(), [0], []
        for part in text_slices(texts):
            for t in part:
                rows += machine.find(t) if t else []
                sizes.append(len(rows))
        values = pa.StructArray.from_arrays(
            [
                pa.array([NAMES[k] for _, _, k in rows], pa.string()),
                pa.array([s for s, _, _ in rows], pa.int64()),
                pa.array([e for _, e, _ in rows], pa.int64()),
            ],
            fields=list(kind_type),
        )
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)

    return docs.withColumn(spans, run(F.col(text_col))), spans


def of_kinds(spans: Column, names: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*names))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def count_kind(spans: Column, name: str) -> Column:
    return F.size(of_kinds(spans, (name,))).cast("bigint")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``, overlapping spans by one; null stays null."""
    found, spans = find_secrets(docs, text_col)
    text = F.col(text_col)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(done: Column, span: Column) -> Column:
        start, end, at = span["start"], span["end"], done["at"]
        before = F.substr(text, (at + 1).cast("int"), F.greatest(start - at, F.lit(0)).cast("int"))
        new = F.when(start >= at, F.concat(done["out"], before, F.lit(mark))).otherwise(done["out"])
        return F.struct(new.alias("out"), F.greatest(end, at).alias("at"))

    clean = F.aggregate(
        spans, zero, step, lambda done: F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))
    )
    changed = F.when(F.size(spans) == 0, text).otherwise(clean)
    return found.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])
