"""Token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

Two deterministic machines are compiled from the public tokenizer file:

* ``WordCutter`` reads character classes (with up to two characters of lookahead folded into the
  class) and emits 1 on every transition that begins a new word. A text is read in chunks: each
  chunk becomes a map from every entry state to its exit state, the maps are composed by a parallel
  prefix scan, and each chunk is then replayed from its true entry state. All chunks of a batch
  advance together in numpy.
* ``PieceCounter`` reads the bytes of one word. Its state is the last token of every prefix inside
  the longest token's reach; reading a byte has exactly one outcome, since a token may only follow
  another if BPE would not have merged across their border. Each transition carries the change of
  the number of tokens. Words repeat, so the sums are kept per distinct word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Character classes: letter, number, other, white space; the rest come from lookahead.
LETTER, NUMBER, OTHER, CLIP1, CLIP2, BLANK_LAST, SPACE_LAST, SPACE_IN, END = range(9)
_SPACE, _BLANK, _UNKNOWN = 20, 21, 255
# States: what the word being read consists of.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIXED, IN_SPACE, CLOSED, ONE_MORE, TWO_MORE = range(8)

CHUNK = 64
BATCH_CHARS = 1 << 20
MAX_WORDS = 1 << 20  # distinct words remembered per worker before the memory is renewed


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Tables [class, state] of the next state and of the emission (1: a word begins here)."""
    step, emit = np.zeros((9, 8), np.uint8), np.ones((9, 8), np.uint8)
    grows = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, CLIP1: IN_OTHERS, CLIP2: IN_OTHERS}
    opens = {**grows, CLIP1: ONE_MORE, CLIP2: TWO_MORE, BLANK_LAST: PREFIXED, SPACE_LAST: CLOSED, SPACE_IN: IN_SPACE}
    for c in range(9):
        for s in range(8):
            if c == END:
                step[c, s], emit[c, s] = CLOSED, 0
            elif s in (ONE_MORE, TWO_MORE):
                step[c, s], emit[c, s] = (CLOSED if s == ONE_MORE else ONE_MORE), 0
            elif c in grows and s in (PREFIXED, grows[c]):
                step[c, s], emit[c, s] = grows[c], 0
            elif c == SPACE_IN and s == IN_SPACE:
                step[c, s], emit[c, s] = IN_SPACE, 0
            else:
                step[c, s] = opens[c]
    return step, emit


class WordCutter:
    def __init__(self, tokenizer) -> None:
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self._kind[ord(" ")] = _BLANK
        self._kind[0] = OTHER
        step, emit = _compile()
        self._step, self._emit = step.ravel(), emit.ravel()

    def _learn(self, codes: np.ndarray) -> None:
        """Ask the library once for the class of each character not met before."""
        for code in np.unique(codes).tolist():
            ch = chr(code)
            begins = {a for _, (a, _) in self._split("a" + ch + "1" + ch + "!" + ch + "a")}
            self._kind[code] = (
                LETTER if 1 not in begins else NUMBER if 3 not in begins else OTHER if 5 not in begins else _SPACE
            )

    def classes(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Class of every character of ``text``; ``ends`` are the places of separators."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._kind[codes]
        unknown = kind == _UNKNOWN
        if unknown.any():
            self._learn(codes[unknown])
            kind = self._kind[codes]
        out = kind.copy()
        nxt = np.append(codes[1:], 0)
        after = np.append(nxt[1:], 0)
        out[ends] = END
        space = (kind >= _SPACE) & (out != END)
        next_out = np.append(out[1:], END)
        inner = space & ((next_out == END) | (next_out >= _SPACE))
        out[space & (kind == _BLANK)] = BLANK_LAST
        out[space & (kind == _SPACE)] = SPACE_LAST
        out[inner] = SPACE_IN
        mark = np.flatnonzero((codes == ord("'")) & (out != END))
        a, b = nxt[mark], after[mark]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(mark), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        out[mark[one]] = CLIP1
        out[mark[two]] = CLIP2
        return out

    def begins(self, classes: np.ndarray) -> np.ndarray:
        """Places where a word begins: chunk maps, their prefix scan, and a replay."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, END, np.uint8)
        padded[:n] = classes
        base = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.uint16) * 8
        maps = np.tile(np.arange(8, dtype=np.uint16), (chunks, 1))
        for row in base:
            maps = self._step[row[:, None] + maps].astype(np.uint16)
        width = 1
        while width < chunks:  # inclusive scan: earlier map first, later map applied to it
            maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.int64), axis=1)
            width *= 2
        state = np.full(chunks, CLOSED, np.uint16)
        state[1:] = maps[:-1, CLOSED]
        flags = np.empty((CHUNK, chunks), np.uint8)
        for i, row in enumerate(base):
            at = row + state
            flags[i] = self._emit[at]
            state = self._step[at].astype(np.uint16)
        return np.flatnonzero(flags.T.ravel()[:n])


class PieceCounter:
    def __init__(self, spec: dict) -> None:
        visible = _visible_bytes()
        raw = lambda piece: bytes(visible[c] for c in piece)
        self.token = {bytes([b]): b for b in range(256)}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for i, pair in enumerate(spec["merges"]):
            left, right = (raw(p) for p in (pair if isinstance(pair, list) else pair.split(" ")))
            new, parts = 256 + i, (self.token[left], self.token[right])
            self.merge[parts], self.parts[new], self.token[left + right] = new, parts, new
        lengths: dict[bytes, set[int]] = {}
        for t in self.token:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {tail: sorted(ls, reverse=True) for tail, ls in lengths.items()}
        self._beside: dict[tuple[int, int], bool] = {}
        self._known: dict[str, int] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Does BPE leave ``a`` and ``b`` side by side? Undo merges, latest first, and see whether
        one across the border would have come earlier."""
        limit = 1 << 60
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                return False
            latest = max(a, b)
            if latest < 256:
                return True
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]

    def _count(self, word: bytes) -> int:
        token, lengths, beside = self.token, self.lengths, self._beside
        last, total = [-1], [0]
        for i in range(1, len(word) + 1):
            for n in (*lengths.get(word[max(0, i - 2) : i], ()), 1):
                if n > i:
                    continue
                t = token.get(word[i - n : i])
                if t is None:
                    continue
                if n < i:
                    pair = (last[i - n], t)
                    ok = beside.get(pair)
                    if ok is None:
                        if len(beside) > 4 * MAX_WORDS:
                            beside.clear()
                        ok = beside[pair] = self._may_follow(*pair)
                    if not ok:
                        continue
                last.append(t)
                total.append(total[i - n] + 1)
                break
        return total[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > MAX_WORDS:
            known.clear()
        get = known.get
        out = [get(w, 0) for w in words]
        result = np.array(out, np.int64)
        for i in np.flatnonzero(result == 0).tolist():
            w = words[i]
            n = get(w)
            if n is None:
                n = self._count(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    known[w] = n
            result[i] = n
        return result


def _visible_bytes() -> dict[str, int]:
    """Byte-level BPE writes bytes that print as themselves and moves the others, in order, above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class TokenCounter:
    """Both machines; special strings count as one token each, as in the library's default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cutter = WordCutter(Tokenizer.from_file(path))
        self.pieces = PieceCounter(spec["model"])
        self.special = [t["content"] for t in spec["added_tokens"]]

    def _segments(self, text: str) -> tuple[list[str], int]:
        parts, extra = [text], 0
        for s in self.special:
            if s in text:
                cut = [q for p in parts for q in p.split(s)]
                extra += len(cut) - len(parts)
                parts = cut
        return parts, extra

    def _count_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        segments, owner = [], []
        for i, t in enumerate(texts):
            parts, out[i] = self._segments(t)
            segments += parts
            owner += [i] * len(parts)
        joined = "\0".join(segments) + "\0"
        lengths = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        ends = np.cumsum(lengths) - 1
        begins = self.cutter.begins(self.cutter.classes(joined, ends))
        if len(begins):
            segment = np.searchsorted(ends, begins)
            stops = np.minimum(np.append(begins[1:], len(joined)), ends[segment])
            words = [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
            np.add.at(out, np.array(owner)[segment], self.pieces.counts(words))
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        out, group, size = [], [], 0
        for t in texts:
            if group and size + len(t) > BATCH_CHARS:
                out.append(self._count_batch(group))
                group, size = [], 0
            group.append(t)
            size += len(t)
        if group:
            out.append(self._count_batch(group))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled counter per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text; a narrow map, no shuffle.

    A null or empty text has no tokens. ``tokenizer`` is the path of a byte-level BPE file present
    on every machine. An existing column ``out_col`` is replaced.
    """

    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = counter(tokenizer)
        for texts in batches:
            yield pd.Series(machine.count(texts.tolist()))

    return docs.withColumn(out_col, tokens(F.coalesce(F.col(text_col), F.lit(""))))
