"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (its matrix products and its
attention). Each task tokenises its rows in windows of bounded size. In a window, full sequences are
cut from long documents first; the rest goes, most costly piece first, to the sequence of lowest
cost that has room for it. As many sequences are open as the tokens need, so a piece that fits
nowhere is cut, and a window pads less than one sequence. Nothing is shuffled: a sequence is named by
its partition and its place there, which a repeated task reproduces.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import Growing, grouped, text_slices

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
WINDOW_TOKENS = 1 << 20


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class OpenSequences:
    """Sequences with room, by what room they have left.

    A heap per room holds (cost, sequence); a tree over the rooms holds the least of each range, so
    the cheapest sequence with enough room is found in as many steps as the capacity has bits.
    """

    def __init__(self, capacity: int) -> None:
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.size = 1 << capacity.bit_length()
        self.least = [_NONE] * (2 * self.size)

    def _refresh(self, room: int) -> None:
        at = self.size + room
        self.least[at] = self.heaps[room][0] if self.heaps[room] else _NONE
        while at > 1:
            at //= 2
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def add(self, room: int, spent: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (spent, sequence))
        self._refresh(room)

    def take(self, need: int) -> tuple[int, float, int]:
        """(room, cost, sequence) of the cheapest one with room for ``need``, or of the roomiest one."""
        # the subtrees that cover the rooms from need on; the rest of the tree is empty
        at, best = self.size + need, self.size + need
        while at > 1:
            if at % 2 == 0 and self.least[at + 1] < self.least[best]:
                best = at + 1
            at //= 2
        if self.least[best] == _NONE:
            best = 1
            while best < self.size:  # the highest room that any sequence has
                best = 2 * best + (self.least[2 * best + 1] != _NONE)
        while best < self.size:
            best = 2 * best + (self.least[2 * best + 1] < self.least[2 * best])
        room = best - self.size
        spent, sequence = heapq.heappop(self.heaps[room])
        self._refresh(room)
        return room, spent, sequence


_NONE = (float("inf"), 0)


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    pieces, rest, sequences = [], [], 0
    for doc, n in enumerate(lengths):
        full = n // capacity
        for i in range(full):
            pieces.append((doc, i * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, doc, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    ready = OpenSequences(capacity)
    for i in range(-(-sum(x[0] for x in rest) // capacity)):
        ready.add(capacity, 0.0, sequences + i)
    for n, doc, start in rest:
        while n:
            room, spent, sequence = ready.take(n)
            part = min(n, room)
            pieces.append((doc, start, part, sequence, capacity - room))
            if part < room:
                ready.add(room - part, spent + cost(part), sequence)
            n, start = n - part, start + part
    return pieces


# Below this code point no character composes with another and lower case needs no context, so
# texts made of such characters alone are cut into words here; all others go to the library whole.
PLAIN = 0x300
BATCH_CHARS = 1 << 20
MAX_TOKENS = 3 << 20  # token ids remembered per worker before the memory is renewed


class WordIds:
    """Token ids of whole texts. Words are tokenised independently of each other, so the library is
    asked once per distinct word; the classes of the word pattern are asked from it as well."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self._odd = re.compile(f"[{chr(PLAIN)}-\U0010ffff]")
        self._words = re.compile(self._pattern()).findall
        vocabulary, end = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        self._forget()

    def _pattern(self) -> str:
        split, classes = self.library.pre_tokenizer.pre_tokenize_str, {"letter": "", "number": "", "other": ""}
        plain = "".join(map(chr, range(PLAIN)))
        for ch in sorted({*plain, *plain.lower()}):  # lower case leads out of the range at times
            parts = {span for _, span in split(f"a{ch}1{ch}!{ch}a")}
            if (0, 2) in parts:
                classes["letter"] += re.escape(ch)
            elif (3, 4) in parts:
                classes["number"] += re.escape(ch)
            elif any(b == 6 for _, b in parts):
                classes["other"] += re.escape(ch)
        return "'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[{other}]+".format(**classes)

    def _forget(self) -> None:
        self._index: dict[str, int] = {}
        self._flat, self._starts, self._lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def _learn(self, words: list[str]) -> None:
        """The words are tokenised as one text with blanks between them; the last token of each is
        one of those that end a word."""
        found = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        lengths = np.diff(np.flatnonzero(self._ends_word[found]), prepend=-1)
        if len(lengths) != len(words):  # the library cuts one of them in two: each by itself
            each = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
            found, lengths = np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each])
        known = len(self._index)
        self._starts.extend(self._flat.size + np.cumsum(lengths) - lengths)
        self._lengths.extend(lengths)
        self._flat.extend(found)
        self._index.update(zip(words, range(known, known + len(words)), strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text of a batch."""
        cut = [None if self._odd.search(t) or self._special.search(t) else self._words(t.lower()) for t in texts]
        if self._flat.size > MAX_TOKENS:
            self._forget()
        missing = {w for words in cut if words for w in words}.difference(self._index)
        if missing:
            self._learn(sorted(missing))
        look, out = self._index.__getitem__, []
        flat, starts, sizes = self._flat.values, self._starts.values, self._lengths.values
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            at = np.fromiter(map(look, words), np.int64, len(words))
            lengths = sizes[at]
            ends = np.cumsum(lengths)
            out.append(flat[np.repeat(starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def by_batches(self, column: pa.Array) -> Iterator[np.ndarray]:
        for texts in text_slices(column):
            for group in grouped(texts, BATCH_CHARS):
                yield from self.ids(group)


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece, with ``ids`` (array of int) if asked for.

    A null or empty text is the end id alone. Rows that repeat are packed each; a null doc_id stays
    null. Every id of every document lies in exactly one piece.
    """
    arrow = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = word_ids(tokenizer)
        base = TaskContext.get().partitionId() << 32
        names, arrays, size, done = [], [], 0, 0

        def window() -> pa.RecordBatch:
            nonlocal done
            pieces = assign([len(a) for a in arrays], capacity)
            pieces.sort()
            cut = [arrays[d][s : s + n] for d, s, n, _, _ in pieces]
            cols = [
                [names[p[0]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces],
                [zlib.crc32(c.astype("<u4").tobytes()) for c in cut], [len(arrays[p[0]]) for p in pieces],
                [base + done + p[3] for p in pieces], [p[4] for p in pieces],
            ] + ([[c.astype(np.int32) for c in cut]] if with_ids else [])
            done += max(p[3] for p in pieces) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for name, tokens in zip(ids, machine.by_batches(batch.column(1)), strict=True):
                tokens = np.append(tokens, np.uint32(end_id))
                names.append(name)
                arrays.append(tokens)
                size += len(tokens)
                if size >= WINDOW_TOKENS:
                    yield window()
                    names, arrays, size = [], [], 0
        if arrays:
            yield window()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
