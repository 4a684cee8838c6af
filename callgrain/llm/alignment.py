"""Alignment of two tokenizers over the same texts, and how often their ids meet in the whole corpus.

A is a byte-level file of the tokenizers library, B a sentencepiece model that puts a space before
the text; A gets the space with the text. Both then cut the same bytes.

1. Texts are cut into units before each space that follows something else than white space: neither
   tokenizer joins across such a place (A's pre-tokenizer starts a token at the space, and no piece
   of B has a space after anything else, which is checked). A unit is tokenized once per worker,
   many units as one text.
2. The libraries' character offsets are coarse cuts: where one token ends exactly where the next
   begins, that character's byte offset is the token's end. Where they do not tell (several tokens
   inside one multibyte character, byte-fallback tokens, which have no width), the end is counted on
   from the last sure one by the decoded bytes of the tokens.
3. Byte ends that A and B share close a group; every byte end of either one closes a link, a pair of
   tokens that overlap. The joined bytes of each side must be those of the text, else the whole text
   has no tokens.
4. Tasks write blocks of documents: facts per document, the units each one holds, the id pairs each
   unit links. Pairs are counted per unit and block before the shuffle and summed over the corpus;
   each block gets back the counts of its own pairs, a group of bounded size, and adds them up per
   document.

Nothing is broadcast and no table of pairs is collected: blocks hold ``BLOCK_CHARS`` of text (or one
longer text) as compressed numbers, and a frequent pair is one row per block. A worker remembers
units up to ``MEMORY_CHARS``, gets few texts at once, and gives its memory back before the last step.

Null and empty texts have no tokens: all counts 0 and an empty digest; repeated rows are counted
each; a null doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callgrain.llm.common import Growing, keyed_text, stored, text_slices

# Text of one block, text tokenized at once, and text of the units a worker remembers before it keeps
# the half met most often (64 counted for each).
BLOCK_CHARS, LEARN_CHARS, MEMORY_CHARS = 2_000_000, 200_000, 20_000_000
# Documents that a worker gets at once.
BATCH_ROWS = 512
# A pair of ids as one number: A's id above, B's id below.
ID_BITS = 24
SPACE_PIECE = "▁"
# U+180E counted as white space once; the library gives no tokens to a unit of nothing
_CUT = re.compile("(?<=[^\\s᠎]) (?!\\Z)")
_ENDS_OPEN = re.compile("[\\s᠎]\\Z")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others by the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Side(NamedTuple):
    """One tokenizer's cut of a text: ids and, per token, the byte where it ends; do the tokens join
    to the text."""

    ids: np.ndarray
    ends: np.ndarray
    right: bool


def _flat(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(pairs), np.int64, 2 * len(pairs)).reshape(-1, 2)


def _ends(starts: np.ndarray, stops: np.ndarray, width: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from character offsets, and from decoded sizes where those do not tell."""
    sure = np.empty(len(stops), bool)
    sure[:-1] = (stops[:-1] == starts[1:]) & (stops[:-1] > starts[:-1])
    sure[-1:] = True
    # a place of no width before the first token: byte 0
    last = np.maximum.accumulate(np.where(sure, np.arange(len(stops)), -1))
    total = np.cumsum(sizes)
    at = np.where(last >= 0, width[stops[last]], 0)
    return at + total - np.where(last >= 0, total[last], 0)


class Pair:
    """Both tokenizers, and what their units gave."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        # offsets with the spaces that belong to a token
        self.a.post_processor = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE_PIECE.match(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_PIECE, " ").encode())
            if SPACE_PIECE in piece.lstrip(SPACE_PIECE):
                raise ValueError(f"piece {i} of {b_path} spans words")
        if max(size, len(self.b_bytes)) >= 1 << ID_BITS:
            raise ValueError("vocabulary too large")
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # ids as text, after the sign that may come before them
        count = max(size, len(self.b_bytes))
        self.names = {sign: np.array([sign + str(i) for i in range(count)], object) for sign in ";,|"}
        self.name_sizes = np.array([1 + len(str(i)) for i in range(count)])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.good = Growing(bool)
        self.facts = [Growing(np.int32) for _ in range(3)]  # tokens of A, of B, groups
        self.links, self.starts, self.sizes = Growing(np.int64), Growing(np.int64), Growing(np.int32)
        self.met = Growing(np.int32)  # documents with the unit, halved at each renewal
        self.held = 0

    def renew(self, room: int) -> None:
        """Forgets all units but those met more than once, the most frequent ones that fit ``room``;
        the units' numbers change."""
        names, met = list(self.index), self.met.values
        sizes = 64 + np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-met, kind="stable")
        kept = np.sort(order[(met[order] > 1) & (np.cumsum(sizes[order]) <= room)])
        links, counts = self.links_of(kept)
        good, facts, met = self.good.values[kept], [f.values[kept] for f in self.facts], met[kept] // 2
        names, groups = ([x[i] for i in kept.tolist()] for x in (names, self.groups))
        self.forget()
        self._remember(names, groups, good, facts, links, counts)
        self.met.values[:] = met

    def cut(self, text: str) -> tuple[Side, Side, int]:
        """Both sides of `` text`` and its length in bytes."""
        whole = " " + text
        raw = whole.encode()
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        width = np.concatenate([[0], np.cumsum(widths)])
        found = self.a.encode(whole, add_special_tokens=False)
        ids, spans = np.array(found.ids, np.int64), _flat(found.offsets)
        a = Side(
            ids, _ends(spans[:, 0], spans[:, 1], width, self.a_sizes[ids]), b"".join(map(self.a_bytes.__getitem__, found.ids)) == raw
        )
        found = self.b.encode(text, return_type="offset_mapping")
        ids, spans = np.array(found["ids"], np.int64), _flat(found["offsets"]) + 1  # the space before the text
        spans[:1, 0] = 0
        b = Side(
            ids, _ends(spans[:, 0], spans[:, 1], width, self.b_sizes[ids]), b"".join(map(self.b_bytes.__getitem__, found["ids"])) == raw
        )
        return a, b, len(raw)

    def learn(self, units: list[str]) -> None:
        """Aligns units as one text, in which a space comes before each."""
        a, b, size = self.cut(" ".join(units))
        if not (a.right and b.right):
            if len(units) > 1:
                half = len(units) // 2
                self.learn(units[:half])
                self.learn(units[half:])
            else:
                self._remember(units, [""], False, [[0]] * 3, np.zeros(0, np.int64), np.zeros(1, np.int64))
            return
        shared = np.intersect1d(a.ends, b.ends, assume_unique=True)
        every = np.union1d(a.ends, b.ends)
        pairs = (a.ids[np.searchsorted(a.ends, every)] << ID_BITS) | b.ids[np.searchsorted(b.ends, every)]
        ends = np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)).cumsum()
        # tokens, groups and links up to the end of each unit
        upto = [np.searchsorted(x, ends, "right") for x in (a.ends, b.ends, shared, every)]
        if ends[-1] != size or not np.array_equal(shared[upto[2] - 1], ends):
            raise ValueError("a token spans two units")
        counts = [np.diff(u, prepend=0) for u in upto]
        self._remember(units, self._named(a, b, shared, ends), True, counts[:3], pairs, counts[3])

    def _named(self, a: Side, b: Side, shared: np.ndarray, ends: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each unit."""
        groups = [np.searchsorted(shared, side.ends, "left") for side in (a, b)]
        order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")
        words, new = [], []
        for side, group, sign in ((a, groups[0], ";"), (b, groups[1], "|")):
            first = np.diff(group, prepend=-1) > 0
            words.append(np.where(first, self.names[sign][side.ids], self.names[","][side.ids]))
            new.append(self.name_sizes[side.ids])
        text = "".join(np.concatenate(words)[order].tolist())
        # where the last group of each unit ends
        length = np.concatenate(new)[order].cumsum()
        last = np.searchsorted(np.concatenate(groups)[order], np.searchsorted(shared, ends, "left"), "right") - 1
        stops = length[last].tolist()
        return [text[s + 1 : t] for s, t in zip([0, *stops], stops)]

    def _remember(self, units: list[str], groups: list[str], good, facts: list, links: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.groups)
        self.index.update(zip(units, range(known, known + len(units)), strict=True))
        self.groups += groups
        self.good.extend(np.full(len(units), good))
        for store, new in zip(self.facts, facts, strict=True):
            store.extend(new)
        self.starts.extend(self.links.size + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.links.extend(links)
        self.met.extend(np.zeros(len(units), np.int32))
        self.held += sum(map(len, units)) + 64 * len(units)

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some units one after the other, and how many each one has."""
        sizes, starts = self.sizes.values[units].astype(np.int64), self.starts.values[units]
        ends = np.cumsum(sizes)
        return self.links.values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def units(self, text: str) -> list[str]:
        return _CUT.split(text)

    def know(self, texts: list[list[str]]) -> None:
        """Learns the units not met yet. A unit that ends in white space could join with what comes
        after it and is cut by itself."""
        missing = sorted({u for units in texts for u in units}.difference(self.index))
        group, size = [], 0
        for u in missing:
            if _ENDS_OPEN.search(u):
                self.learn([u])
                continue
            group.append(u)
            size += len(u)
            if size >= LEARN_CHARS:
                self.learn(group)
                group, size = [], 0
        if group:
            self.learn(group)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One per worker process."""
    key = (a_path, b_path)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def release() -> None:
    """Gives back what this worker process learnt, before work that needs no tokenizer."""
    _PAIRS.clear()


def _packed(values: np.ndarray) -> bytes:
    """Small numbers in few bytes: the first bytes of all, the second ones and so on, compressed."""
    return zlib.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<i4").ravel().astype(np.int64)


class Block:
    """Documents of one output row."""

    def __init__(self, machine: Pair) -> None:
        self.machine, self.chars = machine, 0
        self.ids: list = []
        self.facts: list[tuple[int, int, int]] = []
        self.digests: list[str] = []
        self.shown: list[str] = []
        self.doc_units: list[np.ndarray] = []
        self.doc_counts: list[np.ndarray] = []

    def add(self, name, text: str, units: list[str], with_groups: bool) -> None:
        m = self.machine
        numbers = np.fromiter(map(m.index.__getitem__, units), np.int64, len(units)) if text else np.zeros(0, np.int64)
        if not m.good.values[numbers].all():
            numbers = numbers[:0]
        self.ids.append(name)
        self.chars += len(text) + 64
        if not len(numbers):
            self.facts.append((0, 0, 0))
            self.digests.append("")
            self.shown.append("")
            self.doc_units.append(numbers)
            self.doc_counts.append(numbers)
            return
        held, times = np.unique(numbers, return_counts=True)
        m.met.values[held] += 1
        self.facts.append(tuple(int(times @ f.values[held]) for f in m.facts))
        groups = ";".join(map(m.groups.__getitem__, numbers.tolist()))
        self.digests.append(hashlib.sha256(groups.encode()).hexdigest())
        self.shown.append(groups if with_groups else "")
        self.doc_units.append(held)
        self.doc_counts.append(times)

    def row(self) -> list:
        m = self.machine
        units, local = np.unique(np.concatenate(self.doc_units), return_inverse=True)
        counts = np.concatenate(self.doc_counts)
        total = np.bincount(local, counts, len(units)).astype(np.int64)
        flat, sizes = m.links_of(units)
        codes, at = np.unique(flat, return_inverse=True)
        n = np.bincount(at, np.repeat(total, sizes), len(codes)).astype(np.int64)
        doc_sizes = np.array([len(x) for x in self.doc_units], np.int64)
        return [
            self.ids, *map(list, zip(*self.facts, strict=True)), self.digests, self.shown, codes, n,
            *map(_packed, (doc_sizes, local, counts, sizes, at)),
        ]


_FACTS = ["n_a", "n_b", "n_groups"]
_BLOBS = ["doc_sizes", "doc_units", "doc_counts", "unit_sizes", "unit_links"]


def _blocks(a_path: str, b_path: str, with_groups: bool, id_type: pa.DataType):
    arrow = pa.schema(
        [("ids", pa.list_(id_type)), *((c, pa.list_(pa.int64())) for c in _FACTS), ("digests", pa.list_(pa.string())),
         ("shown", pa.list_(pa.string())), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
         *((c, pa.binary()) for c in _BLOBS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pair(a_path, b_path)

        def row(block: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block.row(), arrow, strict=True)], schema=arrow)

        block = Block(machine)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in text_slices(batch.column(1), 64):
                cut = [machine.units(t) if t else [] for t in texts]
                if machine.held > MEMORY_CHARS:  # blocks name units by number
                    if block.ids:
                        yield row(block)
                    machine.renew(MEMORY_CHARS // 2)
                    block = Block(machine)
                machine.know(cut)
                for t, units in zip(texts, cut, strict=True):
                    block.add(names[at], t, units, with_groups)
                    at += 1
                    if block.chars >= BLOCK_CHARS:
                        yield row(block)
                        block = Block(machine)
        if block.ids:
            yield row(block)

    return run


def _sums(id_type: pa.DataType):
    """Adds up, per document of a block, what the corpus says about its links."""
    arrow = pa.schema(
        [("doc_id", id_type), *((c, pa.int64()) for c in _FACTS), ("n_links", pa.int64()), ("n_best", pa.int64()),
         ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        codes, totals, best = (right.column(c).to_numpy() for c in ("code", "total", "best"))
        order = np.argsort(codes)
        codes, totals, best = codes[order], totals[order], best[order].astype(np.int64)
        one = {c: left.column(c)[0] for c in left.column_names}
        doc_sizes, units, counts, unit_sizes, links = (_unpacked(one[c].as_py()) for c in _BLOBS)
        # the block's own codes are ascending, and all of them came back
        assert np.array_equal(codes, one["codes"].values.to_numpy())

        def per_doc(of_link: np.ndarray) -> np.ndarray:
            unit_at = np.repeat(np.arange(len(unit_sizes)), unit_sizes)
            of_unit = _add_up(of_link, unit_at, len(unit_sizes))
            doc_at = np.repeat(np.arange(len(doc_sizes)), doc_sizes)
            return _add_up(of_unit[units] * counts, doc_at, len(doc_sizes))

        ones = np.ones(len(links), np.int64)
        cols = [one["ids"].values, *(one[c].values for c in _FACTS), per_doc(ones), per_doc(best[links]), per_doc(totals[links]),
                one["digests"].values, one["shown"].values]
        return pa.Table.from_arrays([pa.array(c.to_pylist() if hasattr(c, "to_pylist") else c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return run


def _add_up(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, groups, values)
    return out


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside gives workers batches of ``rows`` at most: whole texts of 10,000 rows are
    held by the executor and by the worker at the same time, twice while a new batch comes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows per document, and the table of linked id pairs.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and ``groups``
    if asked for. Pairs: a_id, b_id, total (links of the corpus), best (no pair of this B id has more).
    """
    id_type = pa.int64()
    rows = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, shown array<string>,"
        " codes array<long>, counts array<long>, " + ", ".join(f"{c} binary" for c in _BLOBS)
    )
    made = rows.mapInArrow(_blocks(a_path, b_path, with_groups, id_type), schema)
    # the number is fixed by being written
    with _batches_of(docs.sparkSession, BATCH_ROWS):
        blocks = stored(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    met = blocks.select("block", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("block", "p.codes", "p.counts")
    met = met.withColumnsRenamed({"codes": "code", "counts": "n"})
    sums = stored(met.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("code").bitwiseAND((1 << ID_BITS) - 1)), "pairs")
    highest = sums.groupBy("b_id").agg(F.max("total").alias("highest"))
    pairs = sums.join(highest, "b_id").select("code", "total", (F.col("total") == F.col("highest")).alias("best"))
    told = met.select("block", "code").join(pairs, "code").select(F.col("block").alias("of_block"), "code", "total", "best")
    out = blocks.drop("counts").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(
        _sums(id_type),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string",
    )
    table = pairs.select(
        F.shiftright("code", ID_BITS).alias("a_id"), F.col("code").bitwiseAND((1 << ID_BITS) - 1).alias("b_id"), "total", "best"
    )
    return (out if with_groups else out.drop("groups")), table
