"""SentencePiece segmentations sampled from the piece lattice, reproducible and lossless.

A text becomes units that no piece crosses: a blank run with the characters behind it, or a character
that only stands alone. The lattice of a unit has an edge for every piece of the model. Forward
filtering sums the weights of all ways to each position; backward sampling draws edges from the end,
with the share of the ways that end in each. Both run once per distinct unit for the sums and for all
units of a batch together in numpy for the draws. The draw at a position depends on the seed, the row
key, the unit's place in the text and the position alone, so a repeated task repeats it.

The model file holds merge ranks, not probabilities: rank r is given the Zipf weight
``(r + ZIPF) ** -sharpness``. Pieces are matched with blanks in place of the model's blank mark and
the text has one blank put before it. A character without a piece of its own, such as the mark itself, may be
written as its UTF-8 bytes, at the weight of the last rank. Decoding is exact.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import Growing, grouped, text_slices

ZIPF = 2.7
BATCH_CHARS = 1 << 20
LATTICE = 1 << 16  # positions of the lattices filtered at once
MAX_EDGES = 1 << 21  # lattice edges remembered per worker before the memory is renewed
_RAW = 1 << 24  # symbols above are code points to be written as bytes


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts: uniform bits from counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceSampler:
    def __init__(self, path: str, sharpness: float = 1.0) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i).replace("\u2581", " ") for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        # weights follow the order of the scores; user-defined pieces share the lowest ranks
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.weight = {self.names[i]: (i, -sharpness * math.log(r + ZIPF)) for r, i in enumerate(order)}
        self._byte_weight = -sharpness * math.log(len(order) + ZIPF)
        self._trie()
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self._byte_of = np.full(len(self.names), -1)
        self._byte_of[self.bytes] = np.arange(256)
        self._names = np.array(self.names, object)
        self.longest = max(map(len, self.weight))
        joined = {c for p in self.weight if len(p) > 1 for c in p} - {" "}
        inner = "".join(re.escape(c) for c in sorted(joined))
        self._units = re.compile(f" +[{inner}]*|[{inner}]+|[^ {inner}]").findall
        self._forget()

    def _trie(self) -> None:
        """The pieces as a trie in sorted arrays: (node, character) to child, and the piece that ends there."""
        nodes, edges = {"": 0}, {}
        for piece in sorted(self.weight):
            for i in range(len(piece)):
                child = nodes.setdefault(piece[: i + 1], len(nodes))
                edges[nodes[piece[:i]] * 0x110000 + ord(piece[i])] = child
        # open addressing, at most an eighth full: nearly every look-up ends at its first slot
        self._slots = 1 << (8 * len(edges)).bit_length()
        self._edges, self._child = np.full(self._slots, -1, np.int64), np.zeros(self._slots, np.int64)
        left, children = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64)
        slot = self._slot(left)
        while len(left):
            free = self._edges[slot] < 0
            self._edges[slot[free]] = left[free]
            placed = self._edges[slot] == left
            self._child[slot[placed]] = children[placed]
            left, children, slot = left[~placed], children[~placed], (slot[~placed] + 1) % self._slots
        ends = [self.weight.get(prefix, (-1, 0.0)) for prefix in nodes]
        self._piece, self._log = np.array([i for i, _ in ends]), np.array([w for _, w in ends])

    def _slot(self, edge: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((edge.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self._slots

    def _children(self, edge: np.ndarray) -> np.ndarray:
        """The child of every edge, -1 where the trie has none."""
        slot = self._slot(edge)
        found = self._edges[slot]
        child = np.where(found == edge, self._child[slot], -1)
        open_ = np.nonzero((found != edge) & (found >= 0))[0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self._slots
            found = self._edges[slot[open_]]
            hit = found == edge[open_]
            child[open_[hit]] = self._child[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return child

    def _forget(self) -> None:
        self._index: dict[str, int] = {}
        # per unit: its last position in the common numbering and its length; per position: its first edge;
        # per edge: upper end of its share, length, symbol
        self._last, self._sizes, self._first = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self._cuts, self._step, self._symbol = Growing(float), Growing(np.int8), Growing(np.int32)

    def _learn(self, units: list[str]) -> None:
        """Forward filtering of new units, those of similar length together."""
        units = sorted(units, key=len)
        start = 0
        while start < len(units):
            stop = start + 1
            while stop < len(units) and (stop - start + 1) * len(units[stop]) <= LATTICE:
                stop += 1
            self._filter(units[start:stop])
            start = stop

    def _filter(self, units: list[str]) -> None:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        width = int(sizes[-1])
        chars = np.zeros((len(units), width), np.int64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        real = np.arange(width) < sizes[:, None]
        chars[real] = flat
        row, at = np.nonzero(real)
        # (unit, end, length, log weight, symbol) of every edge; first a character's bytes, whose place
        # its own piece takes below
        found = [(row, at + 1, 0, self._byte_weight, _RAW + flat.astype(np.int64))]
        node = np.zeros(len(row), np.int64)
        for length in range(1, self.longest + 1):
            inside = at + length <= sizes[row]
            row, at, node = row[inside], at[inside], node[inside]
            node = self._children(node * 0x110000 + chars[row, at + length - 1])
            hit = node >= 0
            row, at, node = row[hit], at[hit], node[hit]
            if not len(row):
                break
            piece = self._piece[node]
            ends = piece >= 0
            if ends.any():
                found.append((row[ends], at[ends] + length, length - 1, self._log[node[ends]], piece[ends]))
        longest = found[-1][2] + 1
        weight = np.full((len(units), width + 1, longest), -np.inf)
        symbol = np.zeros((len(units), width + 1, longest), np.int32)
        for r, e, n, log, names in found:
            weight[r, e, n], symbol[r, e, n] = log, names
        total = np.full((len(units), width + 1), -np.inf)  # log of the summed weights of all ways
        total[:, 0] = 0.0
        for end in range(1, width + 1):
            reach = min(end, longest)
            ways = weight[:, end, :reach]
            ways += total[:, end - reach : end][:, ::-1]
            top = ways.max(axis=1)
            top[np.isinf(top)] = 0.0  # behind the end of a shorter unit
            shares = np.cumsum(np.exp(ways - top[:, None]), axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                total[:, end] = np.log(shares[:, -1]) + top
                shares /= shares[:, -1:]
            weight[:, end, :reach] = np.where(np.isinf(ways) | np.isnan(shares), -np.inf, shares)
        row, end, length = np.nonzero(weight > -np.inf)
        base = self._first.size + np.cumsum(sizes + 1) - (sizes + 1)
        per_place = np.bincount(base[row] + end - self._first.size, minlength=int((sizes + 1).sum()))
        self._first.extend(self._cuts.size + np.cumsum(per_place) - per_place)
        self._cuts.extend(weight[row, end, length])
        self._step.extend(length + 1)
        self._symbol.extend(symbol[row, end, length])
        self._index.update(zip(units, range(self._last.size, self._last.size + len(units)), strict=True))
        self._last.extend(base + sizes)
        self._sizes.extend(sizes)

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """A sampled segmentation of each text as piece ids."""
        cut = [self._units(" " + t) if t else [] for t in texts]
        if self._cuts.size > MAX_EDGES:
            self._forget()
        self._learn(sorted(set().union(*cut).difference(self._index)))
        first, cuts, step, symbol = self._first.values, self._cuts.values, self._step.values, self._symbol.values
        sizes = np.array([len(u) for u in cut], np.int64)
        n = int(sizes.sum())
        unit = np.fromiter(map(self._index.__getitem__, chain.from_iterable(cut)), np.int64, n)
        at, left = self._last.values[unit], self._sizes.values[unit]
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            row = _mix(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            state = _mix(np.repeat(row, sizes) + place.astype(np.uint64))
        live = np.arange(n)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            with np.errstate(over="ignore"):
                bits = _mix(state[live] + left[live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            share = (bits >> np.uint64(40)).astype(float) / (1 << 24)
            edge = first[at[live]]
            # the last share of a position ends at 1, so the walk stays within it
            above = np.nonzero(cuts[edge] <= share)[0]
            while len(above):
                edge[above] += 1
                above = above[cuts[edge[above]] <= share[above]]
            drawn.append((live, symbol[edge]))
            gone = step[edge]
            at[live] -= gone
            rest = left[live] - gone
            left[live] = rest
            live = live[rest > 0]
        counts = np.zeros(n, np.int64)
        for units, _ in drawn:
            counts[units] += 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if n else 0, np.int64)
        for i, (units, symbols) in enumerate(drawn):
            out[ends[units] - 1 - i] = symbols
        stops = np.append(0, ends)[np.cumsum(sizes)] if n else np.zeros(len(texts), np.int64)
        return [self._as_ids(out[a:b]) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _as_ids(self, symbols: np.ndarray) -> np.ndarray:
        raw = symbols >= _RAW
        if not raw.any():
            return symbols.astype(np.int32)
        symbols = symbols.copy()
        plain = raw & (symbols < _RAW + 128)
        symbols[plain] = self.bytes[symbols[plain] - _RAW]
        if not (raw & ~plain).any():
            return symbols.astype(np.int32)
        out = []
        for s in symbols.tolist():
            out += [s] if s < _RAW else self.bytes[list(chr(s - _RAW).encode("utf-8"))].tolist()
        return np.array(out, np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text that ``encode`` was given."""
        ids = np.asarray(ids, np.int64)
        raw = self._byte_of[ids] >= 0
        if not raw.any():
            return "".join(self._names[ids])[1:]
        # runs of bytes and runs of pieces
        cuts = np.flatnonzero(np.diff(raw)) + 1
        out = []
        for run, is_raw in zip(np.split(ids, cuts), raw[np.append(0, cuts)], strict=True):
            out.append(self._byte_of[run].astype(np.uint8).tobytes().decode("utf-8") if is_raw else "".join(self._names[run]))
        return "".join(out)[1:]


_SAMPLERS: dict[tuple, PieceSampler] = {}


def sampler(path: str, sharpness: float) -> PieceSampler:
    """One per worker process."""
    if (path, sharpness) not in _SAMPLERS:
        _SAMPLERS[path, sharpness] = PieceSampler(path, sharpness)
    return _SAMPLERS[path, sharpness]


def encode(docs: DataFrame, model: str, seed: int = 0, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, ids_crc32) per row: a sampled segmentation of the whole text.

    A null or empty text has no ids. Rows with equal id and text get equal ids; a null id counts as
    0. ``ids_crc32`` is over the little-endian 32-bit ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sampler(model, sharpness)
        for batch in batches:
            names, done = batch.column(0), 0
            keys = names.fill_null(0).to_numpy(zero_copy_only=False)
            for texts in (g for some in text_slices(batch.column(1)) for g in grouped(some, BATCH_CHARS)):
                part = slice(done, done + len(texts))
                ids = machine.encode(texts, keys[part], seed)
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                crcs = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([names[part], lists, crcs], schema=schema)
                done += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids, in a column of that name; null ids give a null text."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        machine = sampler(model, 1.0)
        return pa.array([machine.decode(i.values.to_numpy()) if i.is_valid else None for i in ids], pa.string())

    return encoded.withColumn(out_col, run(F.col(ids_col)))
