import zlib

import numpy as np
import public_tokenizers
from callgrain.llm import packing
from callgrain.llm.packing import PLAIN, WordIds, assign, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(pieces, lengths, capacity):
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in pieces:
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
        assert n > 0
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(by_doc.get(d, [])):
            assert s == at
            at += m
        assert at == n
    for parts in by_seq.values():
        at = 0
        for o, m in sorted(parts):
            assert o == at
            at += m
        assert at <= capacity
    assert len(by_seq) == -(-sum(lengths) // capacity)


def test_assign():
    rng = np.random.default_rng(3)
    for lengths in ([], [1], [8], [9], [7] * 9, [5, 5, 5], rng.integers(1, 60, 500).tolist()):
        check_layout(assign(lengths, 8), lengths, 8)


def test_costs_are_balanced():
    lengths = np.random.default_rng(4).integers(1, 400, 3000).tolist()
    used = {}
    for _, _, n, q, _ in assign(lengths, 2048):
        used[q] = used.get(q, 0) + n + n * n / 2048
    costs = sorted(used.values())
    assert costs[-1] < 1.3 * costs[len(costs) // 2]


def test_pack(spark):
    long = "words and 12 more, " * 3000
    rows = [(1, None, 5), (2, "", 6), (3, long, 7), (4, "a b c", 8), (4, "a b c", 8), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    tok, got = Tokenizer.from_file(PATH), {}
    table = pack(df, PATH, with_ids=True).collect()
    assert not pack(df.limit(0), PATH).collect()
    for r in sorted(table, key=lambda r: (r["sequence_id"], r["start"])):
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    enc = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 1]
    assert got[1] == [1] and got[2] == [1] and got[None] == enc("x") and got[4] == enc("a b c") * 2
    by_start = sorted((r for r in table if r["doc_id"] == 3), key=lambda r: r["start"])
    assert sum((r["ids"] for r in by_start), []) == enc(long)


def test_ids_are_those_of_the_library():
    import random

    tok, mine, rng = Tokenizer.from_file(PATH), WordIds(PATH), random.Random(2)
    hard = [
        "", " ", "Don't WE'LL it's 're", "x<|endoftext|>y <|STARTOFTEXT|>", "\x1c\x1d a\x85b\xa0c", "İstanbul ÀÉ ß", "123 4a5",
        "e\u0301 \u03a3\u03a3", "''s !'s", "\u4e2d\u6587 \u00b2\u00bd", "".join(map(chr, range(PLAIN))),
    ]
    letters = "abcXYZ  '\n.,!09" + "".join(map(chr, range(PLAIN)))
    hard += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t, got in zip(hard, mine.ids(hard), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def brute_assign(lengths, capacity):
    """The cheapest sequence with room found by looking at all of them."""
    rest = sorted(((n % capacity, d, n // capacity * capacity) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    full = sum(n // capacity for n in lengths)
    sequences = [[0.0, full + i, 0] for i in range(-(-sum(r[0] for r in rest) // capacity))]
    out = []
    for n, doc, start in rest:
        while n:
            fits = [s for s in sequences if capacity - s[2] >= n]
            best = min(fits) if fits else max((s for s in sequences if s[2] < capacity), key=lambda s: (capacity - s[2], -s[0], -s[1]))
            part = min(n, capacity - best[2])
            out.append((doc, start, part, best[1], best[2]))
            best[0], best[2] = best[0] + packing.cost(part), best[2] + part
            n, start = n - part, start + part
    return out


def test_assign_against_brute_force():
    rng = np.random.default_rng(9)
    for capacity, lengths in (
        (8, rng.integers(1, 30, 200)), (100, rng.integers(1, 60, 400)), (2048, np.maximum(1, rng.lognormal(5.5, 1.2, 600)).astype(int)), (7, [7] * 5 + [1] * 9), (1, [1, 2, 3]),
    ):
        lengths = [int(n) for n in lengths]
        got = assign(lengths, capacity)
        check_layout(got, lengths, capacity)
        assert sorted(p for p in got if p[2] < capacity or p[4]) == sorted(p for p in brute_assign(lengths, capacity) if p[2] < capacity or p[4])


def test_few_pieces_are_cut():
    lengths = np.maximum(1, np.random.default_rng(1).lognormal(5.5, 1.2, 1700)).astype(int).tolist()
    assert len(assign(lengths, 2048)) - sum(-(-n // 2048) for n in lengths) < 250
