import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from callgrain.llm import pieces
from callgrain.llm.pieces import ZIPF, PieceSampler, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "   ", "a", "two  words ", "▁x ▁", "line\nnext\n\n", "tab\tend", "中文 \U0001f600", "x" * 300, "a\0b", "", "héllo, wörld! 123"]


@pytest.fixture(scope="module")
def machine():
    return PieceSampler(MODEL)


def test_lossless(machine):
    rng = random.Random(3)
    letters = "aeiou thndr  \n.,é中▁▂" + "".join(chr(rng.randrange(32, 0x2fff)) for _ in range(50))
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(200)]
    ids = machine.encode(texts, np.arange(len(texts)), 5)
    assert [machine.decode(i.tolist()) for i in ids] == texts
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [i for i, t in enumerate(texts) if "▁" not in t]
    assert [sp.decode(ids[i].tolist()) for i in plain] == [texts[i] for i in plain]


def test_reproducible_and_seeded(machine):
    texts = ["some words that can be cut in many ways"] * 3
    a, b = machine.encode(texts, np.array([1, 2, 1]), 0), machine.encode(texts[:1], np.array([1]), 0)
    assert a[0].tolist() == a[2].tolist() == b[0].tolist() and a[0].tolist() != a[1].tolist()
    assert machine.encode(texts[:1], np.array([1]), 9)[0].tolist() != b[0].tolist()


def test_distribution(machine):
    """Drawn segmentations of one word follow the product of piece weights over all segmentations."""
    word, n = "the", 30_000
    unit = " " + word
    weights = {}
    for bars in itertools.product((0, 1), repeat=len(unit) - 1):
        cuts = [0, *[i + 1 for i, b in enumerate(bars) if b], len(unit)]
        parts = [unit[a:b] for a, b in itertools.pairwise(cuts)]
        if all(p in machine.weight for p in parts):
            weights[tuple(machine.weight[p][0] for p in parts)] = math.exp(sum(machine.weight[p][1] for p in parts))
    total = sum(weights.values())
    drawn = Counter(tuple(i.tolist()) for i in machine.encode([word] * n, np.arange(n), 1))
    assert set(drawn) <= set(weights) and ZIPF > 0
    for ids, w in weights.items():
        p = w / total
        assert abs(drawn[ids] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3


def test_tables(spark, monkeypatch):
    rows = [(i, t, "z") for i, t in enumerate(HARD)] + [(None, "null id", "z"), (50, None, "z"), (51, "long text " * 60_000, "z"), (3, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(df, MODEL), MODEL).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None) == sorted((i, t or "") for i, t, _ in rows if i is not None)
    assert encode(df.limit(0), MODEL).count() == 0


def test_memory_is_renewed(machine, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_EDGES", 10)
    texts = [f"word{i} other{i}" for i in range(50)]
    for t in texts:
        assert machine.decode(machine.encode([t], np.array([1]))[0].tolist()) == t
