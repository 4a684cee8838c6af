import random
import re

import numpy as np
from callgrain.llm import jaccard_join as op


def shingles(text, words=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words=4, percent=85):
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return sorted(((i, len(shingles(t, words)), None if i is None else find(i)) for i, t in rows), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.4:
            base = passage + base[:15]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word()
            rows.append((i, rng.choice([" ", "\n", " \t "]).join(t).title()))
            i += 1
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, root int")
    return sorted(map(tuple, op.components(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"),
                        (None, "one two"), (1003, "one two"), (1006, "long word " * 30_000), (1007, "word long " * 30_000)]
    assert run(spark, rows) == brute(rows)


def test_small_tiles_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE_ROWS", 3)
    monkeypatch.setattr(op, "KEYS_PER_PART", 20)
    monkeypatch.setattr(op, "SAMPLE_SHARE", 2)
    rows = corpus(2, 40)
    assert run(spark, rows) == brute(rows)


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(25):
        words = list(words)
        words[(5 * i) % 120] = f"x{i}"
        rows.append((100 - i, " ".join(words)))
    got = run(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {76}


def test_empty(spark):
    assert run(spark, []) == []


def test_tree_join_is_complete():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 6, (40, op.GROUPS))
    points = np.maximum(0, base[rng.integers(0, 40, 600)] + rng.integers(-1, 2, (600, op.GROUPS))).astype(np.uint8)
    sizes = points.sum(axis=1, dtype=np.int64)
    sizes[::7] += rng.integers(0, 90, len(sizes[::7]))  # members above the points
    over = op._over(points, sizes)
    a, b = op.RTree(points, sizes), op.RTree(points[:7], sizes[:7])
    common = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64) + np.minimum(over[:, None], over[None])
    fits = op._enough(common, sizes[:, None], sizes[None])
    found = [(x, y) for xs, ys in a.join(b) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)]
    assert sorted(found) == [(x, y) for x in range(600) for y in range(7) if fits[x, y]]
    found = [tuple(sorted(p)) for xs, ys in a.join(a) for p in zip(xs.tolist(), ys.tolist(), strict=True)]
    assert sorted(found) == [(x, y) for x in range(600) for y in range(x + 1, 600) if fits[x, y]]


def test_points_bound_the_common_members():
    rng = np.random.default_rng(8)
    for n in (3, 300, 200_000):  # the last one has groups of more than 255 members
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)]))
        p, q = op.count_vector(a)[None], op.count_vector(b)[None]
        bound = op._common(p, q, op._over(p, np.array([len(a)])), op._over(q, np.array([len(b)])))
        assert bound[0] >= len(np.intersect1d(a, b)) and bound[0] <= min(len(a), len(b))


def test_large_tile_gives_out_pieces(monkeypatch):
    monkeypatch.setattr(op, "PAIRS_OUT", 1000)
    points = np.full((300, op.GROUPS), 2, np.uint8)
    sizes, roots = points.sum(axis=1, dtype=np.int64), np.arange(300) // 2
    pieces = list(op._tree_pairs(sizes, points, roots, np.zeros(300, np.int64), 85))
    assert max(p.shape[1] for p in pieces) < 2000
    assert {tuple(sorted(x)) for p in pieces for x in p.T.tolist()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if i // 2 != j // 2}
