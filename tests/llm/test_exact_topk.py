import numpy as np
from callgrain.llm import exact_topk
from callgrain.llm.exact_topk import top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score int, part string"


def brute(rows, k):
    ok = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 20:
            continue
        s = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:k]
        out += [(q, r + 1, c, -n) for r, (n, c) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, k).collect()))


def test_against_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "LEAST_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 16).tolist()) for i in range(300)]
    assert run(spark, rows) == brute(rows, 5)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-0.001, 0.5]), (8, [1e17, 1e17]), (40, [1e17, 1e17]),
    ]
    got = run(spark, rows + [(6, [1.0, 2.0]), (0, [1.0, 2.0])])
    assert {r[2] for r in got if r[0] == 0} == {6, 8, 20, 40}
    assert [r[2:] for r in got if r[0] == 20][2:] == [(0, 4032), (6, 4032)]
    assert next(r for r in got if r[0] == 40 and r[2] == 8)[3] == (1 << 63) - 1


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
