import hashlib
import re

import numpy as np
from callgrain.llm import exact_dedup as op


def brute(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(9, "a  b"), (3, "a\tb"), (4, "A b"), (5, None), (6, ""), (7, " "), (8, "a b"), (None, "z"), (None, "z"),
        (None, "a b"), (3, "a\tb"), (20, "long " * 50_000), (21, "long\n" * 50_000)] + [(100 + i, f"copy {i % 3}") for i in range(90)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, salt string")
    return sorted(map(tuple, op.exact_dedup(df).collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_hot_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST_HOT", 4)
    assert run(spark, ROWS) == brute(ROWS)


def test_empty(spark):
    assert run(spark, []) == []


def test_directory():
    slots = op.directory(np.array([5, 0, 0, 0, 9, 9, 1, 1]), 10)
    assert slots.tolist() == [0, 0, 0, 0, 1, 2, 3, 3]
    assert op.directory(np.zeros(8, int), 10).tolist() == [0]
    assert op.directory(np.array([0, 99]), 10).tolist() == [0, 1]
