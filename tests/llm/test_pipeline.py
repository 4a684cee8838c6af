import random

import corpus_pipeline
import pytest
from callgrain.llm import line_dedup, pii

from tests.llm import test_jaccard_join, test_line_dedup, test_toxicity


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, y) for i, t, y in test_toxicity.corpus(5, 300)]
    rows += [(i + 1000, t + "\nmail me@some.org or 10.1.2.3", 0) for i, t in test_jaccard_join.corpus(4, 30)]
    rows += [(5000, None, 0), (5001, "", 0), (5002, None, 0), (None, "no id", 0), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([(i, t, "en", i, 1) for i, t, _ in rows], "doc_id long, text string, toxicity string, root long, lines_of_text int")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows[:300]], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, made):
    docs, seen = spark.read.parquet(f"{made}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, made), "test")
        assert docs.columns == before.columns
        seen.append((before.collect(), docs.collect()))
    (a, b), (_, c), (_, d), (_, e) = seen
    bad = {i for i, _, y in test_toxicity.corpus(5, 300) if y}
    left = {r["doc_id"] for r in b}
    assert len(bad & left) < 0.1 * len(bad) and len({r["doc_id"] for r in a} - bad - left) <= 3
    want = test_line_dedup.brute([(r["doc_id"], r["text"]) for r in b])
    assert sorted(((r["doc_id"], r["text"] or "") for r in c), key=str) == sorted(((w[0], w[1]) for w in want), key=str)
    roots = {x[0]: x[2] for x in test_jaccard_join.brute([(r["doc_id"], r["text"]) for r in c], 5, 80)}
    kept = [r["doc_id"] for r in c if r["doc_id"] is None or roots[r["doc_id"]] == r["doc_id"]]
    assert sorted(kept, key=str) == sorted((r["doc_id"] for r in d), key=str)
    assert sorted((str(r["doc_id"]), str(r["text"] and pii.replace(r["text"], b"corpus")[0])) for r in d) == sorted((str(r["doc_id"]), str(r["text"])) for r in e)
    assert not any("me@some.org" in (r["text"] or "") or "10.1.2.3" in (r["text"] or "") for r in e)
    assert line_dedup.HOT_SHARE


def test_run(spark, made):
    pieces = corpus_pipeline.run(spark, made).collect()
    assert {"doc_id", "start", "sequence_id", "offset"} <= set(pieces[0].asDict())


def test_empty(spark, made, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{made}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_five_words_and_eighty_percent(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    texts = []
    for n in (60, 104, 150, 204):
        for extra in range(n // 8, n // 3, 2):  # a passage at the end: similarity (n - 4) / (n - 4 + extra)
            base = [word() for _ in range(n)]
            texts += [base, base + [word() for _ in range(extra)]]
        for edits in range(1, 8):  # scattered ones
            base = [word() for _ in range(n)]
            copy = list(base)
            for e in range(edits):
                copy[5 + e * (n - 10) // edits] = word()
            texts += [base, copy]
    texts = [" ".join(t) for t in texts] + ["one two three four", "one two three four", "one two three five"]
    likeness = lambda a, b: len(a & b) / len(a | b)
    sets = [shingles(t) for t in texts]
    planted = [likeness(a, b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.8 <= x < 0.85 for x in planted) >= 8 and 0.8 in planted and sum(x < 0.8 for x in planted) >= 8
    kept = []
    for i, s in enumerate(sets):  # no two groups share a shingle, so a group is a pair
        if not any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:i]):
            kept.append(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == kept
