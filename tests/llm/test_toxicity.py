import random
import zlib

import numpy as np
from callgrain.llm.toxicity import DECAY, Machine, _svm, features, fit_texts, held_out, score, train
from pyspark.sql import functions as F

BAD = ["grobnix", "trakul"]


def word(rng):
    return "".join(rng.choice(["th", "an", "er", "on", "ti", "sh", "ea", "ou"]) for _ in range(rng.randrange(1, 5)))


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = [word(rng) for _ in range(rng.randrange(5, 60))], int(rng.random() < 0.3)
        if toxic:
            for _ in range(2):
                w = rng.choice(BAD)
                w = rng.choice([w, w + word(rng), w[:3] + rng.choice("xz") + w[3:], w.upper() + "!"])
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_kernel_by_hand():
    """Subsequences of the marked word ^abcd that have 4 letters: ^abc and abcd whole, three with one gap."""
    _, sub, weight = features(["abcd"])
    raw = {s: w for s, w in zip(sub.tolist(), (weight / weight.max()).tolist(), strict=True)}
    code = lambda *c: ((c[0] * 32 + c[1]) * 32 + c[2]) * 32 + c[3]
    assert raw == {code(0, 1, 2, 3): 1, code(1, 2, 3, 4): 1, code(0, 2, 3, 4): DECAY, code(0, 1, 3, 4): DECAY, code(0, 1, 2, 4): DECAY}
    assert abs((weight**2).sum() - 1) < 1e-9


def test_word_values_are_kernel_sums():
    m = Machine(np.random.default_rng(1).normal(size=1 << 20).astype(np.float32), 0.5, np.ones(3), 0.0)
    words = ["", "a", "12", "abcd", "straße", "i.d.i.o.t", "verylongcompoundword" * 9, "été"]
    w, s, v = features(words)
    assert np.allclose(m.words(words), np.bincount(w, v * m.weights[s], minlength=len(words)) + 0.5, atol=1e-4)


def test_held_out_accuracy(spark):
    rows = corpus(1)
    m = fit_texts([t for _, t, _ in rows], [bool(y) for *_, y in rows])
    fresh = corpus(2)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in fresh] + [(1000, None, "x"), (1001, "", "x"), (1002, "g r o b n i x", "x"), (1003, "g.r.o.b.n.i.x you", "x")],
                               "doc_id long, text string, toxicity string")
    out, name = score(df, m)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    right = np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in fresh])
    assert right > 0.95 and got[1000] == got[1001] < 0.7 <= min(got[1002], got[1003])
    assert all(0 <= v <= 1 for v in got.values()) and score(df.limit(0), m)[0].count() == 0


def test_training_reads_only_its_rows(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (7, None)], "doc_id long, text string")
    wrong = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    good, bad = (spark.createDataFrame([(i, f(i, y)) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int") for f in (lambda i, y: y, wrong))
    a, b = train(docs, good), train(docs, bad)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.slopes, b.slopes)
    kept = docs.where("doc_id is not null").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in kept)
    empty = train(docs, good.limit(0))
    assert score(docs, empty)[0].count() == 302 and not empty.weights.any()


def test_machine_solves_the_margin_problem():
    """The solver against plain gradient descent on the same loss."""
    rng = np.random.default_rng(3)
    x, times = rng.normal(size=(200, 5)), rng.integers(1, 4, 200).astype(float)
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 * rng.normal(size=200) > 0.2, 1.0, -1.0)
    share = times * np.where(y > 0, 0.5 / times[y > 0].sum(), 0.5 / times[y < 0].sum())

    def loss(w, b):
        return 1e-2 * (w @ w) + (share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    w, b = np.zeros(5), 0.0
    for _ in range(20_000):
        inside = 2 * share * y * np.maximum(0, 1 - y * (x @ w + b))
        w, b = w - 0.1 * (2e-2 * w - inside @ x), b + 0.1 * inside.sum()
    got = _svm(x, y, times, penalty=1e-2)
    assert loss(*got) <= loss(w, b) + 1e-6


def test_all_insults_of_a_document_are_learnt():
    """Ten insults, three a document: each one alone is a worst word somewhere."""
    rng = random.Random(6)
    bad = ["pathetic", "trash", "idiot", "worthless", "moron", "scum", "loser", "stupid", "disgusting", "clown"]
    rows = []
    for i in range(900):
        words, toxic = [word(rng) for _ in range(rng.randrange(100, 300))], i % 8 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((" ".join(words), toxic))
    machine = fit_texts([t for t, _ in rows[:600]], [y for _, y in rows[:600]])
    values = machine.words(bad)
    assert (values > 0).all()
    held = [(sorted(machine.words(sorted(set(t.split()))))[::-1][:3], y) for t, y in rows[600:]]
    hit = machine.probability(np.array([v for v, _ in held])) >= 0.7
    truth = np.array([y for _, y in held])
    assert hit[truth].mean() >= 0.95 and hit[~truth].mean() <= 0.02


def test_very_long_text(spark):
    rows = [(i, t) for i, t, _ in corpus(9, 200)] + [(1000, "the sea on " * 200_000 + "grobnix trakul"), (1001, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(9, 200)], "doc_id long, toxic int")
    scored, out = score(docs, train(docs, labels))
    got = {r["doc_id"]: r[out] for r in scored.collect()}
    assert got[1000] > got[1001] and 0 <= got[1001] <= 1
