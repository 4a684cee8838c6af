import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from callgrain.llm import alignment as op
from callgrain.llm import queries
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    known = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in known]
    return {chr(b): b for b in known} | {chr(256 + n): b for n, b in enumerate(others)}


LETTERS = letters()


def letter_bytes(token):
    return bytes(LETTERS[c] for c in token)


def whole(libraries, text):
    """Tokens of a whole text by the libraries, with their bytes; none if the bytes differ."""
    a, b = libraries
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, letter_bytes(t)) for i, t in zip(found.ids, found.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(libraries, rows):
    facts, counts = [], Counter()
    for name, text in rows:
        left, right = (spans(s) for s in whole(libraries, text))
        links, at = [], 0
        for i, s, e in left:
            while at < len(right) and right[at][2] <= s:
                at += 1
            j = at
            while j < len(right) and right[j][1] < e:
                links.append((i, right[j][0]))
                j += 1
        counts.update(links)
        shared = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, low = [], 0
        for high in shared:
            sides = [[str(i) for i, s, e in side if low <= s and e <= high] for side in (left, right)] if len(left) < 500 else None
            groups.append(sides)
            low = high
        text_of = None if any(g is None for g in groups) else ";".join("|".join(",".join(s) for s in g) for g in groups)
        facts.append((name, len(left), len(right), len(shared), links, text_of))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for name, n_a, n_b, n_groups, links, groups in facts:
        digest = None if groups is None else hashlib.sha256(groups.encode()).hexdigest() if links else ""
        out.append((name, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "straße", "日本語", "😀👍", "naïve", "x", "42", "don't", "\U00012000\U00012001", "á", "<s>", "<|endoftext|>", "<0x41>", "\x00",
             " ", "　", "᠎", "Ωmega", "ﬁ", "in​ner", "\u0085", "\x1c", "ÀÉ", "�", "привет"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n  ", "\t", " \n ", "", "   "]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 30)))
        out.append((i, rng.choice(["", " ", "\n", "  "]) + text if rng.random() < 0.3 else text))
    return out


def got(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


ODD = [(900, None), (901, ""), (902, " "), (903, "a▁b"), (904, "  a  "), (905, "▁"), (906, "\n"), (907, "x "), (907, "x "), (None, "no id")]


def test_against_brute_force(spark, libraries):
    rows = corpus(1, 300) + ODD
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, ids int")
    assert got(op.align(df, A, B)[0]) == brute(libraries, rows)


def test_small_blocks_and_memories(spark, libraries, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_CHARS", 300)
    monkeypatch.setattr(op, "MEMORY_CHARS", 2_000)
    monkeypatch.setattr(op, "LEARN_CHARS", 50)
    rows = corpus(2, 150) + ODD
    assert got(op.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)[0]) == brute(libraries, rows)


def test_very_long_texts(spark, libraries):
    rows = [(1, "word naïve " * 60_000), (2, "ab日" * 30_000), (3, "short")]
    docs, _ = op.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    want = brute(libraries, rows)
    assert [(g[:7], g[7]) if w[7] is not None else g[:7] for g, w in zip(got(docs), want, strict=True)] == [
        (w[:7], w[7]) if w[7] is not None else w[:7] for w in want
    ]


def test_pairs_and_groups(spark, libraries):
    rows = corpus(3, 60)
    docs, pairs = op.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, with_groups=True)
    for r in docs.collect():
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"]
    links = sum(r["n_links"] for r in docs.collect())
    assert links == sum(r["total"] for r in pairs.collect()) and pairs.where("best").count() > 0


def test_empty(spark):
    assert got(op.align(spark.createDataFrame([], "doc_id long, text string"), A, B)[0]) == []


def test_query(spark, libraries, tmp_path):
    rows = corpus(4, 80) + ODD
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.QUERIES["op12_token_alignment"](spark, str(tmp_path))) == brute(libraries, rows)


def batches(texts, rows=64):
    for at in range(0, len(texts), rows):
        some = texts[at : at + rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array(some)], ["doc_id", "text"])


def test_frequent_units_stay_in_a_bounded_memory(monkeypatch):
    monkeypatch.setattr(op, "MEMORY_CHARS", 40_000)
    monkeypatch.setattr(op, "_PAIRS", {})
    learnt, held, learn = Counter(), [], op.Pair.learn

    def noted(self, units):
        learnt.update(units)
        held.append(self.held)
        learn(self, units)

    monkeypatch.setattr(op.Pair, "learn", noted)
    texts = [f"harvest of wheat n{i} n{i}a" for i in range(1_500)]
    blocks = list(op._blocks(A, B, False, pa.int64())(batches(texts)))
    assert [i for b in blocks for i in b.column("ids")[0].as_py()] == list(range(1_500))
    assert {learnt[u] for u in ("harvest", "of", "wheat")} == {1}
    # what the limit allows, and the units of 64 documents
    assert max(held) < 40_000 + 64 * 3 * 80


def test_renewed_units_keep_their_alignment(monkeypatch):
    monkeypatch.setattr(op, "_PAIRS", {})
    texts = [t for _, t in corpus(5, 200)]
    plain = list(op._blocks(A, B, True, pa.int64())(batches(texts)))
    machine = op.pair(A, B)
    machine.renew(op.MEMORY_CHARS)
    assert 0 < len(machine.index) == len(machine.groups) == machine.met.size
    again = list(op._blocks(A, B, True, pa.int64())(batches(texts)))
    for column in ("ids", "n_a", "n_b", "n_groups", "digests", "shown", "codes", "counts"):
        assert [b.column(column)[0].as_py() for b in plain] == [b.column(column)[0].as_py() for b in again]


def test_rows_of_blocks_are_small(monkeypatch):
    monkeypatch.setattr(op, "_PAIRS", {})
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{i}" for i in range(2_000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(400)]
    (block,) = op._blocks(A, B, False, pa.int64())(batches(texts))
    entries = sum(len(set(t.split())) for t in texts)
    # once four bytes for a unit's number and four for its count
    assert sum(len(block.column(c)[0].as_py()) for c in op._BLOBS) < 4 * entries


def test_sums_of_a_block_need_no_tokenizer(monkeypatch):
    monkeypatch.setattr(op, "_PAIRS", {})
    texts = ["a field of rice", "", "rice", "naïve 日本語 rice"]
    (block,) = op._blocks(A, B, False, pa.int64())(batches(texts))
    codes, counts = (block.column(c)[0].values for c in ("codes", "counts"))
    right = pa.table({"code": codes, "total": counts, "best": pa.array([True] * len(codes))})
    assert op._PAIRS
    out = op._sums(pa.int64())(pa.Table.from_batches([block]), right)
    assert not op._PAIRS
    links = out.column("n_links").to_pylist()
    assert sum(links) == sum(counts.to_pylist()) and links[1] == 0 and links == out.column("n_best").to_pylist()


def test_packed_numbers():
    for values in ([], [0], [1, 255, 256, 65_536, 2**31 - 1, 0]):
        found = op._unpacked(op._packed(np.array(values, np.int64)))
        assert found.tolist() == values and found.dtype == np.int64


def test_workers_get_small_batches(spark, tmp_path, monkeypatch):
    plain, seen, name = op._blocks, str(tmp_path / "rows"), "spark.sql.execution.arrow.maxRecordsPerBatch"

    def noting(*args):
        run = plain(*args)

        def noted(given):
            def each():
                for batch in given:
                    with open(seen, "a") as f:
                        f.write(f"{batch.num_rows}\n")
                    yield batch

            return run(each())

        return noted

    monkeypatch.setattr(op, "_blocks", noting)
    before = spark.conf.get(name)
    rows = [(i, f"row {i % 7}") for i in range(2_000)]
    assert op.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)[0].count() == 2_000
    assert max(map(int, open(seen))) <= op.BATCH_ROWS < 2_000 and spark.conf.get(name) == before
