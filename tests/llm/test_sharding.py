import random
import zlib

from callgrain.llm import sharding
from callgrain.llm.sharding import shard

SCHEMA = "doc_id long, text string, lang string, source string, shard string"


def run(spark, rows, n=8):
    return [r.asDict() for r in shard(spark.createDataFrame(rows, SCHEMA), n).collect()]


def rows(n, seed=1):
    rng = random.Random(seed)
    out = [(i, "w " * rng.randrange(1, 300) + str(i), rng.choice(["en", "de", None]), f"s{rng.randrange(5)}", "x") for i in range(n)]
    return out + [(n + i, "a copied text " * 9, "en", "hot", "x") for i in range(n // 3)] + [(2 * n, None, None, None, None), (2 * n + 1, "", "", "", "")]


def test_balance_slots_and_groups(spark):
    data = rows(3000)
    got = run(spark, data)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in data)
    texts, total, slots, of_text = {r[0]: r[1] or "" for r in data}, {}, {}, {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of_text.setdefault(raw, set()).add(r["shard"])
    assert set(total) == set(range(8)) and max(total.values()) < 1.02 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(of_text[b""]) == 1


def test_other_counts_and_small_tables(spark):
    assert run(spark, []) == []
    assert [r["shard"] in range(8) for r in run(spark, [(1, "x", "en", "s", "")])] == [True]
    got = run(spark, [(1, "same", None, None, None)] * 50 + [(None, None, None, None, None)], 3)
    assert len(got) == 51 and sorted(r["slot"] for r in got if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in got)))


def test_missing_metadata(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(100)], "doc_id long, text string")
    assert shard(df, 3).count() == 100


def test_small_groups_stay_whole(spark):
    """Pairs and triples of copies among 1,000 documents, each far below a fiftieth of a shard's bytes."""
    rng = random.Random(3)
    data = rows(400)[:400]
    data += [(1000 + 10 * i + j, f"copy {i} " * rng.randrange(3, 40), rng.choice(["en", "de"]), f"s{j}", "") for i in range(150) for j in range(rng.choice([2, 2, 3]))]
    texts, group = {}, {}
    for i, t, lang, source, x in data:  # the same text within a group
        texts[i] = group.setdefault(i // 10, t) if i >= 1000 else t
    data = [(i, texts[i], lang, source, x) for i, _, lang, source, x in data]
    got = run(spark, data)
    total = sum(r["size"] for r in got)
    shards, weight = {}, {}
    for r in got:
        t = texts[r["doc_id"]]
        shards.setdefault(t, set()).add(r["shard"])
        weight[t] = weight.get(t, 0) + r["size"]
    small = [t for t in shards if weight[t] <= sharding.WHOLE_SHARE * total / 8]
    assert sum(t.startswith("copy") for t in small) > 50 and all(len(shards[t]) == 1 for t in small)
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) < 1.06 * min(sizes.values())


def brute_shards(points, shards, dims):
    """The same recursion over sorted lists of (positions, bytes)."""
    out = {}

    def cut(members, first, k):
        if k == 1 or not members:
            out.update({m["name"]: first for m in members})
            return
        span = {d: max(m[f"p_{d}"] for m in members) - min(m[f"p_{d}"] for m in members) for d in dims}
        d = max(dims, key=lambda d: span[d])
        ordered = sorted(members, key=lambda m: m[f"p_{d}"])
        goal, upto, last = sum(m["bytes"] for m in members) * (k // 2) / k, 0, None
        for m in ordered:
            if upto + m["bytes"] >= goal:
                last = m[f"p_{d}"] if goal - upto >= m["bytes"] / 2 else m[f"p_{d}"] - 1
                break
            upto += m["bytes"]
        cut([m for m in members if m[f"p_{d}"] <= last], first, k // 2)
        cut([m for m in members if m[f"p_{d}"] > last], first + k // 2, k - k // 2)

    cut(points, 0, shards)
    return out


def test_cuts_against_sorting(spark):
    rng = random.Random(5)
    made = [(i, rng.randrange(1, 500), rng.getrandbits(32), rng.randrange(1000), rng.choice([1, 5, None]), rng.randrange(10**12)) for i in range(700)]
    points = spark.createDataFrame(made, "name long, bytes long, tie long, x long, y long, z long")
    dims = ["x", "y", "z"]
    placed = [r.asDict() for r in sharding._positions(points, dims).collect()]
    for shards in (2, 5, 8):
        got = {r["name"]: r["shard"] for r in sharding.shard_points(points, shards, dims).collect()}
        assert got == brute_shards(placed, shards, dims)


def test_very_long_texts(spark):
    data = rows(60)[:60] + [(900, "long text " * 300_000, "en", "s", ""), (901, "long text " * 300_000, "de", "s", "")]
    got = {r["doc_id"]: r for r in run(spark, data)}
    assert got[900]["size"] == 3_000_001 and got[900]["shard"] != got[901]["shard"] and len(got) == 62
