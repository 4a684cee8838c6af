import random

import pytest
from pyspark.sql import functions as F

from callgrain.operators import names as N


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(targets, choices, threshold):
    out = {}
    for t in targets:
        scored = [(-round(200 * lcs(t, c) / (len(t) + len(c))), c) for c in choices if t and c]
        best = min(scored, default=(0, None))
        out[t] = best[1] if -best[0] >= threshold else None
    return out


@pytest.mark.parametrize("threshold", [30, 50, 70, 80, 90, 100])
def test_blocked_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    choices = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)}
    targets = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(80)} | {""}
    for c in list(choices)[:30]:  # near copies
        i = rng.randrange(len(c) + 1)
        targets.add(c[:i] + rng.choice("abcx") + c[i:])
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    c = spark.createDataFrame([(x,) for x in choices], "choice string")
    got = {r["target"]: r["match"] for r in N.match_names(t, c, threshold=threshold).collect()}
    assert got == brute(targets, choices, threshold)


def test_overrides_and_review_lists(spark):
    t = spark.createDataFrame([("hissar",), ("hissar",), ("zzz",), ("barddhaman",), (None,)], "target string")
    c = spark.createDataFrame([("hisar",), ("bardhaman",), ("Delhi (East)",)], "choice string")
    o = spark.createDataFrame([("zzz", "Delhi (East)")], "raw string, official string")
    m = N.match_names(t, c, o)
    got = {r["target"]: (r["match"], r["score"], r["via"]) for r in m.collect()}
    assert got == {
        "hissar": ("hisar", 91, "fuzzy"), "barddhaman": ("bardhaman", 95, "fuzzy"), "zzz": ("Delhi (East)", None, "override"),
    }
    plain = N.match_names(t, c)
    assert [r["target"] for r in N.unmatched(plain).collect()] == ["zzz"]
    assert [r["choice"] for r in N.remaining(c, plain).collect()] == ["Delhi (East)"]


def test_threshold_and_ties(spark):
    t = spark.createDataFrame([("abcde",)], "target string")
    c = spark.createDataFrame([("abcdx",), ("abcdy",)], "choice string")
    assert N.match_names(t, c, threshold=80).first()["match"] == "abcdx"
    assert N.match_names(t, c, threshold=81).first()["match"] is None
    with pytest.raises(ValueError):
        N.match_names(t, c, threshold=0)


def test_no_cross_join(spark):
    t = spark.createDataFrame([("abcde",)], "target string").withColumn("target", F.upper("target"))
    c = spark.createDataFrame([("abcdx",)], "choice string")
    plan = N.match_names(t, c)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_suggest(spark):
    df = spark.createDataFrame([("Agra",), ("Nagra",), ("Delhi",)], "d string")
    assert [r[0] for r in N.suggest(df, "d", "GRA", 5).collect()] == ["Agra", "Nagra"]


@pytest.mark.parametrize("threshold", [30, 60, 80, 90])
def test_heavy_keys_are_cut_on_both_sides(spark, threshold, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_PER_TASK", 40)
    monkeypatch.setattr(N, "SIDE", 5)
    rng = random.Random(threshold)
    # short names, and long ones that share a segment
    targets = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {f"pur{rng.choice('xyz') * 2}{i % 7}pur" for i in range(60)}
    choices = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(30)} | {f"pur{rng.choice('xyz') * 2}{i % 5}pur" for i in range(40)}
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    c = spark.createDataFrame([(x,) for x in choices], "choice string")
    got = {r["target"]: r["match"] for r in N.match_names(t, c, threshold=threshold).collect()}
    assert got == brute(targets, choices, threshold)


def test_no_task_gets_a_heavy_key_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_PER_TASK", 10_000)
    monkeypatch.setattr(N, "SIDE", 100)
    keys = "g string, a_len int, b_len int, key struct<seg int, text string>"
    t = spark.createDataFrame([("", 4, 4, (-1, "a"), f"t{i}") for i in range(3000)] + [("", 5, 5, (0, "x"), "u")], keys + ", a string")
    c = spark.createDataFrame([("", 4, 4, (-1, "a"), f"c{i}") for i in range(300)] + [("", 5, 5, (0, "x"), "v")], keys + ", b string")
    seen = {}
    real = N.skew_join

    def spy(left, right, on, by, how):
        seen[by[0]] = right.collect()
        return real(left, right, on, by, how)

    monkeypatch.setattr(N, "skew_join", spy)
    pairs = N._met(t, c, 901_000)
    assert pairs.count() == 900_001 == pairs.select("a", "b").distinct().count()
    assert [(r["t_parts"], r["c_parts"]) for r in seen["a"]] == [(30, 3)]


def test_groups_are_apart(spark):
    t = spark.createDataFrame([("S1", "hisar"), ("S2", "hisar"), ("S3", "hisar"), (" s1 ", "hissar"), (None, "hisar")], "state string, target string")
    c = spark.createDataFrame([("S1", "Hisar"), ("s2", "hisaar"), ("S4", "hisar")], "state string, choice string")
    o = spark.createDataFrame([("S2", "hisar", "fixed")], "state string, raw string, official string")
    got = {(r["state"], r["target"]): r["match"] for r in N.match_names(t, c, o, group_col="state").collect()}
    assert got == {("S1", "hisar"): "Hisar", ("S2", "hisar"): "fixed", ("S3", "hisar"): None, (" s1 ", "hissar"): "Hisar", (None, "hisar"): None}
