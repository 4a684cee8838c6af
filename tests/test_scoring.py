import pytest
from pyspark.sql import functions as F

from callgrain.operators import scoring as S

TEXTS = {1: "a b c d e12", 2: "a b", 3: "a", 4: "", 5: "x² १२ y z", 6: "w " * 300 + "।"}


# Worked out by hand for each text: words with a count of 2 or less are rare here ('a' and 'w' are not).
SPEC = {1: 1.0275, 2: 0.203, 3: 0.001, 4: 0.0, 5: 1.3225, 6: 1.0033222591}
ANSWER = {1: 0.4902083333, 2: 0.251875, 3: 0.000625, 4: 0.0, 5: 0.630625, 6: 0.9545722591}


def test_scores(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, t string")
    stats = S.token_stats(df, "t")
    counts = {r["token"]: r["n"] for r in stats.collect()}
    assert counts["a"] == 3 and counts["w"] == 300
    n = df.agg(F.count(F.lit(1))).scalar()
    spec = {r["id"]: r["spec_score"] for r in S.score_specificity(df, "id", "t", stats, n).collect()}
    ans = {r["id"]: r["desc_score"] for r in S.score_answer(df, "id", "t", stats, n).collect()}
    assert spec == pytest.approx(SPEC)
    assert ans == pytest.approx(ANSWER)


def test_weighted_counts(spark):
    df = spark.createDataFrame([("a b a", 3), ("b", 2)], "t string, m int")
    assert {r["token"]: r["n"] for r in S.token_stats(df, "t", "m").collect()} == {"a": 6, "b": 5}


def test_frequent_words_leave_early(spark):
    # 'the' is frequent, w* are rare, m is neither
    rows = [(i, f"the the m w{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, t string")
    rare = S.count_rare(df, "id", "t", S.token_stats(df, "t"), F.lit(3000))
    assert rare.where("rare = 1").count() == 3000
