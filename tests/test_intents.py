import numpy as np
from pyspark.sql import functions as F

from callgrain.operators import intents as N
from callgrain.operators.embedding import embed

ROWS = (
    [(i, f"Weather in agra, day {i}?", f"rain on day {i} " + "more words " * (i % 4)) for i in range(6)]
    + [(10 + i, "PM-Kisan status", f"paid instalment {i % 2}") for i in range(4)]
    + [(20, "pm kisan  STATUS", "paid"), (21, None, "x"), (22, "?!", "y"), (23, "lonely question", "")]
)


def toy_model():
    """The first letter decides, the length nudges; a local function, so that it travels to the workers."""
    import numpy as np

    def first_letter(texts):
        out = np.zeros((len(texts), 27))
        for i, t in enumerate(texts):
            out[i, (ord(t[0]) - 97) % 27] = 10
            out[i, 26] = len(t) % 3
        return out

    return first_letter


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "a"), (3, "")], "id long, t string")
    own = {r["id"]: r["embedding"] for r in embed(df.where("id < 3"), "id", "t", toy_model(), chunk=1).collect()}
    assert len(own) == 2 and abs(np.linalg.norm(own[1]) - 1) < 1e-6
    default = {r["id"]: r["embedding"] for r in embed(df, "id", "t", dim=16).collect()}
    assert len(default[1]) == 16 and abs(np.linalg.norm(default[1]) - 1) < 1e-6 and not any(default[3])
    assert embed(df.where("id > 9"), "id", "t").count() == 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, QueryText string, KccAns string")
    how = N.Clustering(0.9, 2)
    tables = N.build_intents(df, ["id"], N.Clustering(0.9, 3), how, toy_model())
    questions = tables.questions.orderBy("question_id").collect()
    # 'weather..' x 6 are one cluster; the two spellings of the other question are one row
    assert [q["question_id"] for q in questions] == list(range(8))
    clusters = {q["q_clean"]: q["question_cluster_id"] for q in questions}
    assert {v for k, v in clusters.items() if k.startswith("weather")} == {0}
    assert clusters["pmkisan status"] == -1 == clusters["lonely question"]
    assert {q["cluster_size"] for q in questions if q["question_cluster_id"] == 0} == {6}
    assert all(q["rep_score"] == 0 for q in questions if q["question_cluster_id"] == -1)
    summary = tables.summaries.collect()
    assert len(summary) == 1
    top = max((q for q in questions if q["question_cluster_id"] == 0), key=lambda q: (q["desc_score"], -q["question_id"]))
    assert summary[0]["desc_question"] == top["QueryText"]
    best = max(tables.answers.collect(), key=lambda a: (a["desc_score"], -a["answer_id"]))
    assert summary[0]["best_answer_overall"] == best["KccAns"]
    modes = N.answer_modes(tables.summaries).collect()
    assert modes and all(m["answer_cluster_id"] >= 0 for m in modes)

    N.write_intents(tables, str(tmp_path / "out"))
    assert N.read_summaries(spark, str(tmp_path / "out" / "summaries")).count() == 1
    assert spark.read.json(str(tmp_path / "out" / "settings")).first()["min_cluster_size"] == 3
    assert N.read_summaries(spark, str(tmp_path / "none")).count() == 0

    rows = N.clean_rows(df, ["id"])
    labelled = {r["id"]: r["question_cluster_id"] for r in N.assign(rows, tables.questions, ["id"]).collect()}
    assert labelled[0] == 0 and labelled[10] == -1 and 22 not in labelled


def test_bad_answer_list(spark):
    df = spark.createDataFrame([(1, "not json"), (2, '[{"answer_cluster_id":0,"KccAns":"ä"}]'), (3, None)],
                               "question_cluster_id int, best_answer_per_answer_cluster string")
    assert [tuple(r) for r in N.answer_modes(df).collect()] == [(2, 0, "ä")]


def test_first_spelling_and_project(spark):
    df = spark.createDataFrame(ROWS, "id long, QueryText string, KccAns string")
    q = N.distinct_questions(N.clean_rows(df, ["id"]), ["id"])
    assert q.where(F.col("q_clean") == "pmkisan status").first()["QueryText"] == "PM-Kisan status"
    assert N.project_limit(df, ["id"], 3).count() == 3 and N.project_limit(df, ["id"]).columns == ["id"]
