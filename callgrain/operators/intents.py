"""Intents: group questions and answers, score them, pick what represents each group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callgrain.functions.similarity import cosine
from callgrain.functions.text import norm_text, preview
from callgrain.operators.cluster import NOISE, centroids, density_cluster
from callgrain.operators.embedding import Embedder, embed
from callgrain.operators.hierarchy import density_hierarchy
from callgrain.operators.scoring import score_answer, score_specificity, token_stats
from callgrain.plans.ids import with_ids
from callgrain.plans.skew import skew_join
from callgrain.session import materialize

_MODES = "array<struct<answer_cluster_id:int,KccAns:string>>"
_SUMMARIES = (
    "question_cluster_id int, rep_question string, desc_question string, "
    "best_answer_overall string, best_answer_per_answer_cluster string"
)


@dataclass(frozen=True)
class Clustering:
    """Settings of one clustering: similarity of neighbours and the smallest cluster.

    ``dim`` is that of the default text vectors, ``chunk`` the texts that an embedder gets at once.
    """

    min_cos: float
    min_pts: int
    dim: int = 256
    chunk: int = 256

    def label(self, vectors: DataFrame, id_col: str, label_col: str, partition_col: str | None = None) -> DataFrame:
        return density_cluster(
            vectors, id_col, "embedding", self.min_cos, self.min_pts, partition_col=partition_col, label_col=label_col
        )


@dataclass(frozen=True)
class Hierarchical:
    """Settings of a clustering of variable density: the smallest cluster, and the neighbours that
    make a point's density (as many, if not given)."""

    min_pts: int
    neighbours: int | None = None
    dim: int = 256
    chunk: int = 256
    min_cos: float | None = None  # no single density

    def label(self, vectors: DataFrame, id_col: str, label_col: str, partition_col: str | None = None) -> DataFrame:
        return density_hierarchy(
            vectors, id_col, "embedding", self.min_pts, self.neighbours, partition_col=partition_col, label_col=label_col
        )


@dataclass(frozen=True)
class IntentTables:
    questions: DataFrame
    answers: DataFrame
    summaries: DataFrame
    embeddings: DataFrame
    settings: dict = field(default_factory=dict)


def project_limit(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """Only the wanted columns, optionally only the first rows."""
    out = df.select(*cols)
    return out.limit(limit) if limit else out


def clean_rows(df: DataFrame, key: list[str], text_col: str = "QueryText", answer_col: str = "KccAns") -> DataFrame:
    """Calls with normalised question and answer, written once; calls without a question are left out."""
    cleaned = materialize(
        df.where(F.col(text_col).isNotNull()).select(
            *key,
            F.col(text_col).alias("QueryText"),
            F.col(answer_col).alias("KccAns"),
            norm_text(F.col(text_col)).alias("q_clean"),
            norm_text(F.col(answer_col)).alias("a_clean"),
        ),
        "cleaned",
    )
    # on the stored text: in the same step it would run the rewrite chain a second time
    return cleaned.where(F.col("q_clean") != "")


def _first(cols: list[str], key: list[str]) -> Column:
    """The given columns of the row with the smallest key."""
    return F.min(F.struct(F.struct(*key).alias("k"), *cols))


def distinct_questions(rows: DataFrame, key: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per normalised question, with the first spelling by key; ids follow the sorted text."""
    kept = ["QueryText", *extra]
    first = rows.groupBy("q_clean").agg(_first(kept, key).alias("f"))
    return with_ids(first.select("q_clean", *[F.col(f"f.{c}").alias(c) for c in kept]), "question_id", ["q_clean"])


def cluster_questions(
    questions: DataFrame, how: Clustering | Hierarchical, embedder: Embedder | None = None
) -> tuple[DataFrame, DataFrame]:
    """(questions with question_cluster_id and embedding, embeddings by question_id)."""
    vectors = materialize(embed(questions, "question_id", "q_clean", embedder, how.dim, how.chunk), "vectors")
    labels = how.label(vectors, "question_id", "question_cluster_id")
    out = questions.join(labels, "question_id").join(vectors, "question_id")
    # the scores read it several times
    return materialize(out, "clustered"), vectors


def with_cluster_size(df: DataFrame, cluster_col: str, spread_by: str, out_col: str = "cluster_size") -> DataFrame:
    """Size of each row's cluster; the noise counts as one cluster and may hold most rows."""
    sizes = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias(out_col))
    return skew_join(df, sizes, [cluster_col], [spread_by], "inner")


def representative_scores(
    df: DataFrame, cluster_col: str, vec_col: str, spread_by: str, out_col: str = "rep_score"
) -> DataFrame:
    """Cosine of every row to the centroid of its cluster; 0 for noise."""
    mean = centroids(df.where(F.col(cluster_col) != NOISE), cluster_col, vec_col, "_centroid")
    joined = skew_join(df, mean, [cluster_col], [spread_by], "left")
    return joined.withColumn(out_col, _closeness(vec_col, "_centroid")).drop("_centroid")


def _closeness(vec_col: str, mean_col: str) -> Column:
    score = F.when(F.col(mean_col).isNotNull(), cosine(F.col(vec_col), F.col(mean_col)))
    return F.coalesce(score, F.lit(0.0))


def score_questions(questions: DataFrame) -> DataFrame:
    """spec_score, rep_score, desc_score and cluster_size of clustered questions."""
    stats = materialize(token_stats(questions, "q_clean"), "stats")
    n_docs = questions.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    specific = score_specificity(questions, "question_id", "q_clean", stats, n_docs)
    # size and centroid hang on the cluster alone: one join brings both, to the stored questions
    mean = centroids(questions.where(F.col("question_cluster_id") != NOISE), "question_cluster_id", "embedding", "_centroid")
    sizes = questions.groupBy("question_cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    joined = skew_join(
        questions, sizes.join(mean, "question_cluster_id", "left"), ["question_cluster_id"], ["question_id"], "inner"
    )
    rep = _closeness("embedding", "_centroid")
    return (
        joined.withColumn("rep_score", rep)
        .drop("_centroid")
        .join(specific.select("question_id", "spec_score"), "question_id")
        .withColumn("desc_score", F.col("rep_score") + F.col("spec_score"))
    )


def assign(rows: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """Every call with the cluster of its question; a question may be asked by a third of all callers."""
    labels = questions.select("q_clean", "question_cluster_id")
    return skew_join(rows, labels, ["q_clean"], key, "left")


def best_by(df: DataFrame, groups: list[str], score: str, tie: str, keep: list[str]) -> DataFrame:
    """The row with the highest score per group, the smallest id among equals; combined before the shuffle."""
    best = F.min(F.struct((-F.col(score)).alias("neg"), F.col(tie).alias("tie"), *keep))
    return df.groupBy(*groups).agg(best.alias("_best")).select(*groups, *[F.col(f"_best.{c}").alias(c) for c in keep])


def distinct_answers(rows: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """One row per question cluster and normalised answer, noise and blank answers left out.

    Calls are first reduced to distinct (question, answer) pairs, so repeated calls never reach
    the join.
    """
    pairs = rows.where(F.col("a_clean") != "").groupBy("q_clean", "a_clean").agg(_first(["KccAns"], key).alias("f"))
    pairs = materialize(pairs, "pairs")
    labels = questions.where(F.col("question_cluster_id") != NOISE).select("q_clean", "question_cluster_id")
    joined = skew_join(pairs, labels, ["q_clean"], ["a_clean"], "inner")
    first = joined.groupBy("question_cluster_id", "a_clean").agg(F.min("f").alias("f"))
    return with_ids(
        first.select("question_cluster_id", "a_clean", F.col("f.KccAns").alias("KccAns")),
        "answer_id",
        ["question_cluster_id", "a_clean"],
    )


def score_answers(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """desc_score of each answer; word counts come from all calls, counted once per distinct answer."""
    corpus = rows.groupBy("a_clean").agg(F.count(F.lit(1)).alias("m"))
    stats = materialize(token_stats(corpus, "a_clean", "m"), "stats")
    n_docs = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return score_answer(answers, "answer_id", "a_clean", stats, n_docs)


def cluster_answers(
    rows: DataFrame, questions: DataFrame, key: list[str], how: Clustering | Hierarchical, embedder: Embedder | None = None
) -> DataFrame:
    """Distinct answers of every question cluster, grouped within their cluster and scored."""
    answers = distinct_answers(rows, questions, key)
    vectors = materialize(embed(answers, "answer_id", "a_clean", embedder, how.dim, how.chunk), "vectors")
    keyed = materialize(vectors.join(answers.select("answer_id", "question_cluster_id"), "answer_id"), "keyed-vectors")
    labels = how.label(keyed, "answer_id", "answer_cluster_id", "question_cluster_id").select("answer_id", "answer_cluster_id")
    return score_answers(materialize(answers.join(labels, "answer_id"), "clustered"), rows)


def best_answers(answers: DataFrame, groups: list[str]) -> DataFrame:
    """Best answer per group; grouped by answer cluster, the noise has none."""
    if "answer_cluster_id" in groups:
        answers = answers.where(F.col("answer_cluster_id") != NOISE)
    return best_by(answers, groups, "desc_score", "answer_id", ["KccAns"])


def summaries(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question cluster that has an answer: questions that stand for it and its best answers."""
    group = ["question_cluster_id"]
    clustered = questions.where(F.col("question_cluster_id") != NOISE)

    def top(score: str, name: str) -> Column:
        best = F.min(F.struct((-F.col(score)).alias("neg"), "question_id", "QueryText"))
        return best["QueryText"].alias(name)

    chosen = clustered.groupBy(*group).agg(top("rep_score", "rep_question"), top("desc_score", "desc_question"))
    overall = best_answers(answers, group).withColumnRenamed("KccAns", "best_answer_overall")
    # one entry per answer cluster, not per answer
    modes = (
        best_answers(answers, [*group, "answer_cluster_id"])
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("answer_cluster_id", "KccAns"))).alias("modes"))
    )
    listed = F.to_json(F.coalesce("modes", F.array().cast(_MODES)))
    return (
        chosen.join(overall, group)
        .join(modes, group, "left")
        .select(
            *group, "rep_question", "desc_question", "best_answer_overall",
            listed.alias("best_answer_per_answer_cluster"),
        )
    )


def answer_modes(table: DataFrame, width: int = 800) -> DataFrame:
    """The stored answer list as rows; an unreadable list has none."""
    listed = F.coalesce(
        F.from_json("best_answer_per_answer_cluster", _MODES), F.array().cast(_MODES)
    )
    return table.select("question_cluster_id", F.explode(listed).alias("m")).select(
        "question_cluster_id", "m.answer_cluster_id", preview(F.col("m.KccAns"), width).alias("KccAns")
    )


def build_intents(
    df: DataFrame,
    key: list[str],
    question_clusters: Clustering | Hierarchical,
    answer_clusters: Clustering | Hierarchical,
    embedder: Embedder | None = None,
    text_col: str = "QueryText",
    answer_col: str = "KccAns",
    limit: int | None = None,
    source: str | None = None,
) -> IntentTables:
    """All intent tables of a set of calls, or of the first ``limit`` ones by key.

    ``source`` says in the settings where the calls came from.
    """
    calls = df.orderBy(*key).limit(limit) if limit else df
    rows = clean_rows(calls, key, text_col, answer_col)
    found, vectors = cluster_questions(distinct_questions(rows, key), question_clusters, embedder)
    questions = materialize(score_questions(found).drop("embedding"), "questions")
    answers = materialize(cluster_answers(rows, questions, key, answer_clusters, embedder), "answers")
    settings = {
        "input": source,
        "limit": limit,
        "embedder": getattr(embedder, "__name__", type(embedder).__name__) if embedder else "tf-idf",
        "chunk": question_clusters.chunk,
        "min_cos": question_clusters.min_cos,
        "min_cluster_size": question_clusters.min_pts,
        "answer_min_cos": answer_clusters.min_cos,
        "answer_min_cluster_size": answer_clusters.min_pts,
        "dim": question_clusters.dim,
    }
    return IntentTables(questions, answers, summaries(questions, answers), vectors, settings)


_SETTINGS = (
    "input string, limit long, embedder string, chunk long, min_cos double, min_cluster_size long, answer_min_cos double,"
    " answer_min_cluster_size long, dim long, questions long, answers long, summaries long, embeddings long, question_clusters long"
)


def write_intents(tables: IntentTables, out: str) -> None:
    """Questions, answers, summaries and embeddings as Parquet, the settings as JSON, in a new folder.

    The settings also hold the rows of every table, counted by the pass that writes it.
    """
    facts = dict(tables.settings)
    for name in ("questions", "answers", "summaries", "embeddings"):
        seen, table = Observation(), getattr(tables, name)
        counted = [F.count(F.lit(1)).alias("n")]
        if name == "questions":
            # numbered from 0, noise is -1
            counted.append((F.coalesce(F.max("question_cluster_id"), F.lit(NOISE)) + 1).cast("long").alias("clusters"))
        table.observe(seen, *counted).write.mode("errorifexists").parquet(f"{out}/{name}")
        facts[name] = seen.get["n"]
        facts["question_clusters"] = seen.get.get("clusters", facts.get("question_clusters"))
    spark = tables.questions.sparkSession
    row = [facts.get(c.split()[0]) for c in _SETTINGS.split(", ")]
    spark.createDataFrame([row], _SETTINGS).write.option("ignoreNullFields", False).json(f"{out}/settings")


def read_settings(spark: SparkSession, out: str) -> DataFrame:
    """The stored settings of a run, one row."""
    return spark.read.schema(_SETTINGS).json(f"{out}/settings")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Stored summaries, or an empty table where there are none yet."""
    try:
        return spark.read.schema(_SUMMARIES).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SUMMARIES)
