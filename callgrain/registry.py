"""The registered queries, one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callgrain import bindings as B
from callgrain.functions.text import (
    keep_directions, norm_name, norm_query, norm_text, repair_name,
)
from callgrain.operators import cluster, explore, geo, hierarchy, ingest, intents, names, profiles, scoring
from callgrain.operators.embedding import embed
from callgrain.plans.ids import with_ids
from callgrain.session import materialize, new_dir
from callgrain.sources import call_store, page_api, text_index
from callgrain.sources import geo as geo_source
from callgrain.sources import transcripts as src
from callgrain.streaming import distinct
from callgrain.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


# --- sources and sinks ---------------------------------------------------------------------------

CALL_NAMES = ["row_id", "StateName", "DistrictName", "Crop", "QueryType", "Year", "Month"]
CALL_TEXT_SCHEMA = StructType([StructField(c, StringType()) for c in CALL_NAMES])


@query
def scan_parquet(spark, sf_dir):
    return src.read_transcripts(spark, f"{sf_dir}/orders.parquet")


def _call_line_files(spark, sf_dir) -> str:
    path = new_dir(spark, "lines")
    B.call_lines(spark, sf_dir).write.text(path)
    return path


@query
def scan_csv(spark, sf_dir):
    return src.read_transcripts(
        spark, _call_line_files(spark, sf_dir), "csv", CALL_TEXT_SCHEMA, multi_line=False, header=False
    )


@query
def csv_header_names(spark, sf_dir):
    path = new_dir(spark, "titles")
    calls = B.calls_dim(spark, sf_dir).select("row_id", "StateName", "Crop")
    src.write_csv(calls.toDF("row id", "State Name", "Crop"), path)
    return src.read_transcripts(spark, path, "csv")


@query
def scan_project_limit(spark, sf_dir):
    # the first rows of a table are any rows; a sort makes the choice repeatable
    docs = B.table(spark, sf_dir, "documents").orderBy("doc_id")
    return intents.project_limit(docs, ["doc_id", "source"], 500)


@query
def quarantine_rows(spark, sf_dir):
    _, bad = src.split_malformed(
        spark, _call_line_files(spark, sf_dir), CALL_TEXT_SCHEMA, multi_line=False, header=False
    )
    return bad


@query
def quarantine_good_rows(spark, sf_dir):
    good, _ = src.split_malformed(
        spark, _call_line_files(spark, sf_dir), CALL_TEXT_SCHEMA, multi_line=False, header=False
    )
    return good.select("row_id", "Month")


@query
def complete_lines(spark, sf_dir):
    """Calls in one file per year; the break is in front of a line, so each file's last one has none."""
    path = new_dir(spark, "cut")
    calls = B.calls_dim(spark, sf_dir)
    line = F.concat(F.lit("\n"), F.concat_ws(",", *CALL_NAMES))
    calls.withColumn("y", F.col("Year")).repartition("y").sortWithinPartitions("y", "row_id").select("y", line.alias("value")).write.option(
        "lineSep", ","
    ).partitionBy("y").text(path)
    # the comma in the place of the break makes one more, empty field
    schema = StructType([*CALL_TEXT_SCHEMA.fields, StructField("rest", StringType())])
    good, _ = src.read_complete(spark, path, schema, header=False)
    return good.drop("rest")


def _stored_calls(spark, sf_dir) -> str:
    """All calls, and after that 1997 again without those of one state."""
    path = new_dir(spark, "calls")
    calls = B.calls_dim(spark, sf_dir)
    call_store.write_calls(calls, path)
    call_store.write_calls(calls.where("Year = 1997 AND StateName != 'ASIA'"), path)
    return path


@query
def stored_calls(spark, sf_dir):
    stored = call_store.read_calls(spark, _stored_calls(spark, sf_dir))
    return stored.withColumn("Year", F.col("Year").cast("bigint"))


@query
def stored_filter(spark, sf_dir):
    stored = call_store.read_calls(spark, _stored_calls(spark, sf_dir))
    facets = {"Year": [1995, 1997], "StateName": ["ASIA", "EUROPE"]}
    return explore.facet_filter(stored, facets, month=3).withColumn("Year", F.col("Year").cast("bigint"))


@query
def stored_group_samples(spark, sf_dir):
    path = new_dir(spark, "calls")
    docs = B.docs_text(spark, sf_dir).withColumns({"KccAns": F.col("DistrictName"), "Year": (F.col("doc_id") % 3).cast("string")})
    call_store.write_calls(docs, path, "QueryText")
    stored = call_store.read_calls(spark, path)
    most = stored.where("QueryNorm != ''").groupBy("QueryNorm").count().orderBy(F.desc("count"), "QueryNorm").first()["QueryNorm"]
    return explore.group_samples(stored, most, ["doc_id"], width=400, norm_col="QueryNorm")


@query
def page_stream(spark, sf_dir):
    """The events from a paged source in two runs: the first ends at an error page, mended before the second."""
    events, base = B.table(spark, sf_dir, "events"), new_dir(spark, "api")
    broken = F.floor(F.col("event_id") / B.PAGE_ROWS) == 4
    B.event_pages(events.where(~broken), f"{base}/pages")
    B.error_pages(events.where(broken).select(_page_offset()).distinct(), f"{base}/pages", ['{"error":"limit, reached"}'])
    names = B.EVENT_SCHEMA.fieldNames()
    page_api.load_pages(spark, page_api.FolderApi(f"{base}/pages", B.PAGE_ROWS), names, f"{base}/out", f"{base}/checkpoint")
    B.event_pages(events, f"{base}/mended")
    page_api.load_pages(spark, page_api.FolderApi(f"{base}/mended", B.PAGE_ROWS), names, f"{base}/out", f"{base}/checkpoint")
    return B.typed_events(page_api.loaded_pages(spark, f"{base}/out"))


@query
def stream_distinct(spark, sf_dir):
    """The events in three deliveries, each with copies of rows of the one before."""
    base = new_dir(spark, "distinct")
    events = B.table(spark, sf_dir, "events").select(*[F.col(c).cast("string") for c in B.EVENT_TYPES])
    events.write.parquet(f"{base}/raw")
    events = spark.read.parquet(f"{base}/raw")
    number = F.col("event_id").cast("bigint")
    for part in range(3):
        late = (number % 3 == (part + 2) % 3) & (number % 4 == 0) if part else F.lit(False)
        events.where((number % 3 == part) | late).coalesce(2).write.mode("append").parquet(f"{base}/in")
        distinct.distinct_stream(
            spark, f"{base}/in", B.EVENT_SCHEMA, f"{base}/out", f"{base}/checkpoint", ["event_id", "ts"], "ts", "2 days"
        )
    return distinct.distinct_rows(spark, f"{base}/out", B.EVENT_SCHEMA).withColumns({c: F.col(c).cast(k) for c, k in B.EVENT_TYPES.items()})


@query
def pages_union(spark, sf_dir):
    return B.typed_events(src.read_pages(spark, B.fresh_pages(spark, sf_dir), B.EVENT_SCHEMA))


def _page_offset() -> Column:
    return (F.floor(F.col("event_id") / B.PAGE_ROWS) * B.PAGE_ROWS).alias("offset")


def _failed() -> Column:
    """Events of every fifth page, which the server answers with an error message."""
    return F.floor(F.col("event_id") / B.PAGE_ROWS) % 5 == 4


def _pages_with_errors(spark, sf_dir, lines: list[str]) -> str:
    events = B.table(spark, sf_dir, "events")
    path = B.event_pages(events.where(~_failed()), new_dir(spark, "pages"))
    return B.error_pages(events.where(_failed()).select(_page_offset()).distinct(), path, lines)


@query
def valid_pages(spark, sf_dir):
    # the second line of the message has as many fields as an event
    path = _pages_with_errors(spark, sf_dir, ['{"error": "no page",', " try again, later, or, ask, the, desk}"])
    return B.typed_events(src.drop_error_pages(spark, path, B.EVENT_SCHEMA))


@query
def missing_after_errors(spark, sf_dir):
    path = _pages_with_errors(spark, sf_dir, ['{"error":"limit, reached"}'])
    total = B.table(spark, sf_dir, "events").count()
    loaded = src.page_manifest(spark, path).where(~F.col("is_error"))
    return ingest.missing_offsets(spark, loaded, total, B.PAGE_ROWS)


def _page_manifest(spark, sf_dir) -> tuple[DataFrame, int]:
    events = B.table(spark, sf_dir, "events")
    page = F.floor(F.col("event_id") / 100)
    manifest = events.where(page % 7 != 3).select((page * 100).alias("offset")).distinct()
    return manifest, events.count()


@query
def missing_pages(spark, sf_dir):
    manifest, total = _page_manifest(spark, sf_dir)
    return ingest.missing_offsets(spark, manifest, total, 100)


@query
def page_progress(spark, sf_dir):
    manifest, total = _page_manifest(spark, sf_dir)
    return ingest.page_progress(spark, manifest, total, 100)


def _deliveries(spark, sf_dir):
    """Loads the events in two deliveries of pages and yields the stored folder after each.

    The pages that fail in the first delivery arrive with the second, which also repeats every
    fourth row of the first.
    """
    events = B.table(spark, sf_dir, "events")
    base = new_dir(spark, "stream")
    half = F.floor(F.col("event_id") / B.PAGE_ROWS) % 2 == 0
    B.event_pages(events.where(half & ~_failed()), f"{base}/pages")
    B.error_pages(events.where(_failed()).select(_page_offset()).distinct(), f"{base}/pages", ['{"error":"limit, reached"}'])
    stream.ingest(spark, f"{base}/pages", base, f"{base}/checkpoint", B.EVENT_SCHEMA, event_time="ts")
    yield base
    B.event_pages(events.where(~half | _failed() | (F.col("event_id") % 4 == 0)), f"{base}/pages")
    stream.ingest(spark, f"{base}/pages", base, f"{base}/checkpoint", B.EVENT_SCHEMA, event_time="ts")
    yield base


@query
def ingest_stream(spark, sf_dir):
    *_, base = _deliveries(spark, sf_dir)
    return B.typed_events(stream.ingested(spark, base)).select(*B.EVENT_SCHEMA.fieldNames())


@query
def quarantined_pages(spark, sf_dir):
    *_, base = _deliveries(spark, sf_dir)
    return stream.quarantined(spark, base).where("bad_page")


@query
def stream_counts(spark, sf_dir):
    for base in _deliveries(spark, sf_dir):
        counts = stream.running_counts(spark, base, ["event_type"], f"{base}/counts", f"{base}/counts-checkpoint")
    return counts


@query
def api_slice(spark, sf_dir):
    return ingest.slice_rows(
        B.calls_dim(spark, sf_dir), {"Year": 1997, "StateName": "ASIA"}, ["row_id"], 100, 500
    )


@query
def dedup_rows(spark, sf_dir):
    return ingest.dedup(B.table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query
def merge_years(spark, sf_dir):
    calls = B.calls_dim(spark, sf_dir)
    years = [r["Year"] for r in calls.select("Year").distinct().orderBy("Year").collect()]  # one row per year
    return ingest.merge_years([calls.where(F.col("Year") == y) for y in years], " asia ")


@query
def sample_n(spark, sf_dir):
    return ingest.sample_n(B.table(spark, sf_dir, "documents"), ["doc_id"], 300, seed=7).select("doc_id", "lang")


@query
def keyword_catalog(spark, sf_dir):
    return ingest.keyword_catalog(B.table(spark, sf_dir, "part"), "p_name", "p_partkey", "Widget", ["red", "blue"])


@query
def sink_csv(spark, sf_dir):
    path = new_dir(spark, "csv")
    src.write_csv(B.calls_dim(spark, sf_dir), path)
    return src.read_transcripts(spark, path, "csv", CALL_TEXT_SCHEMA)


# --- explorer ------------------------------------------------------------------------------------


@query
def facet_filter(spark, sf_dir):
    facets = {
        "StateName": ["ASIA", "EUROPE"], "DistrictName": [], "Crop": ["MACHINERY", "FURNITURE"],
        "QueryType": ["1-URGENT", "2-HIGH"],
    }
    return explore.facet_filter(B.calls_dim(spark, sf_dir), facets, month=3)


@query
def filter_month(spark, sf_dir):
    return explore.facet_filter(B.calls_dim(spark, sf_dir), month=7)


@query
def search_text(spark, sf_dir):
    return explore.facet_filter(B.calls_text(spark, sf_dir), search="  ERING|auou[a-d] ")


@query
def search_text_literal(spark, sf_dir):
    return explore.facet_filter(B.calls_text(spark, sf_dir), search="Tion.", regex=False)


@query
def search_indexed(spark, sf_dir):
    """The search of ``search_text`` over stored files, of which those without its trigrams are not read."""
    base = new_dir(spark, "indexed")
    B.calls_text(spark, sf_dir).repartitionByRange(8, "conv_id").write.parquet(f"{base}/calls")
    text_index.build_index(spark, f"{base}/calls", f"{base}/grams", ("QueryText", "KccAns"))
    return text_index.search(spark, f"{base}/calls", f"{base}/grams", "  ERING|auou[a-d] ", ("QueryText", "KccAns"))


@query
def facet_values(spark, sf_dir):
    return explore.facet_values(B.calls_dim(spark, sf_dir), "DistrictName")


@query
def facet_months(spark, sf_dir):
    return explore.facet_months(B.calls_dim(spark, sf_dir))


@query
def default_query_type(spark, sf_dir):
    return explore.default_option(B.calls_dim(spark, sf_dir), "QueryType", ["Not", "specified"])


@query
def overview_counts(spark, sf_dir):
    return explore.overview(B.calls_dim(spark, sf_dir), F.col("QueryType") == "1-URGENT")


@query
def count_by(spark, sf_dir):
    return explore.count_by(B.calls_dim(spark, sf_dir), ["StateName", "DistrictName", "Crop"])


def _top(col):
    return lambda spark, sf_dir: explore.count_by(B.calls_dim(spark, sf_dir), [col], 10)


QUERIES["top_districts"] = _top("DistrictName")
QUERIES["top_states"] = _top("StateName")
QUERIES["top_query_types"] = _top("QueryType")
QUERIES["top_crops"] = _top("Crop")


@query
def norm_query_text(spark, sf_dir):
    return B.docs_text(spark, sf_dir).select("doc_id", norm_query(F.col("QueryText")).alias("norm"))


@query
def norm_intent_text(spark, sf_dir):
    return B.docs_text(spark, sf_dir).select("doc_id", norm_text(F.col("QueryText")).alias("norm"))


@query
def top_query_texts(spark, sf_dir):
    return explore.top_query_texts(B.docs_text(spark, sf_dir), 50)


@query
def descriptive_answers(spark, sf_dir):
    return explore.descriptive_answers(B.calls_text(spark, sf_dir), 50).select(
        "QueryText", "count", "max_ans_len", *rounded("avg_ans_len")
    )


@query
def longest_answers(spark, sf_dir):
    return explore.longest_answers(
        B.calls_text(spark, sf_dir), ["conv_id", "turn"], cols=("conv_id", "turn", "QueryText", "KccAns")
    )


@query
def group_samples(spark, sf_dir):
    docs = B.docs_text(spark, sf_dir).withColumn("KccAns", F.col("DistrictName"))
    chosen = explore.top_query_texts(docs, 1).first()["QueryText"]
    return explore.group_samples(docs, chosen, ["doc_id"], width=400)


@query
def paged_top_queries(spark, sf_dir):
    grouped = explore.top_query_texts(B.docs_text(spark, sf_dir))
    return explore.page(grouped, [F.desc("count"), "QueryText"], 2, 25)


@query
def page_count(spark, sf_dir):
    return explore.page_count(explore.top_query_texts(B.docs_text(spark, sf_dir)), 50)


# --- profiles ------------------------------------------------------------------------------------


def _targets(spark, sf_dir):
    listed = B.places(spark, sf_dir)
    nowhere = spark.createDataFrame([("ASIA", "NOWHERE")], "StateName string, DistrictName string")
    return listed.select(F.lower("r_name").alias("StateName"), F.col("n_name").alias("DistrictName")).union(nowhere)


PLACE = ["StateName", "DistrictName"]
VAGUE = ("BUILDING", "FURNITURE")


@query
def place_profile(spark, sf_dir):
    return profiles.place_profile(B.calls_dim(spark, sf_dir), _targets(spark, sf_dir), PLACE, others=VAGUE)


@query
def place_top_crop(spark, sf_dir):
    return profiles.place_top(B.calls_dim(spark, sf_dir), _targets(spark, sf_dir), ["StateName"], "Crop", VAGUE)


@query
def place_top_qtype(spark, sf_dir):
    return profiles.place_top(B.calls_dim(spark, sf_dir), _targets(spark, sf_dir), PLACE, "QueryType")


@query
def top_crop_is(spark, sf_dir):
    return profiles.top_value_is(B.calls_dim(spark, sf_dir), "DistrictName", "Crop", "MACHINERY", ("BUILDING",))


# --- geo -----------------------------------------------------------------------------------------


def _feature_lines(spark, sf_dir) -> DataFrame:
    supplier = B.table(spark, sf_dir, "supplier").join(
        B.places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    )
    usual = F.create_map(F.lit("STATE_NAME"), F.col("r_name"), F.lit("DISTRICT"), F.col("s_name"))
    other = F.create_map(
        F.lit("StateName"), F.lit(""), F.lit("NAME_1"), F.col("r_name"), F.lit("NAME_2"), F.col("s_name")
    )
    return supplier.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.when(F.col("s_suppkey") % 2 == 0, usual).otherwise(other).alias("properties"),
                F.struct(
                    F.lit("Point").alias("type"), F.array("s_suppkey", F.col("n_nationkey").cast("bigint")).alias("coordinates")
                ).alias("geometry"),
            )
        ).alias("value")
    )


@query
def boundary_features(spark, sf_dir):
    path = new_dir(spark, "features")
    _feature_lines(spark, sf_dir).write.text(path)
    return geo_source.read_features(spark, path, layout="lines").drop("properties")


@query
def geo_district_counts(spark, sf_dir):
    # with a district without calls, which counts 0
    boundary = B.boundary(spark, sf_dir)
    nowhere = spark.createDataFrame([("ASIA", " nowhere", -1)], boundary.schema)
    return geo.geo_counts(boundary.union(nowhere), B.calls_dim(spark, sf_dir), PLACE)


@query
def geo_state_counts(spark, sf_dir):
    states = B.table(spark, sf_dir, "region").select(F.lower("r_name").alias("StateName"))
    nowhere = spark.createDataFrame([("nowhere",)], states.schema)
    return geo.geo_counts(states.union(nowhere), B.calls_dim(spark, sf_dir), ["StateName"])


def _measure(spark, sf_dir) -> DataFrame:
    path = new_dir(spark, "measure")
    supplier = B.table(spark, sf_dir, "supplier").join(
        B.places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    )
    src.write_csv(
        supplier.groupBy(F.concat(F.lit(" Nation-"), "n_nationkey").alias("place name"))
        .agg(F.round(F.sum("s_acctbal"), 2).alias("balance")),
        path,
    )
    return geo_source.read_measure(spark, path)


@query
def measure_table(spark, sf_dir):
    return _measure(spark, sf_dir)


@query
def geo_measure(spark, sf_dir):
    features = B.boundary(spark, sf_dir).withColumn("DistrictName", norm_name(F.col("DistrictName")))
    measure = _measure(spark, sf_dir).withColumn("District", norm_name(F.col("District")))
    matches = names.match_names(measure, features, target_col="District", choice_col="DistrictName")
    matched = measure.join(matches, F.col("District") == F.col("target"), "left").select("match", "value")
    return geo.geo_measure(features, matched, "DistrictName", "match")


@query
def choropleth_bins(spark, sf_dir):
    return geo.bin_linear(geo_district_counts(spark, sf_dir), "count")


# --- names ---------------------------------------------------------------------------------------


@query
def name_norm(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    side = F.element_at(F.array(*[F.lit(d) for d in ("east", "north", "city")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select(
        "p_partkey",
        norm_name(F.concat(F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit(" "))).alias("name"),
        repair_name(F.translate("p_name", "iua", "|@>")).alias("repaired"),
        keep_directions(side, F.lower("p_type")).alias("directed"),
    )


@query
def suggest_names(spark, sf_dir):
    return names.suggest(B.table(spark, sf_dir, "part"), "p_name", "Wid", 10)


def _choices(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select(F.col("p_name").alias("choice"))


def _matches(spark, sf_dir):
    return names.match_names(
        B.edited_names(spark, sf_dir), _choices(spark, sf_dir), B.name_overrides(spark, sf_dir), threshold=93
    )


@query
def name_match(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("score", F.col("score").cast("double"))


@query
def name_match_grouped(spark, sf_dir):
    """Part names within their brand: the same name may be a choice of several brands."""
    part = B.table(spark, sf_dir, "part")
    choices = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("choice"))
    targets = part.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("target"))
    found = names.match_names(targets, choices, threshold=80, group_col="brand")
    return found.withColumn("score", F.col("score").cast("double"))


@query
def name_unmatched(spark, sf_dir):
    return names.unmatched(_matches(spark, sf_dir))


@query
def name_remaining(spark, sf_dir):
    # the part types are choices that no part name resembles
    types = B.table(spark, sf_dir, "part").select(F.col("p_type").alias("choice"))
    choices = _choices(spark, sf_dir).union(types)
    matches = names.match_names(B.edited_names(spark, sf_dir), choices, threshold=93)
    return names.remaining(choices, matches)


@query
def overrides(spark, sf_dir):
    path = new_dir(spark, "overrides")
    pairs = B.name_overrides(spark, sf_dir)
    pairs.select(F.to_json(F.create_map("raw", "official")).alias("value")).write.text(f"{path}/json")
    geo_source.write_overrides(geo_source.read_overrides(spark, f"{path}/json"), f"{path}/table")
    return geo_source.read_overrides(spark, f"{path}/table", "parquet")


# --- scores --------------------------------------------------------------------------------------


def _clean_docs(spark, sf_dir):
    return materialize(
        B.docs_text(spark, sf_dir).select("doc_id", "StateName", norm_text(F.col("QueryText")).alias("q_clean")),
        "docs",
    )


@query
def token_stats(spark, sf_dir):
    docs = B.docs_text(spark, sf_dir).select(norm_text(F.col("QueryText")).alias("q_clean"))
    return scoring.token_stats(docs, "q_clean")


@query
def specificity(spark, sf_dir):
    docs = _clean_docs(spark, sf_dir)
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    stats = materialize(scoring.token_stats(docs, "q_clean"), "stats")
    scored = scoring.score_specificity(docs, "doc_id", "q_clean", stats, n_docs)
    return scored.select("doc_id", *rounded("spec_score"))


def _answer_id() -> Column:
    # the turn has 32 bits of its own
    return F.col("conv_id") * (1 << 32) + F.col("turn")


@query
def answer_score(spark, sf_dir):
    calls = B.calls_text(spark, sf_dir).select(
        _answer_id().alias("answer_id"), "KccAns", norm_text(F.col("KccAns")).alias("a_clean")
    )
    rows = materialize(calls, "answers")
    return intents.score_answers(rows, rows).select("answer_id", *rounded("desc_score"))


@query
def answer_score_raw(spark, sf_dir):
    calls = B.calls_text(spark, sf_dir).select(
        _answer_id().alias("answer_id"), "KccAns", norm_text(F.col("KccAns")).alias("a_clean")
    )
    rows = materialize(calls, "answers")
    n_docs = rows.agg(F.count(F.lit(1))).scalar()
    stats = materialize(scoring.token_stats(rows, "a_clean"), "stats")
    scored = scoring.score_answer(rows, "answer_id", "a_clean", stats, n_docs, marks_col="KccAns")
    return scored.select("answer_id", *rounded("desc_score"))


# --- clusters and intents ------------------------------------------------------------------------


@query
def embed_text(spark, sf_dir):
    return embed(_clean_docs(spark, sf_dir), "doc_id", "q_clean")


@query
def density_cluster(spark, sf_dir):
    return cluster.density_cluster(B.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.30, 8)


@query
def density_cluster_parts(spark, sf_dir):
    return cluster.density_cluster(
        B.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.25, 3, partition_col="label"
    )


@query
def density_cluster_tree(spark, sf_dir):
    # many small blocks: the metric tree decides which ones meet
    return cluster.density_cluster(B.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.30, 8, block=64)


@query
def hierarchy_weights(spark, sf_dir):
    """The spanning tree's weights in order, copies of a vector included."""
    edges, points = hierarchy.hierarchy_edges(B.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, leaf=64)
    copies = points.where("w > 1").select(F.explode(F.array_repeat("core", (F.col("w") - 1).cast("int"))).alias("w"))
    return with_ids(edges.select("w").unionAll(copies), "nth", ["w"]).select("nth", *rounded("w"))


@query
def density_hierarchy(spark, sf_dir):
    return hierarchy.density_hierarchy(B.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 5, leaf=256)


@query
def cluster_centroid(spark, sf_dir):
    means = cluster.centroids(B.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "value")).select(
        "label", "pos", *rounded("value")
    )


# for the letter model, whose vectors are all rather similar
LETTER_QUESTIONS = intents.Clustering(min_cos=0.97, min_pts=4)
LETTER_ANSWERS = intents.Clustering(min_cos=0.98, min_pts=3)
CALL_KEY = ["conv_id", "turn"]


def _calls_and_questions(spark, sf_dir):
    rows = intents.clean_rows(B.calls_text(spark, sf_dir), CALL_KEY)
    distinct = intents.distinct_questions(rows, CALL_KEY)
    found, _ = intents.cluster_questions(distinct, LETTER_QUESTIONS, B.letter_model())
    return rows, found


@query
def intent_clusters(spark, sf_dir):
    _, questions = _calls_and_questions(spark, sf_dir)
    return questions.select("question_id", "q_clean", "question_cluster_id")


@query
def intent_assign(spark, sf_dir):
    rows, questions = _calls_and_questions(spark, sf_dir)
    return intents.assign(rows, questions, CALL_KEY).select(*CALL_KEY, "question_cluster_id")


@query
def intent_questions(spark, sf_dir):
    docs = B.docs_text(spark, sf_dir).withColumn("KccAns", F.lit(""))
    rows = intents.clean_rows(docs.withColumnRenamed("StateName", "lang"), ["doc_id", "lang"])
    questions = intents.distinct_questions(rows, ["doc_id"], extra=("lang",))
    return intents.with_cluster_size(questions, "lang", "question_id").select(
        "question_id", "QueryText", "q_clean", "lang", "cluster_size"
    )


@query
def intent_representative(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    scored = intents.representative_scores(vectors, "label", "embedding", "vec_id")
    return intents.best_by(scored, ["label"], "rep_score", "id", ["vec_id", "rep_score"]).select(
        "label", "vec_id", *rounded("rep_score")
    )


@query
def intent_descriptive(spark, sf_dir):
    # given clusters with noise; the letter model for the vectors of all texts
    docs = _clean_docs(spark, sf_dir)
    docs = docs.join(embed(docs, "doc_id", "q_clean", B.letter_model()), "doc_id").withColumn(
        "label", (F.col("doc_id") % 9 - 1).cast("int")
    )
    docs = materialize(docs, "docs")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    stats = materialize(scoring.token_stats(docs, "q_clean"), "stats")
    scored = scoring.score_specificity(docs, "doc_id", "q_clean", stats, n_docs)
    scored = intents.representative_scores(scored, "label", "embedding", "doc_id")
    scored = scored.withColumn("desc_score", F.col("rep_score") + F.col("spec_score")).withColumn("id", F.col("doc_id"))
    return intents.best_by(scored, ["label"], "desc_score", "id", ["doc_id", "desc_score"]).select(
        "label", "doc_id", *rounded("desc_score")
    )


@query
def intent_answers(spark, sf_dir):
    rows, questions = _calls_and_questions(spark, sf_dir)
    answers = intents.cluster_answers(rows, questions, CALL_KEY, LETTER_ANSWERS, B.letter_model())
    return answers.select(
        "answer_id", "question_cluster_id", "answer_cluster_id", "KccAns", "a_clean", *rounded("desc_score")
    )


def _given_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Calls whose question and answer clusters are given by number: questions, scored answers."""
    rows = intents.clean_rows(B.calls_text(spark, sf_dir), CALL_KEY)
    answer_id = _answer_id()
    with_id = rows.select(
        answer_id.alias("answer_id"), answer_id.alias("question_id"), "QueryText", "q_clean", "KccAns", "a_clean",
        (F.col("conv_id") % 9 - 1).cast("int").alias("question_cluster_id"),
        (F.floor(F.col("turn") / 2) - 1).cast("int").alias("answer_cluster_id"),
    )
    kept = with_id.where((F.col("a_clean") != "") & (F.col("question_cluster_id") >= 0))
    return with_id, intents.score_answers(kept, rows)


@query
def best_answer_overall(spark, sf_dir):
    _, answers = _given_clusters(spark, sf_dir)
    return intents.best_answers(answers, ["question_cluster_id"])


@query
def best_answer_per_cluster(spark, sf_dir):
    _, answers = _given_clusters(spark, sf_dir)
    return intents.best_answers(answers, ["question_cluster_id", "answer_cluster_id"])


def _given_summaries(spark, sf_dir) -> DataFrame:
    questions, answers = _given_clusters(spark, sf_dir)
    scored = questions.withColumn("rep_score", F.length("q_clean").cast("double")).withColumn(
        "desc_score", -F.length("q_clean").cast("double")
    )
    return intents.summaries(scored, answers)


@query
def intent_summary_texts(spark, sf_dir):
    return _given_summaries(spark, sf_dir).drop("best_answer_per_answer_cluster")


@query
def intent_answer_modes(spark, sf_dir):
    return intents.answer_modes(_given_summaries(spark, sf_dir))


@query
def intent_summaries(spark, sf_dir):
    tables = intents.build_intents(
        B.calls_text(spark, sf_dir), CALL_KEY, LETTER_QUESTIONS, LETTER_ANSWERS, B.letter_model()
    )
    return tables.summaries


def _written_intents(spark, sf_dir) -> str:
    out = new_dir(spark, "intents")
    tables = intents.build_intents(
        B.calls_text(spark, sf_dir), CALL_KEY, LETTER_QUESTIONS, LETTER_ANSWERS, B.letter_model()
    )
    intents.write_intents(tables, out)
    return out


@query
def intent_tables(spark, sf_dir):
    # read back with the noise
    return spark.read.parquet(f"{_written_intents(spark, sf_dir)}/questions").select(
        "question_id", "q_clean", "question_cluster_id", "cluster_size", *rounded("spec_score", "rep_score", "desc_score")
    )


@query
def intent_settings(spark, sf_dir):
    out = new_dir(spark, "intents")
    tables = intents.build_intents(
        B.calls_text(spark, sf_dir), CALL_KEY, LETTER_QUESTIONS, LETTER_ANSWERS, B.letter_model(), source="conversations"
    )
    intents.write_intents(tables, out)
    return intents.read_settings(spark, out)


@query
def intent_summaries_stored(spark, sf_dir):
    # a folder with summaries, and one that has none yet
    out = new_dir(spark, "intents")
    _given_summaries(spark, sf_dir).write.parquet(f"{out}/summaries")
    found = intents.read_summaries(spark, f"{out}/summaries").unionByName(intents.read_summaries(spark, f"{out}/none"))
    return found.drop("best_answer_per_answer_cluster")


@query
def intent_embeddings(spark, sf_dir):
    stored = spark.read.parquet(f"{_written_intents(spark, sf_dir)}/embeddings")
    return stored.select("question_id", F.posexplode("embedding").alias("pos", "value")).select(
        "question_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


@query
def embed_letters(spark, sf_dir):
    vectors = embed(_clean_docs(spark, sf_dir), "doc_id", "q_clean", B.letter_model())
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).select(
        "doc_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


for _key, _name in (("norm_query", "norm_query_text"), ("norm_text", "norm_intent_text")):
    QUERIES[_key] = QUERIES.pop(_name)
