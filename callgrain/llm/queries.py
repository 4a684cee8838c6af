"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from callgrain.llm import (
    alignment, conversations, exact_dedup, exact_topk, jaccard_join, line_dedup, packing, pieces, pii, secret_scan, sharding, token_counts, toxicity,
)
from callgrain.llm.common import keyed_text, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark, sf_dir):
    docs = keyed_text(read(spark, sf_dir, "documents"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


@query
def op8_exact_topk(spark, sf_dir):
    return exact_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op8_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
) WHERE rank <= 20
"""


@query
def op9_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@query
def op6_line_dedup(spark, sf_dir):
    cleaned = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


@query
def op7_kd_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"), 8)


@query
def op3_pii(spark, sf_dir):
    replaced, spans = pii.pseudonymise(keyed_text(read(spark, sf_dir, "documents")), pii.session_key(spark))
    return replaced.select("doc_id", "text", F.size(spans).cast("bigint").alias("n_pii"), F.col(spans).alias("spans"))


@query
def op5_sampled_pieces(spark, sf_dir):
    """The sampled ids of every whole text, and whether decoding them gives the text's digest again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = keyed_text(read(spark, sf_dir, "documents"))
    decoded = pieces.decode(pieces.encode(docs, model, seed=7), model)
    return decoded.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_pieces"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_join.components(read(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored, score = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
        (F.col(score) >= 0.7).cast("int").alias("predicted"),
    )


@query
def op13_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = secret_scan.find_secrets(docs)
    spans = F.coalesce(F.col(name), F.array().cast(secret_scan.SPANS))
    base = secret_scan.of_kinds(spans, tuple(k.name for k in secret_scan.BASE))
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(spans, k.name).alias(f"n_{k.name}") for k in secret_scan.BASE],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


@query
def op11_conversation_repair(spark, sf_dir):
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")))


@query
def op12_token_alignment(spark, sf_dir):
    docs, _ = alignment.align(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return docs
