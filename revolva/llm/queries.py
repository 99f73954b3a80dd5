"""One query per operator over the given tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revolva.llm import (
    collisions,
    decontamination,
    labelled,
    merkle,
    neardup,
    negatives,
    packing,
    pii,
    quality,
    records,
    secrets,
    token_counts,
    tokens,
    topk,
    toxicity,
)
from revolva.llm.session import scratch, table

ORACLE: dict[str, str] = {}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quick estimates first, then each is taken away and the exact count put in; replays count once.

    The totals are read from a snapshot of the first batch and the second batch after it.
    """
    documents, path = table(spark, sf_dir, "documents"), tokens.vocabulary()
    ledger = token_counts.Ledger(spark, scratch(spark, "ledger"))
    guesses = token_counts.estimated(documents, "estimate")
    ledger.commit("load", guesses)
    ledger.commit("load", guesses)
    ledger.compact()
    exact = token_counts.counted(documents, path, tokens.BYTE_BPE)
    revised = token_counts.estimated(documents, "estimate", -1).unionByName(exact)
    ledger.commit("recount", revised)
    ledger.commit("recount", revised)
    return ledger.totals()


def _judged(scores: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        F.coalesce(labelled.fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 5) != 0)
    return _judged(quality.scored(documents, model), 5, 0, quality.THRESHOLD)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10, scale=1024)


ORACLE["op4_exact_top_k"] = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, path = scratch(spark, "records"), tokens.vocabulary()
    records.write_records(table(spark, sf_dir, "documents"), folder, path)
    return records.read_records(records.read_index(spark, folder), folder, path, digest=True)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokens.vocabulary())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 4) != 2)
    return _judged(toxicity.scored(documents, model), 4, 2, toxicity.THRESHOLD)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


# CRC-32 by its polynomial (0xEDB88320, reflected), one byte after the other, eight steps each.
_CRC32 = """
xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::BIGINT)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
    )
), 4294967295::BIGINT)
"""


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS id, doc_id, source, {_leaf_sql('text')} AS leaf,
           CASE WHEN {_CRC32} % 5 = 0
                THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
    FROM documents
), low(source, level, pos, n, node) AS (
    SELECT source, 0, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1,
           count(*) OVER (PARTITION BY source), leaf
    FROM doc
    UNION ALL
    SELECT source, any_value(level) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
    FROM low WHERE n > 1 GROUP BY source, pos // 16
), high(level, pos, n, node) AS (
    SELECT 0, row_number() OVER (ORDER BY source NULLS FIRST) - 1, count(*) OVER (), node FROM low WHERE n = 1
    UNION ALL
    SELECT any_value(level) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
    FROM high WHERE n > 1 GROUP BY pos // 16
), node AS (
    SELECT 'low' AS tree, source, level, pos, n, node FROM low
    UNION ALL SELECT 'high', NULL, level, pos, n, node FROM high
), beside AS (
    SELECT a.tree, a.source, a.level, a.pos,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM node a JOIN node b ON a.tree = b.tree AND a.source IS NOT DISTINCT FROM b.source
                           AND a.level = b.level AND a.pos // 16 = b.pos // 16
    WHERE a.n > 1
    GROUP BY a.tree, a.source, a.level, a.pos
), top AS (
    SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE n = 1
), start AS (
    SELECT d.*, t.subroot, t.place,
           row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id NULLS FIRST, d.leaf, d.id) - 1 AS pos
    FROM doc d JOIN top t ON d.source IS NOT DISTINCT FROM t.source
), climb(id, tree, level, spot, place, source, state, proof) AS (
    SELECT id, 'low', 0, pos, place, source, coalesce(changed, leaf), '' FROM start
    UNION ALL
    SELECT c.id,
           CASE WHEN b.pos IS NULL THEN 'high' ELSE c.tree END,
           CASE WHEN b.pos IS NULL THEN 0 ELSE c.level + 1 END,
           CASE WHEN b.pos IS NULL THEN c.place ELSE c.spot // 16 END,
           c.place,
           CASE WHEN b.pos IS NULL THEN NULL ELSE c.source END,
           CASE WHEN b.pos IS NULL THEN c.state ELSE sha256(b.l || c.state || b.r) END,
           CASE WHEN b.pos IS NULL THEN c.proof ELSE c.proof || b.l || b.r END
    FROM climb c LEFT JOIN beside b
      ON b.tree = c.tree AND b.source IS NOT DISTINCT FROM c.source AND b.level = c.level AND b.pos = c.spot
    WHERE b.pos IS NOT NULL OR c.tree = 'low'
), last AS (
    SELECT id, arg_max(state, length(proof) * 2 + (tree = 'high')::INT) AS folded, max(length(proof)) AS size,
           arg_max(proof, length(proof)) AS proof
    FROM climb GROUP BY id
)
SELECT s.doc_id, s.leaf, s.subroot, h.node AS root, sha256(l.proof) AS proof_sha256, l.folded AS folded_root,
       l.folded = h.node AS verified
FROM start s JOIN last l USING (id) CROSS JOIN (SELECT node FROM high WHERE n = 1) h
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), "vec_id % 50 = 0")


ORACLE["op13_hard_negatives"] = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
    FROM valid a JOIN valid c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same
), ranked AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.place <= 5
     AND s.score * 100 BETWEEN p.positive_score * 50 AND p.positive_score * 95
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
