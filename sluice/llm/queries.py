"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, common, decontam, fingerprint, langid, line_dedup, manifest, packing, passage_dedup, pii, simhash, token_store, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(common.crc_mod("doc_id", 3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(common.table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{common.shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.digests(token_store.read_store(spark, path))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the rows that are not held out."""
    return toxicity.fit(docs, labels.where(common.crc_mod("doc_id", 4) != 2))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeats(common.table(spark, sf_dir, "documents")).drop("text_key")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.judged(decontam.find(docs, common.table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(common.table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", line_dedup.ranges_text().alias("removed"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(centroids.usable(common.table(spark, sf_dir, "embeddings"))).rows


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.proofs(common.table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars") + F.when(tampers, 1).otherwise(0)})


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_edits(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_simhash": op3_simhash,
    "op4_token_store": op4_token_store,
    "op5_toxicity": op5_toxicity,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_personal_data": op8_personal_data,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op7_decontamination": decontam.SQL, "op9_line_dedup": line_dedup.SQL, "op11_centroid_clustering": centroids.sql(), "op12_merkle_manifest": manifest.sql(), "op13_document_fingerprints": fingerprint.sql()}
