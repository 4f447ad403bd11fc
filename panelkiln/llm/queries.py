"""The queries op1 to op13 and the pipeline, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from panelkiln.llm import alignment, digest_dedup, fm_quality, hamerly_codes, katz, lattice_neighbours, packing, pieces, rindex_dedup, secrets, simhash, token_store, webp
from panelkiln.llm.common import documents, prepare, setting, settled, shared_folder, table, written


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op2", lambda: digest_dedup.exact_groups(documents(spark, sf_dir)))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op3", lambda: katz.train_and_score(documents(spark, sf_dir)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0, size=1024)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op5", lambda: secrets.secret_report(documents(spark, sf_dir)))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op7", lambda: simhash.near_groups(documents(spark, sf_dir)))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op8", lambda: rindex_dedup.remove_repeats(documents(spark, sf_dir), keep_bytes=False).drop("kept"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run() -> DataFrame:
        path = shared_folder(spark, "token-shards")
        token_store.write_tokens(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"), end_id=2)
        return token_store.read_tokens(spark, path)

    return settled(spark, "op9", run)


def op10_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op10", lambda: webp.media_report(written(webp.write_media(documents(spark, sf_dir)), "media")))


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op11", lambda: lattice_neighbours.embedding_groups(table(prepare(spark), sf_dir, "embeddings")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # Its rows are whole blocks: more than one or two of them in a batch would only be held longer outside the JVM's heap.
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(alignment.BLOCK)):
        return settled(spark, "op12", lambda: alignment.alignment_report(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op13", lambda: hamerly_codes.vector_codes(table(prepare(spark), sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_katz": op3_katz,
        "op4_packing": op4_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_pieces": op6_pieces,
        "op7_simhash": op7_simhash,
        "op8_passages": op8_passages,
        "op9_token_store": op9_token_store,
        "op10_webp_media": op10_webp_media,
        "op11_lattice": op11_lattice,
        "op12_alignment": op12_alignment,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": digest_dedup.ORACLE,
        "op5_secret_scan": secrets.ORACLE,
    }
