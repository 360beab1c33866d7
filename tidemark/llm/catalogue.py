"""Queries over the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, exact_dedup, html_extract, language_id, line_rules, manifest, media, mixing, near_dedup, packing, pii, quality, sharding


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_packing": packing.op1_packing,
        "op2_lpt_sharding": sharding.op2_lpt_sharding,
        "op3_prob_minhash": near_dedup.op3_prob_minhash,
        "op4_pfair_mixing": mixing.op4_pfair_mixing,
        "op5_surrogates": pii.op5_surrogates,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_tag_path_ratios": html_extract.op7_tag_path_ratios,
        "op8_media_columns": media.op8_media_columns,
        "op9_language_id": language_id.op9_language_id,
        "op10_ordinal_quality": quality.op10_ordinal_quality,
        "op11_line_frequency": line_rules.op11_line_frequency,
        "op12_lloyd_clusters": clustering.op12_lloyd_clusters,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op11_line_frequency": line_rules.OP11_SQL,
        "op12_lloyd_clusters": clustering.OP12_SQL,
        "op13_merkle_manifest": manifest.OP13_SQL,
    }
