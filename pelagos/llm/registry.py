"""Queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op2_decontamination
from .gif import op6_gif_media
from .html_extraction import op8_html_extraction
from .lm_scoring import op5_lm_scoring
from .ngram_join import op12_ngram_join
from .packing import op10_best_fit_packing
from .quality import op1_quality_classifier
from .ranked_search import OP11_SQL, op11_ranked_search
from .simhash import op9_simhash_near_dedup
from .substring import op7_substring_dedup
from .toxicity import op3_toxicity
from .warc import OP4_SQL, op4_warc
from .whitening import op13_embedding_whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_warc": op4_warc,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_gif_media": op6_gif_media,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_ranked_search": op11_ranked_search,
        "op12_ngram_join": op12_ngram_join,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": OP4_SQL,
        "op11_ranked_search": OP11_SQL,
    }
