"""From raw documents to packed training sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagos.llm.decontaminate import decontamination_stage
from pelagos.llm.packing import packing_stage
from pelagos.llm.quality import quality_stage
from pelagos.llm.simhash import near_duplicate_stage
from pelagos.llm.storage import stored, table
from pelagos.llm.substring import substring_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The stages fit a model, hash and search for a packing: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
