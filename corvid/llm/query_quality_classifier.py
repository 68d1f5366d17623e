from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import documents
from corvid.llm.quality_classifier import classify_quality
from corvid.llm.registry import query
from corvid.sources.tables import table


@query("op12_quality_classifier")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from three quarters of the labels."""
    return classify_quality(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
