from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import documents
from corvid.llm.ngram_join import similarity_classes
from corvid.llm.registry import query


@query("op6_ngram_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    rows = similarity_classes(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
