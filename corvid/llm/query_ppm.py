from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import documents
from corvid.llm.ppm import score_texts
from corvid.llm.registry import query


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under both models."""
    rows = score_texts(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
