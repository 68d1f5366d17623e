from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import documents, keep
from corvid.llm.quality import features, judge
from corvid.llm.registry import query


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, votes, posterior and verdict of every document."""
    # the features once, without the text: fitting and judging read them again
    rows = keep(features(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "quality")
