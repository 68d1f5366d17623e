from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import documents
from corvid.llm.registry import query
from corvid.llm.sharding import DIMS, kd_shards, shard_rows


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, by a k-d tree."""
    docs = documents(spark, sf_dir).withColumn(
        "text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    rows = kd_shards(shard_rows(docs, carry=["text_crc32"]), DIMS, shards=24)
    return rows.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
                       F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
