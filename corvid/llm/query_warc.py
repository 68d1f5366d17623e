from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import shared_path
from corvid.llm.registry import query
from corvid.llm.warc import build_derivatives, read_records, write_responses
from corvid.sources.tables import table


@query("op10_warc_derivatives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as responses, their derivatives, and both read back: a row a
    page with what links its two derived records."""
    source, out = shared_path(spark, "warc-responses"), shared_path(spark, "warc-derived")
    write_responses(table(spark, sf_dir, "pages").select("page_id", "url", "html"), source)
    build_derivatives(spark, source, out)
    rows = read_records(spark, out)
    block = F.col("block").cast("string")
    # only digests and links are kept before the two records of a page meet
    narrow = rows.select(
        F.col("row_id").cast("bigint").alias("page_id"), "target_uri", F.col("refers_to").alias("response_id"), "type", "record_id",
        "concurrent_to", "digest_ok", F.length(block).cast("bigint").alias("chars"), F.sha2("block", 256).alias("sha256"),
        F.regexp_extract(block, r"(?m)^title: ([^\r\n]*)", 1).alias("title"),
        F.regexp_extract(block, r"(?m)^sourcePayloadDigest: ([^\r\n]*)", 1).alias("payload_digest"),
        F.regexp_count(block, F.lit(r"(?m)^outlink: ")).cast("bigint").alias("n_links"))
    # equal pages have equal records: one of each pair is kept, with its number
    pair = F.coalesce("concurrent_to", "record_id").alias("conversion_id")
    meta, text = F.col("type") == "metadata", F.col("type") == "conversion"
    m = F.struct("page_id", "target_uri", "response_id", F.col("record_id").alias("metadata_id"), "digest_ok", "payload_digest", "title", "n_links")
    linked = narrow.groupBy(pair).agg(F.max(F.when(meta, m)).alias("m"), F.max(F.when(text, F.struct("response_id", "digest_ok", "chars", "sha256"))).alias("c"),
                                      F.count(F.when(meta, 1)).cast("int").alias("n")).filter("m IS NOT NULL AND c IS NOT NULL")
    return linked.select(
        "m.page_id", "m.target_uri", "m.response_id", "m.metadata_id", "conversion_id",
        (F.col("m.response_id") == F.col("c.response_id")).alias("same_source"),
        (F.col("m.digest_ok") & F.col("c.digest_ok")).alias("digests_ok"), "m.payload_digest", "m.title", "m.n_links",
        F.col("c.chars").alias("text_chars"), F.col("c.sha256").alias("text_sha256"), F.explode(F.sequence(F.lit(1), "n")).alias("_k")).drop("_k")
