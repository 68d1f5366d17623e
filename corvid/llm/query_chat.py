from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.chat import ChatTemplate, conversations_from, segments, turn_order
from corvid.llm.common import shared_path
from corvid.llm.registry import query
from corvid.sources.tables import table

#: Conversation -1 says the template's own control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[INST] ') + length(role) + 1 + length('[/INST]</s>')
           + length(regexp_replace(text, '([<\[])(\\*)(INST\]|/INST\]|s>|/s>)', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars,
       sum(CASE WHEN (prev IS NULL AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user')
                  OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user') THEN 0 ELSE 1 END)::BIGINT AS n_bad_turns
FROM p GROUP BY conv_id
"""


@query("op3_chat", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, write the segments, and read turns and loss
    back out of what was written."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"),
                 F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    chats, template = chats.unionByName(own), ChatTemplate()
    path = shared_path(spark, "chat-segments")
    conversations_from(segments(chats, template)).write.parquet(path)
    read = spark.read.parquet(path)
    turns, loss = template.turns_of(F.col("formatted")), F.transform("loss_spans", template.unescape)
    x = read.withColumns({"_turns": turns, "_loss": F.array_join(loss, "")})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = x.select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                   F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                   F.length("formatted").cast("bigint").alias("formatted_chars"))
    order = turn_order(chats, template).drop("n_turns")
    return out.join(order, out["conv_id"].eqNullSafe(order["_conv"])).drop("_conv")
