from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import documents, shared_path
from corvid.llm.registry import query
from corvid.llm.token_files import tokenize_corpus

COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents and read the files back."""
    out = shared_path(spark, "tokens")
    return tokenize_corpus(documents(spark, sf_dir).select("doc_id", "text"), out, tokenizer_path()).select(*COLUMNS)
