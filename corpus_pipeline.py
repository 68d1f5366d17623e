"""A corpus pipeline: raw documents to token files, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
for the next stage. All but the last return the columns of ``documents``.

Defined results: rows with a null id, repeated rows and null, empty or very long
texts are treated by each stage as its operator says (a null or blank text fails
the quality rules, so it ends there); columns of the documents beyond those the
stages read are carried along as they are, whatever their names; an empty table
gives an empty result.

No SQL is given for the whole: expectation maximisation, the similarity classes
and the tokenizer can't be said in it. The tests hold the pipeline against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import documents, shared_path, sweep
from corvid.llm.decontamination import drop_contaminated
from corvid.llm.mixing import mixed_rows
from corvid.llm.ngram_join import one_per_class
from corvid.llm.quality import filter_quality
from corvid.llm.query_token_files import COLUMNS, tokenizer_path
from corvid.llm.token_files import tokenize_corpus
from corvid.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (operator 7)."""
    return filter_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 6)."""
    return one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go (operator 5)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: documents are left out or repeated (operator 1)."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold (operator 2)."""
    return tokenize_corpus(docs, shared_path(spark, "pipeline-tokens"), tokenizer_path()).select(*COLUMNS)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("decontamination", decontaminate),
          ("mixing", mix), ("token output", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark)
    return docs
