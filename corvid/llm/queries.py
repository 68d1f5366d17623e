"""Every query of the subpackage: importing the modules registers them."""

from corvid.llm import query_chat, query_decontamination, query_divergence, query_line_dedup  # noqa: F401
from corvid.llm import query_mixing, query_ngram_join, query_ppm, query_quality, query_quality_classifier  # noqa: F401
from corvid.llm import query_resampling, query_sharding, query_token_files, query_warc  # noqa: F401
from corvid.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
