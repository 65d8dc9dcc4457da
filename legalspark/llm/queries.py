"""Queries of this subpackage: opN_<name> over the whole of its table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .embedding_dedup import ORACLE as EMBEDDING_ORACLE
from .embedding_dedup import similar_embeddings
from .language_id import identify
from .line_dedup import similar_lines
from .ngram_join import ORACLE as NGRAM_ORACLE
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .token_counts import section_token_counts
from .toxicity import toxic_documents
from .url_filter import judge_urls
from .warc import ORACLE as WARC_ORACLE
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": lambda s, d: ngram_jaccard_join(table(s, d, "documents")),
        "op2_packing": lambda s, d: pack(table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxic_documents(table(s, d, "documents"), table(s, d, "labels")),
        "op4_embedding_near_dedup": lambda s, d: similar_embeddings(table(s, d, "embeddings")),
        "op5_warc": lambda s, d: warc_round_trip(table(s, d, "pages")),
        "op6_url_filters": lambda s, d: judge_urls(table(s, d, "pages")),
        "op7_benchmark_decontamination": lambda s, d: contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_token_counts": lambda s, d: section_token_counts(table(s, d, "documents")),
        "op9_line_dedup": lambda s, d: similar_lines(table(s, d, "documents")),
        "op10_language_id": lambda s, d: identify(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": NGRAM_ORACLE, "op4_embedding_near_dedup": EMBEDDING_ORACLE, "op5_warc": WARC_ORACLE}
