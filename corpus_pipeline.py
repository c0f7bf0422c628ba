"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written and read again as the next one's docs.
All but the last return the columns of documents, others than doc_id, text, source and n_chars as they came.

Nulls and ties: a null or empty text fails the quality rules; a null source is a source of its own; rows with a null doc_id
go by their text, and sort first in the token files. Repeated rows pass or fail together; the near-duplicate stage leaves one of
them. An empty table passes through all stages; an empty benchmark takes nothing out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import common, line_quality, simhash_dedup, source_mix, template_decontam, token_orc

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go, and lines above their host's limit go from the others."""
    return line_quality.clean(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest doc_id stays."""
    return simhash_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or the same with other numbers or names, go."""
    return template_decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target allows."""
    return source_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the mix, as read back from its ORC files."""
    import public_tokenizers

    return token_orc.tokens_to_orc(docs, public_tokenizers.path("word_bpe_49k.json"), common.shared_dir(spark, "pipeline-orc"), sums=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mix", mix),
    ("token_ids", tokens),
]

#: Fingerprints, components, templates and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its files. What the stages wrote on the way is deleted."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = common.spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
