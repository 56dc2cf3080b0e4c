"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm.common import heap_released, work_path
from sextant.llm.queries import _table, _tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    from sextant.llm.quality import quality_rules

    return quality_rules(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches."""
    from sextant.llm.linededup import line_dedup

    return line_dedup(docs, min_words=1)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints linked by anchors, then what their shingles link besides."""
    from sextant.llm.simhash import near_dedup

    heap_released(spark)  # line dedup fills the heap, and fingerprints are made in Python
    return near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    from sextant.llm.decontaminate import decontaminate

    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    from sextant.llm.packing import pack

    heap_released(spark)  # the stages before fill the heap, and tokens are made in Python
    return pack(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Hashes, fingerprints and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = work_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
