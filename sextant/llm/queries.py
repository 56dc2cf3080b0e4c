"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from sextant.llm.simhash import simhash_classes

    return simhash_classes(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window that is similar to a benchmark item."""
    from pyspark.sql import functions as F

    from sextant.llm.decontaminate import matches

    found = matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start").distinct()


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    from sextant.llm.quality import measure, verdict

    return verdict(measure(_table(spark, sf_dir, "documents")))


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in the shards, read back from the files."""
    from sextant.llm.sstable import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go from each document."""
    from sextant.llm.linededup import report

    return report(_table(spark, sf_dir, "documents"), min_words=1)


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    from sextant.llm.histshard import shard

    return shard(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from sextant.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from sextant.llm.htmlmain import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    from sextant.llm.pii import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document."""
    from pyspark.sql import functions as F

    from sextant.llm.ordinal import score, train

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *(F.round(c, 6).alias(c) for c in ("expected_grade", "p_low", "p_best")), "selected")


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_sstable": op4_sstable,
    "op5_line_dedup": op5_line_dedup,
    "op6_histogram_sort": op6_histogram_sort,
    "op7_packing": op7_packing,
    "op8_html_main_text": op8_html_main_text,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_ordinal_quality": op10_ordinal_quality,
}
SQL: dict[str, str] = {}
