"""Trigram index: substring candidates, fuzzy search, similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import fold, trigrams

THRESHOLD, LIMIT = 0.3, 100


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pad: bool = True) -> DataFrame:
    """(gram, doc_id), one row for each distinct gram of a document."""
    return docs.select(F.explode(trigrams(F.col(text_col), pad)).alias("gram"), F.col(id_col).cast("long").alias("doc_id"))


@dataclass(frozen=True)
class Texts:
    """Documents in place of an index: a search looks for its own grams in the texts, and no others are made."""

    docs: DataFrame
    id_col: str = "doc_id"
    text_col: str = "text"
    pad: bool = True

    def table(self) -> DataFrame:
        return build(self.docs, self.id_col, self.text_col, self.pad)

    def shared(self, grams: list[str]) -> DataFrame:
        body = fold(F.col(self.text_col))
        data = F.encode(F.concat(F.lit("$$"), body, F.lit("$$")) if self.pad else body, "UTF-8")
        rows = self.docs.select(F.col(self.id_col).cast("long").alias("doc_id"), data.alias("data"))
        n = sum((F.contains("data", F.lit(bytes.fromhex(g))).cast("int") for g in grams), F.lit(0))
        found = rows.select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))  # summed before it is filtered, so that n is computed once
        return found.where("n > 0")


def _shared(index: DataFrame | Texts, grams: list[str]) -> DataFrame:
    """(doc_id, n): how many of the grams the documents with any have."""
    if isinstance(index, Texts):
        return index.shared(grams)
    return index.where(F.col("gram").isin(grams)).groupBy("doc_id").agg(F.count("*").alias("n"))


def query_grams(text: str, pad: bool) -> list[str]:
    """Distinct byte trigrams of a query, in hex."""
    data = text.encode()
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    data = b"$$" + data + b"$$" if pad else data
    return sorted({data[i : i + 3].hex().upper() for i in range(len(data) - 2)})


def frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("gram").agg(F.count("*").alias("df"))


def search_substring(index: DataFrame | Texts, pattern: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id): documents with all trigrams of the pattern; verified against the text where ``docs`` is given. Patterns under three bytes find nothing."""
    grams = query_grams(pattern, False)
    found = _shared(index, grams).where(F.col("n") == max(1, len(grams))).select("doc_id")
    if docs is None:
        return found
    # Candidates first, as they are few; only their texts are folded. The sizes of both sides decide on a broadcast at run time.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(found, "doc_id", "left_semi")
    return texts.where(F.contains(fold(F.col("text")), fold(F.lit(pattern)))).select("doc_id")


def search_fuzzy(index: DataFrame | Texts, query: str, threshold: float = THRESHOLD, limit: int | None = LIMIT) -> DataFrame:
    """(doc_id, similarity): share of the query's padded trigrams in the document, at least half of ``threshold``."""
    grams = query_grams(query, True)
    threshold = THRESHOLD if threshold < 0 else threshold
    shared = _shared(index, grams).select("doc_id", (F.col("n") / F.lit(float(len(grams)))).alias("similarity"))
    kept = shared.where(F.col("similarity") >= 0.5 * threshold).withColumn("similarity", F.round("similarity", 6))
    return kept if limit is None else kept.orderBy(F.desc("similarity"), "doc_id").limit(limit)


def find_similar(index: DataFrame | Texts, text: str, limit: int = 10) -> DataFrame:
    return search_fuzzy(index, text, 0.1, limit)


def may_contain(text: Column, pattern: str) -> Column:
    """Are all unpadded trigrams of the pattern in the text? True for patterns under three bytes."""
    grams = query_grams(pattern, False)
    return F.size(F.array_except(F.array(*map(F.lit, grams)), trigrams(text))) == 0 if grams else F.lit(True)
