"""A stored search index that takes changes: keyword, trigram and vector tables in segments.

A store keeps the tables it is made for. A change writes one new segment with the rows of its documents only; nothing written before is touched.
Each task sorts and writes the documents that it is dealt, so a segment is divided by document and a term's rows lie together in each of its files: building
sends texts through a shuffle and not the many times larger rows of the index, and a common term is no task's alone. Rows of a document in older
segments are dead once a newer segment names it, with new rows or as removed. Searches leave dead rows out by a join with the ids that the
segments after the first one name, which are few until ``compact`` writes the living rows as one new first segment. A segment
counts from the moment its ``docs`` table is in place, which is written last, so a change that breaks off leaves no trace and can be run again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import trigram
from sextant.operators.keyword import KeywordIndex, Texts

#: Segments beyond which a change is followed by ``compact``.
MAX_SEGMENTS = 16
DOCS, POSTINGS, GRAMS, VECTORS = "doc_id long, dl long, here boolean", "term string, doc_id long, dl long, tf long, positions array<int>", "gram string, doc_id long", "vec_id long, embedding array<double>"
#: Documents that a task sorts at once, at least and at most.
LEAST, DEALT = 64, 8192


class IndexStore:
    """Segments under a path; ``embed`` makes (vec_id, embedding) of documents, as ``vector.embed_tokens`` does. Without ``keywords``, ``trigrams`` or ``embed`` there is no such table."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame] | None = None, code: bool = False, keywords: bool = True, trigrams: bool = True):
        self.spark, self.path, self.embed, self.code, self.with_keywords, self.with_trigrams = spark, path.rstrip("/"), embed, code, keywords, trigrams

    @cached_property
    def _fs(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, part: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)

    def segments(self) -> list[int]:
        """Numbers of the segments that count."""
        if not self._fs.exists(self._at("docs")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("docs"))]
        return sorted(int(n[4:]) for n in names if n.startswith("seg=") and self._fs.exists(self._at(f"docs/{n}/_SUCCESS")))

    # -- changes ---------------------------------------------------------------------------------------------

    def index(self, docs: DataFrame, segment: int | None = None) -> int:
        """Add or replace documents (doc_id, text), one row for each id; the number of the new segment. Running a numbered change again replaces it."""
        known = self.segments()
        n = segment if segment is not None else (known[-1] + 1 if known else 1)
        count = docs.count()
        dealt = max(1, min(self._partitions(), -(-count // LEAST)), -(-count // DEALT))
        texts = Texts.of(docs, "doc_id", "text", self.code)
        if self.with_keywords:
            self._write(n, "postings", texts.postings(dealt).sortWithinPartitions("term", "doc_id"))
            lengths = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings/seg={n}").groupBy("doc_id").agg(F.first("dl").alias("dl"))
        else:
            lengths = texts.lengths()
        if self.with_trigrams:
            self._write(n, "grams", trigram.build(docs.repartition(dealt, "doc_id")).sortWithinPartitions("gram", "doc_id"))
        if self.embed is not None:
            self._write(n, "vectors", self.embed(docs))
        self._write(n, "docs", docs.select(F.col("doc_id").cast("long")).join(lengths, "doc_id", "left").withColumn("here", F.lit(True)))
        if len(self.segments()) > MAX_SEGMENTS:
            self.compact()
        return n

    update = index

    def remove(self, ids: DataFrame, segment: int | None = None) -> int:
        """Take documents (doc_id) out; ids that are not there change nothing."""
        known = self.segments()
        n = segment if segment is not None else (known[-1] + 1 if known else 1)
        self._write(n, "docs", ids.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("dl")).distinct().withColumn("here", F.lit(False)))
        return n

    def index_batch(self, batches: list[DataFrame], progress: Callable[[int, int], None] | None = None) -> None:
        """Index tables of documents one after the other, telling how many are done."""
        for k, docs in enumerate(batches, 1):
            self.index(docs)
            if progress is not None:
                progress(k, len(batches))

    def compact(self) -> None:
        """Write the living rows as one segment and drop the older ones."""
        old = self.segments()
        if len(old) < 2:
            return
        n = old[-1] + 1
        # The rows of a file stay together: they are read, filtered and sorted again, not dealt out.
        if self.with_keywords:
            self._write(n, "postings", self._living("postings", POSTINGS).sortWithinPartitions("term", "doc_id"))
        if self.with_trigrams:
            self._write(n, "grams", self._living("grams", GRAMS).sortWithinPartitions("gram", "doc_id"))
        if self.embed is not None:
            self._write(n, "vectors", self._living("vectors", VECTORS, "vec_id"))
        self._write(n, "docs", self.documents().withColumn("here", F.lit(True)))
        for table in ("docs", "postings", "grams", "vectors"):  # docs first: from then on the old segments do not count
            for k in old:
                self._fs.delete(self._at(f"{table}/seg={k}"), True)

    def _partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, n: int, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/seg={n}")

    # -- reading ---------------------------------------------------------------------------------------------

    def _rows(self, table: str, schema: str) -> DataFrame:
        """Rows of all segments that count, with the number of theirs."""
        found = [n for n in self.segments() if self._fs.exists(self._at(f"{table}/seg={n}"))]
        if not found:
            return self.spark.createDataFrame([], f"{schema}, seg int")
        rows = self.spark.read.schema(f"{schema}, seg int").option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/seg={n}" for n in found))
        return rows

    def _living(self, table: str, schema: str, key: str = "doc_id") -> DataFrame:
        """Rows that no newer segment replaces or removes."""
        known = self.segments()
        rows = self._rows(table, schema)
        if len(known) > 1:
            newer = self._rows("docs", DOCS).where(F.col("seg") > known[0]).groupBy(F.col("doc_id").alias(key)).agg(F.max("seg").alias("last"))
            rows = rows.join(newer, key, "left").where("last IS NULL OR seg >= last")
        return rows.select(*(c.split()[0] for c in schema.split(", ")))

    def documents(self) -> DataFrame:
        """(doc_id, dl) of the documents in the index; dl is null for those without a term."""
        known = self.segments()
        rows = self._rows("docs", DOCS)
        if not known:
            return rows.select("doc_id", "dl")
        last = rows.groupBy("doc_id").agg(F.max(F.struct("seg", "here", "dl")).alias("m"))
        gone = [n for n in known if not self._fs.exists(self._at(f"postings/seg={n}"))]  # for segments written before they had ``here``
        return last.where(F.coalesce("m.here", ~F.col("m.seg").isin(gone) if gone else F.lit(True))).select("doc_id", F.col("m.dl").alias("dl"))

    def keywords(self) -> KeywordIndex:
        lengths = self.documents().where("dl IS NOT NULL")
        return KeywordIndex(self._living("postings", POSTINGS), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    def grams(self) -> DataFrame:
        return self._living("grams", GRAMS)

    def vectors(self) -> DataFrame:
        return self._living("vectors", VECTORS, "vec_id")

    def contains(self, doc_id: int) -> bool:
        return not self.documents().where(F.col("doc_id") == doc_id).isEmpty()

    def count(self) -> int:
        return self.documents().count()

    def clear(self) -> None:
        self._fs.delete(self._at(""), True)

    def router(self, embed: Callable[[str], list[float]] | Callable[[Column], Column] | None = None):
        """A router over the living rows; with ``embed``, of query texts, it searches vectors too."""
        from sextant.plans.router import SearchRouter

        return SearchRouter(self.keywords(), self.grams(), self.vectors() if embed is not None else None, embed)
