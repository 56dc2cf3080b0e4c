"""Snippets: table operations as plans, and a store that keeps versions of the table as Parquet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sextant.errors import ErrorCode, StoreError
from sextant.functions.language import detect_language
from sextant.functions.text import checksum, fold

SCHEMA = "id long, name string, content string, language string, description string, tags array<string>, created_at timestamp, modified_at timestamp, checksum long"
LIMIT, EXCERPT, BEFORE = 50, 60, 20


# -- reading -------------------------------------------------------------------------------------------------


def by_id(snippets: DataFrame, id_: int) -> DataFrame:
    return snippets.where(F.col("id") == id_)


def by_name(snippets: DataFrame, name: str) -> DataFrame:
    return snippets.where(F.col("name") == name)


def resolve(snippets: DataFrame, text: str) -> DataFrame:
    """The snippet with this id if the text is one and it exists, else the one with this name."""
    number = int(text) if text.isascii() and text.isdigit() and 0 < int(text) < 1 << 63 else 0
    found = snippets.where((F.col("id") == number) & F.lit(number > 0) | (F.col("name") == text))
    return found.orderBy(F.when((F.col("id") == number) & F.lit(number > 0), 0).otherwise(1)).limit(1)


def in_key_order(snippets: DataFrame) -> DataFrame:
    """Ordered by the id's decimal digits as text."""
    return snippets.orderBy(F.col("id").cast("string"))


def listed(snippets: DataFrame) -> DataFrame:
    """All snippets with their ``place`` from 1 in key order; no task has to hold them all."""
    return numbered(snippets.withColumn("__key", F.col("id").cast("string")), "__key", "place").drop("__key")


def key_range(table: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Rows with keys from first to last, both included, in order."""
    return table.where(F.col(key).between(first, last)).orderBy(key)


def key_scan(table: DataFrame, key: str, start: str, limit: int) -> DataFrame:
    return table.where(F.col(key) >= start).orderBy(key).limit(limit)


def is_unique(table: DataFrame, key: str) -> bool:
    """Does every key occur once?"""
    return table.groupBy(key).count().where("count > 1").isEmpty()


def is_in_order(table: DataFrame, key: str) -> bool:
    """Is every key larger than the one before it, as the table is stored, within each partition and from one to the next?"""
    rows = table.select(F.col(key).alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("k").over(Window.partitionBy("p").orderBy("at"))
    if not rows.withColumn("b", before).where("b >= k OR k IS NULL").isEmpty():
        return False
    ends = [tuple(r) for r in rows.groupBy("p").agg(F.min("k"), F.max("k")).orderBy("p").collect()]  # a row a partition
    return all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def tag_count(snippets: DataFrame, tag: str) -> DataFrame:
    """(n): snippets with this tag, 0 for an unknown one."""
    return by_tag(snippets, tag).agg(F.count("*").alias("n"))


def tag_exists(snippets: DataFrame, tag: str) -> DataFrame:
    """(found): has any snippet this tag?"""
    return by_tag(snippets, tag).limit(1).agg((F.count("*") > 0).alias("found"))


def put(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows inserted by key, or replaced where the key is there."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet are added; the others change nothing."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def drop_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def for_each(table: DataFrame, key: str, visit: Callable[[Row], bool]) -> int:
    """Visit rows in key order until ``visit`` returns False; how many were visited. Rows come a partition at a time."""
    n = 0
    for row in table.orderBy(key).toLocalIterator():
        n += 1
        if visit(row) is False:
            break
    return n


def by_tag(snippets: DataFrame, tag: str) -> DataFrame:
    return snippets.where(F.array_contains("tags", tag))


def by_language(snippets: DataFrame, language: str) -> DataFrame:
    return snippets.where(F.col("language") == language)


def with_all_tags(snippets: DataFrame, tags: list[str]) -> DataFrame:
    """Nothing for an empty list."""
    return snippets.where(reduce(lambda a, b: a & b, (F.array_contains("tags", t) for t in tags)) if tags else F.lit(False))


def with_any_tag(snippets: DataFrame, tags: list[str]) -> DataFrame:
    return snippets.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False))


def tag_counts(snippets: DataFrame) -> DataFrame:
    """(tag, n): snippets for each tag; a tag that a snippet lists twice counts once."""
    return snippets.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tags_by_count(snippets: DataFrame) -> DataFrame:
    """(tag, n), the most frequent first, equals by name."""
    return tag_counts(snippets).orderBy(F.desc("n"), "tag")


def all_tags(snippets: DataFrame) -> DataFrame:
    return snippets.select(F.explode("tags").alias("tag")).distinct()


def tags_between(snippets: DataFrame, first: str, last: str) -> DataFrame:
    return all_tags(snippets).where(F.col("tag").between(first, last))


def search(snippets: DataFrame, query: str, limit: int | None = LIMIT) -> DataFrame:
    """(id, score, matched_text): 1.0 for the name, 0.5 for the content and 0.3 for any tag that contains the query, whatever the case.

    One pass with TakeOrderedAndProject; matched_text is the name, or else 60 characters of content around the hit.
    """
    q = fold(F.lit(query))
    in_name, at = F.contains(fold(F.col("name")), q), F.instr(fold(F.col("content")), fold(F.lit(query)))
    in_tags = F.exists("tags", lambda t: F.contains(fold(t), q))
    score = F.when(in_name, 10).otherwise(0) + F.when(at > 0, 5).otherwise(0) + F.when(in_tags, 3).otherwise(0)
    excerpt = F.substring("content", F.greatest(at - 1 - BEFORE, F.lit(0)) + 1, F.lit(EXCERPT))
    text = F.when(in_name, F.col("name")).when(at > 0, excerpt).otherwise("")
    hits = snippets.select("id", (score / 10.0).alias("score"), text.alias("matched_text")).where(F.col("score") > 0)
    hits = hits if query else hits.limit(0)
    return hits if limit is None else hits.orderBy(F.desc("score"), "id").limit(limit)


def search_filtered(snippets: DataFrame, query: str, tag: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
    """Search, with tag and language applied to the hits that the limit left. Without a query the tag decides, else the language."""
    if not query:
        rows = by_tag(snippets, tag) if tag else by_language(snippets, language) if language else snippets.limit(0)
        return rows.orderBy("id").limit(limit).select("id", F.lit(0.0).alias("score"), F.lit("").alias("matched_text"))
    wanted = snippets
    if tag:
        wanted = by_tag(wanted, tag)
    if language:
        wanted = by_language(wanted, language)
    return search(snippets, query, limit).join(wanted.select("id"), "id", "left_semi")


def listing(snippets: DataFrame) -> DataFrame:
    """Columns of the list table: id, name (24), language (11), tags (29), bytes."""
    from sextant.functions.text import truncate

    return snippets.select("id", truncate(F.col("name"), 24).alias("name"), truncate(F.col("language"), 11).alias("language"), truncate(F.array_join("tags", ", "), 29).alias("tags"), F.octet_length("content").cast("long").alias("size"))


def rendered(snippets: DataFrame) -> DataFrame:
    """(id, text): header lines and content, ending in a newline."""
    head = F.concat(F.lit("# "), F.col("name"), F.lit(" ["), F.col("language"), F.lit("]\n"))
    about = F.when(F.col("description") != "", F.concat(F.lit("# "), F.col("description"), F.lit("\n"))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("# Tags: "), F.array_join("tags", ", "), F.lit("\n"))).otherwise("")
    end = F.when(F.col("content").endswith("\n"), "").otherwise("\n")
    return snippets.select("id", F.concat(head, about, tags, F.lit("\n"), F.col("content"), end).alias("text"))


# -- changing ------------------------------------------------------------------------------------------------


def _distinct_tags(tags: Column) -> Column:
    return F.size(F.array_distinct(tags)) == F.size(tags)


def bulk_add(snippets: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the accepted rows, rejected rows with a reason). ``new`` has content, name, tags, language, description.

    A name must be given and free, also within the batch (the first by content wins), and tags must differ. Ids follow the largest one.
    """
    taken = snippets.select("name", F.lit(True).alias("taken"))
    first = Window.partitionBy("name").orderBy("content")
    judged = new.withColumn("rank", F.row_number().over(first)).join(taken, "name", "left")
    reason = F.when(F.coalesce("name", F.lit("")) == "", ErrorCode.INVALID_ARGUMENT.name).when(F.col("taken") | (F.col("rank") > 1), ErrorCode.ALREADY_EXISTS.name).when(~_distinct_tags(F.col("tags")), ErrorCode.INTERNAL_ERROR.name)
    judged = judged.withColumn("reason", reason).drop("taken", "rank")
    good = judged.where("reason IS NULL").drop("reason")
    language = F.when(F.coalesce("language", F.lit("")) == "", detect_language(F.col("content"), F.col("name"))).otherwise(F.col("language"))
    last = snippets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    now = F.current_timestamp()
    placed = numbered(good, "name").join(F.broadcast(last))
    rows = placed.select((F.col("last") + F.col("number")).alias("id"), "name", "content", language.alias("language"), F.coalesce("description", F.lit("")).alias("description"), "tags", now.alias("created_at"), now.alias("modified_at"), checksum(F.col("content")).alias("checksum"))
    return snippets.unionByName(rows), judged.where("reason IS NOT NULL")


#: Splitters of a numbering, and the rows of the sample that they are taken from.
SPLITTERS, SAMPLED = 128, 20_000


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """``name`` counts from 1 in the order of a unique string key: places within ranges of keys, plus the sizes of the ranges before.

    The ranges are cut at evenly spaced keys of a sample by hash, so names with a common beginning are dealt out too; the numbers are exact
    wherever the cuts lie. No task has to hold all rows, which one window over the whole table would do.
    """
    every = max(1, rows.count() // SAMPLED)
    sample = [r[0] for r in rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).orderBy(key).collect()]  # about SAMPLED keys
    cuts = sorted({sample[len(sample) * k // SPLITTERS] for k in range(1, SPLITTERS)}) if sample else []
    group = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    grouped = rows.withColumn("__g", group)
    sizes = grouped.groupBy("__g").agg(F.count("*").alias("__n"))  # at most SPLITTERS rows
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("__g").orderBy(key))
    return grouped.join(F.broadcast(before.select("__g", "__before")), "__g").select(*rows.columns, (place + F.coalesce("__before", F.lit(0))).alias(name))


def bulk_remove(snippets: DataFrame, ids: DataFrame) -> DataFrame:
    return snippets.join(ids.select("id"), "id", "left_anti")


def bulk_update(snippets: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace content, name, tags, language and description of the ids in ``changes``; a change with an empty or taken name is left out.

    Ids and created_at stay, checksum and modified_at follow, the language is taken as given.
    """
    other = snippets.select(F.col("id").alias("owner"), F.col("name").alias("owned"))
    clash = changes.join(other, (F.col("name") == F.col("owned")) & (F.col("id") != F.col("owner")), "left_semi").select("id")
    valid = changes.where("name <> ''").join(clash, "id", "left_anti")
    new = valid.select("id", *(F.col(c).alias(f"__{c}") for c in ("name", "content", "language", "description", "tags")), F.lit(True).alias("__hit"))
    both = snippets.join(new, "id", "left")
    pick = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    sum_ = F.when(F.col("__hit"), checksum(F.col("__content"))).otherwise(F.col("checksum")).alias("checksum")
    when = F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("modified_at")).alias("modified_at")
    return both.select("id", *map(pick, ("name", "content", "language", "description", "tags")), "created_at", when, sum_)


def tag_added(tags: Column, tag: str) -> Column:
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, F.lit(tag)))


def tag_removed(tags: Column, tag: str) -> Column:
    """Without the first occurrence."""
    at = F.array_position(tags, tag)
    return F.when(at > 0, F.filter(tags, lambda _, i: i != at - 1)).otherwise(tags)


def retag(snippets: DataFrame, ids: list[int] | None, operations: list[str]) -> DataFrame:
    """Apply +tag and -tag from left to right to the given snippets, or to all; other operations are ignored."""
    new = F.col("tags")
    for op in operations:
        if op[:1] in ("+", "-") and len(op) > 1:
            new = (tag_added if op[0] == "+" else tag_removed)(new, op[1:])
    new = new if ids is None else F.when(F.col("id").isin(ids), new).otherwise(F.col("tags"))
    return snippets.withColumn("modified_at", F.when(new != F.col("tags"), F.current_timestamp()).otherwise(F.col("modified_at"))).withColumn("tags", new)


# -- a store -------------------------------------------------------------------------------------------------


class SnippetStore:
    """One table of snippets in a folder. Each change writes a new version beside the old one and then names it current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._open = spark, path, True
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(path))

    @staticmethod
    def open(spark: SparkSession, path: str) -> SnippetStore:
        return SnippetStore(spark, path)

    def close(self) -> None:
        self._open = False

    @property
    def is_open(self) -> bool:
        return self._open

    def _versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def table(self) -> DataFrame:
        if not self._open:
            raise StoreError(ErrorCode.STORE_NOT_OPEN)
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{versions[-1]}")

    def commit(self, table: DataFrame) -> None:
        """Write a version under another name, rename it, and drop all but the last two."""
        versions = self._versions()
        n = versions[-1] + 1 if versions else 1
        table.write.mode("overwrite").parquet(f"{self.path}/.v{n}")
        if not self._fs.rename(self._path(f"{self.path}/.v{n}"), self._path(f"{self.path}/v{n}")):
            raise StoreError(ErrorCode.INTERNAL_ERROR, "the new version could not be named")
        for old in versions[:-1]:
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)

    def _next_id(self) -> int:
        """Ids rise; those of removed snippets do not return while the store is not empty."""
        table = self.table()
        marker = self._path(f"{self.path}/next_id")
        last = table.agg(F.max("id")).first()[0]
        if last is None:
            return 1
        stored = self.spark.read.text(f"{self.path}/next_id").first() if self._fs.exists(marker) else None
        return max(last + 1, int(stored[0]) if stored else 1)

    def _set_next_id(self, n: int) -> None:
        self.spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/next_id")

    def add(self, content: str, name: str, tags: list[str] | None = None, language: str = "", description: str = "") -> int:
        tags = tags or []
        table = self.table()
        if not name:
            raise StoreError(ErrorCode.INVALID_ARGUMENT, "a snippet needs a name")
        if not by_name(table, name).isEmpty():
            raise StoreError(ErrorCode.ALREADY_EXISTS, name)
        if len(set(tags)) != len(tags):
            raise StoreError(ErrorCode.INTERNAL_ERROR, "a tag is given twice")
        id_ = self._next_id()
        row = self.spark.createDataFrame([(id_, name, content, language, description, tags)], "id long, name string, content string, language string, description string, tags array<string>")
        row = row.withColumn("language", F.when(F.col("language") == "", detect_language(F.col("content"), F.col("name"))).otherwise(F.col("language")))
        row = row.withColumns({"created_at": F.current_timestamp(), "modified_at": F.current_timestamp(), "checksum": checksum(F.col("content"))})
        self.commit(table.unionByName(row))
        self._set_next_id(id_ + 1)
        return id_

    def get(self, id_: int) -> dict:
        row = by_id(self.table(), id_).first()
        if row is None:
            raise StoreError(ErrorCode.NOT_FOUND, str(id_))
        return row.asDict()

    def find_by_name(self, name: str) -> int:
        row = by_name(self.table(), name).select("id").first()
        if row is None:
            raise StoreError(ErrorCode.NOT_FOUND, name)
        return row["id"]

    def remove(self, id_: int) -> None:
        self.get(id_)
        self.commit(self.table().where(F.col("id") != id_))

    def update(self, id_: int, content: str, name: str, tags: list[str], language: str, description: str) -> None:
        if not name:
            raise StoreError(ErrorCode.INVALID_ARGUMENT, "a snippet needs a name")
        self.get(id_)
        table = self.table()
        if not by_name(table, name).where(F.col("id") != id_).isEmpty():
            raise StoreError(ErrorCode.ALREADY_EXISTS, name)
        change = self.spark.createDataFrame([(id_, name, content, language, description, tags)], "id long, name string, content string, language string, description string, tags array<string>")
        self.commit(bulk_update(table, change))

    def _retag(self, id_: int, operation: str) -> None:
        self.get(id_)
        self.commit(retag(self.table(), [id_], [operation]))

    def add_tag(self, id_: int, tag: str) -> None:
        self._retag(id_, f"+{tag}")

    def remove_tag(self, id_: int, tag: str) -> None:
        self._retag(id_, f"-{tag}")

    def edit(self, id_: int, content: str) -> bool:
        """Replace the content; False if it is the same."""
        import zlib

        old = self.get(id_)
        if old["checksum"] == zlib.crc32(content.encode()):
            return False
        self.update(id_, content, old["name"], old["tags"], old["language"], old["description"])
        return True

    def list_all(self) -> DataFrame:
        return in_key_order(self.table())

    def for_each(self, visit: Callable[[Row], bool]) -> int:
        return for_each(self.table().withColumn("key", F.col("id").cast("string")), "key", visit)

    def tag_count(self, tag: str) -> int:
        return tag_count(self.table(), tag).first()["n"]

    def has_tag(self, tag: str) -> bool:
        return tag_exists(self.table(), tag).first()["found"]

    def find_by_tag(self, tag: str) -> DataFrame:
        return by_tag(self.table(), tag).orderBy("id")

    def find_by_language(self, language: str) -> DataFrame:
        return by_language(self.table(), language)

    def tags(self) -> list[str]:
        return [r["tag"] for r in all_tags(self.table()).orderBy("tag").collect()]

    def tag_counts(self) -> dict[str, int]:
        return {r["tag"]: r["n"] for r in tag_counts(self.table()).orderBy("tag").collect()}

    def search(self, query: str, limit: int = LIMIT) -> DataFrame:
        return search(self.table(), query, limit)

    def count(self) -> int:
        return self.table().count()

