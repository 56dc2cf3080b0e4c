"""Exact nearest neighbours: a scan with TakeOrderedAndProject for one query, ranked candidates for many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.errors import ErrorCode, StoreError
from sextant.functions.text import tokenize
from sextant.functions.vectors import distance, to_similarity

#: Queries of one block of a batch search, vectors of one part, parts at most, distances held at once.
BLOCK, PART, MOST_PARTS, CELLS = 4096, 16384, 4096, 1 << 22
#: Dimensions up to which an embedding of tokens is so many sums of one aggregation.
SUMS = 128


def _distances(vectors: DataFrame, query: Column, metric: str) -> DataFrame:
    d = distance(metric, F.col("embedding"), query)
    return vectors.select("vec_id", F.round(d, 6).alias("distance"))


def knn(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """(vec_id, distance, similarity) of the k nearest. A stored vector of another size than the query ends the job with INVALID_ARGUMENT."""
    wrong = F.raise_error(F.format_string(f"INVALID_ARGUMENT: the query has {len(query)} dimensions, a vector %d", F.size("embedding")))
    checked = vectors.select("vec_id", F.when(F.size("embedding") == len(query), F.col("embedding")).otherwise(wrong.cast(vectors.schema["embedding"].dataType)).alias("embedding"))
    near = _distances(checked, F.array(*(F.lit(float(x)) for x in query)), metric).orderBy("distance", "vec_id").limit(k)
    return near.withColumn("similarity", F.round(to_similarity(metric, F.col("distance")), 6))


def knn_of(vectors: DataFrame, vec_id: int, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Nearest to a stored vector, itself included; the query is a single broadcast row."""
    query = vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query")).limit(1)
    both = vectors.join(F.broadcast(query))
    near = both.select("vec_id", F.round(distance(metric, F.col("embedding"), F.col("query")), 6).alias("distance")).orderBy("distance", "vec_id").limit(k)
    return near.withColumn("similarity", F.round(to_similarity(metric, F.col("distance")), 6))


def within_distance(near: DataFrame, most: float) -> DataFrame:
    """The threshold comes after the k nearest are taken."""
    return near.where(F.col("distance") <= most)


def with_similarity(near: DataFrame, least: float) -> DataFrame:
    return near.where(F.col("similarity") >= least)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, distance) for a stated set of queries (query_id, query) against all vectors, each pair compared.

    Vectors are dealt into parts, queries into blocks; a task compares a part with a block, keeps its k best a query, and these are ranked together.
    Dot products of a part and a block are one product of matrices, some rows at a time, so memory doesn't grow with either.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    n, m = queries.count(), vectors.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, min(MOST_PARTS, -(-m // PART)))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), each(blocks).alias("block"))
    right = queries.select("query_id", F.col("query").cast("array<double>").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"))
    kinds = {c: queries.schema["query_id"].dataType.simpleString() if c == "query_id" else vectors.schema["vec_id"].dataType.simpleString() for c in ("query_id", "vec_id")}
    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_nearest(k, metric), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, distance double")
    near = near.withColumn("distance", F.round("distance", 6))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _nearest(k: int, metric: str) -> Callable:
    """Of a part of the vectors and a block of queries, as Arrow tables: the k nearest of each query, by the rounded distance, then by id."""

    def matrices(ids, arrays) -> dict:
        """(ids, matrix) by size, in the order of the ids; null arrays have the size -1."""
        import numpy as np
        import pyarrow.compute as pc

        arrays, order = arrays.combine_chunks(), pc.sort_indices(ids, null_placement="at_start").to_numpy()
        size = pc.fill_null(pc.list_value_length(arrays), -1).to_numpy(zero_copy_only=False)[order]
        out = {}
        for s in map(int, np.unique(size)):
            own = order[size == s]
            flat = arrays.take(own).flatten().to_numpy(zero_copy_only=False) if s > 0 else np.zeros(0)
            out[s] = (ids.take(own), flat.reshape(len(own), max(s, 0)))
        return out

    def distances(a, b, same: bool):
        """Of each row of ``b`` from all rows of ``a``, by cosine 1 where the sizes differ."""
        import numpy as np

        if not same:
            return np.ones((len(b), len(a)))
        if metric == "l2":  # squares of differences, as a product of matrices would lose digits
            return np.stack([((a - row) ** 2).sum(axis=1) for row in b])
        dots = b @ a.T
        if metric == "ip":
            return 1 - dots
        size = np.sqrt((b * b).sum(axis=1))[:, None] * np.sqrt((a * a).sum(axis=1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size == 0, 1.0, 1 - dots / size)

    def smallest(d):
        """Places of the k smallest of each row, by the rounded distance, then in the order of the columns."""
        import numpy as np

        near = np.ones(d.shape, bool)
        if d.shape[1] > k:  # all up to the k-th smallest and what may round to it
            near = ~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2e-6)
        rows, cols = np.nonzero(near)
        order = np.lexsort((cols, np.floor(d[rows, cols] * 1e6 + 0.5), rows))
        rows, cols = rows[order], cols[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[kept], cols[kept]

    def run(left, right):
        import pyarrow as pa

        kinds = {"query_id": right.schema.field("query_id").type, "vec_id": left.schema.field("vec_id").type, "distance": pa.float64()}
        found = {name: [pa.array([], kind)] for name, kind in kinds.items()}
        if left.num_rows and right.num_rows:
            vectors = matrices(left["vec_id"], left["e"])
            for s, (query_ids, b) in matrices(right["query_id"], right["q"]).items():
                for t, (ids, a) in vectors.items():
                    known = min(s, t) >= 0 and (s == t or metric == "cosine")  # else there is no distance, as of a null
                    step = max(1, CELLS // len(ids))
                    for i in range(0, len(b), step):
                        d = distances(a, b[i : i + step], s == t and known)
                        rows, cols = smallest(d)
                        found["query_id"] += query_ids.take(i + rows).chunks
                        found["vec_id"] += ids.take(cols).chunks
                        found["distance"].append(pa.array(d[rows, cols]) if known else pa.nulls(len(rows), pa.float64()))
        return pa.table({name: pa.chunked_array(x, kinds[name]) for name, x in found.items()})

    return run


def save(vectors: DataFrame, path: str) -> None:
    """Write an index; its one dimension is checked."""
    sizes = [r[0] for r in vectors.select(F.size("embedding")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise StoreError(ErrorCode.INVALID_ARGUMENT, f"vectors of {sizes[0]} and of {sizes[1]} dimensions")
    vectors.select("vec_id", "embedding").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """A written index; NOT_FOUND if there is none, INVALID_ARGUMENT if it has another dimension than the one asked for."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise StoreError(ErrorCode.NOT_FOUND, path)
    vectors = spark.read.parquet(path)
    first = vectors.select(F.size("embedding")).first()
    if dimension is not None and first is not None and first[0] != dimension:
        raise StoreError(ErrorCode.INVALID_ARGUMENT, f"the index has {first[0]} dimensions, not {dimension}")
    return vectors


def contains(vectors: DataFrame, vec_id: int) -> DataFrame:
    """(found): is there a vector with this id?"""
    return vectors.where(F.col("vec_id") == vec_id).agg((F.count("*") > 0).alias("found"))


def upsert(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """New and replaced vectors; ids in ``changed`` win."""
    return vectors.join(changed.select("vec_id"), "vec_id", "left_anti").unionByName(changed)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id"), "vec_id", "left_anti")


def hashing_embedder(dimension: int = 64) -> Callable[[Column], Column]:
    """An embedder without a model: signed counts of hashed tokens, as array<double>. For tables, ``embed_tokens`` gives the same faster."""

    def embed(text: Column) -> Column:
        h = F.transform(tokenize(text), _hashed)
        zero = F.array_repeat(F.lit(0.0), dimension)
        return F.aggregate(h, zero, lambda a, x: F.transform(a, lambda v, i: v + F.when(_place(x, dimension) == i, _sign(x, dimension)).otherwise(0.0)))

    embed.is_column = True
    return embed


def _hashed(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def _place(h: Column, dimension: int) -> Column:
    return F.pmod(h, F.lit(dimension))


def _sign(h: Column, dimension: int) -> Column:
    return F.when(F.floor(h / dimension) % 2 == 1, -1.0).otherwise(1.0)


def embed_tokens(docs: DataFrame, dimension: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(vec_id, embedding) of every document with a token, as ``hashing_embedder`` makes them: token counts are summed before anything is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(text_col).alias("text")).repartition("vec_id")  # few files or row groups would else be few tasks
    tokens = rows.select("vec_id", tokenize(F.col("text")).alias("tokens")).select("vec_id", F.explode_outer("tokens").alias("t")).where("t IS NOT NULL")
    hashed = tokens.select("vec_id", _hashed(F.col("t")).alias("h"))
    signed = hashed.select("vec_id", _place(F.col("h"), dimension).alias("place"), _sign(F.col("h"), dimension).alias("sign"))
    if dimension <= SUMS:  # a sum for each place: one row a document, and no arrays to be gathered
        return signed.groupBy("vec_id").agg(F.array(*(F.sum(F.when(F.col("place") == i, F.col("sign")).otherwise(0.0)) for i in range(dimension))).alias("embedding"))
    cells = signed.groupBy("vec_id", "place").agg(F.sum("sign").alias("v"))
    rows = cells.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))  # at most ``dimension`` entries
    return rows.select("vec_id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))


def embed_with(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(vec_id, embedding) by a callable that embeds a batch of texts; one Arrow batch at a time."""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            yield pd.DataFrame({"vec_id": part["vec_id"], "embedding": model(part["text"].tolist())})

    return docs.select(F.col(id_col).alias("vec_id"), F.col(text_col).alias("text")).mapInPandas(run, "vec_id long, embedding array<float>")
