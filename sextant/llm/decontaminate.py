"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Texts are lower-cased runs of letters, marks and digits, and five-word shingles of these. Windows have the size of a benchmark
item. A window can only be similar to an item if the two share a shingle, so windows are placed where a document's shingle
meets an item's: at the offset at which the two coincide, within the document. Each window and each item gets a 64-bit SimHash of
its shingles. The multi-index cuts fingerprints into eight blocks of eight bits: two fingerprints within ``RADIUS`` = 20 bits
differ by two bits or fewer in some block (eight blocks of three make 24), so items are entered under all 37 values
within two bits of each block and windows look up their own eight values. Candidates within the radius are verified by the exact
weighted Jaccard similarity of their shingles, weights being multiplicities; 0.8 or more is contamination. An item of fewer than five words is one
shingle of its own size, which a similar window must equal, so it is looked up among the document's shingles of that size.

The benchmark's side is broadcast only while its counted rows are within ``BROADCAST_ROWS``; beyond that the same joins shuffle.

Defined cases: an item of one to four words matches where its words stand in this order; a text of one to four words is one shingle; those without words match nothing; null ids are ids like any other;
equal rows give one result; repeated items each match; a document shorter than an item is one window; extra columns are ignored, and kept where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import let
from sextant.llm.common import materialize, without

SHINGLE, RADIUS, SIMILARITY, BROADCAST_ROWS = 5, 20, 0.8, 1_000_000
BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the text's word shingles, in order; a shorter text is one shingle."""
    all_ = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")

    def hashes(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<bigint>"))

    return let(all_, hashes)


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != ""))


def with_fingerprint(df: DataFrame, hashes: str, lanes: int) -> DataFrame:
    """Adds ``fp``: bits set in over half the hashes. Bits are counted ``lanes`` at a time, in the lanes of one long."""
    step = 64 // lanes
    mask = sum(1 << (step * j) for j in range(lanes))

    def adds(k: int):
        return lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask))

    df = df.withColumns({f"__{k}": F.aggregate(hashes, F.lit(0).cast("long"), adds(k)) for k in range(step)})
    fp = F.lit(0).cast("long")
    for bit in range(64):
        count = F.shiftrightunsigned(f"__{bit % step}", step * (bit // step)).bitwiseAND(F.lit((1 << step) - 1))
        one = 1 << bit if bit < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(2 * count > F.size(hashes), F.lit(one)).otherwise(F.lit(0).cast("long")))
    return df.withColumn("fp", fp).drop(*(f"__{k}" for k in range(step)))


def _block(fp: str, b: int) -> str:
    return f"(shiftrightunsigned({fp}, {BLOCK_BITS * b}) & {(1 << BLOCK_BITS) - 1})"


def _bag(hashes: str) -> Column:
    """The hashes numbered by occurrence, so that set operations on the result count multiplicities."""
    return let(F.sort_array(hashes), lambda s: F.transform(s, lambda h, i: F.xxhash64(h, i - F.call_function("array_position", s, h))))


def matches(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, start): for each contaminated document and item the best window, by its first shingle."""
    items = benchmark.select("item_id", _n_words(F.col("text")).alias("words"), shingles(F.col("text")).alias("item")).where("words > 0")
    short = materialize(benchmark.select("item_id", "text", _n_words(F.col("text")).alias("words")).where(f"words BETWEEN 1 AND {SHINGLE - 1}"), "short")
    items = items.where(f"words >= {SHINGLE}").drop("words")
    items = materialize(items.withColumn("m", F.size("item")), "items")
    entries, longest = items.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    items = materialize(with_fingerprint(items, "item", 4 if longest < 1 << 15 else 2), "items")
    fits = max(entries, items.count() * BLOCKS * 37) <= BROADCAST_ROWS
    bounded = F.broadcast if fits else (lambda df: df)

    at = items.select("m", F.posexplode("item").alias("q", "h")).distinct()
    text_key = F.xxhash64("text").alias("text_key")
    hashed = docs.select("doc_id", text_key, shingles(F.col("text")).alias("all"))
    each = hashed.select("doc_id", "text_key", F.size("all").alias("n"), F.posexplode("all").alias("p", "h"))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("m")))
    hits = each.join(bounded(at), "h").select("doc_id", "text_key", start.alias("start"), "m").distinct()
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "m")).alias("windows"))
    hits = materialize(hits, "windows").withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})

    chosen = docs.select("doc_id", text_key, "text").join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    chosen = chosen.select("doc_id", "text_key", shingles(F.col("text")).alias("all"), F.explode("windows").alias("w"))
    windows = chosen.select("doc_id", "text_key", "w.start", "w.m", F.call_function("slice", F.col("all"), F.col("w.start") + 1, F.col("w.m")).alias("window"))
    windows = with_fingerprint(windows, "window", 4 if longest < 1 << 15 else 2).withColumnRenamed("fp", "wfp")
    windows = materialize(windows, "windows")

    masks = [0] + [1 << i for i in range(BLOCK_BITS)] + [1 << i | 1 << j for i in range(BLOCK_BITS) for j in range(i)]
    values = lambda fp: F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.expr(_block(fp, b)).alias("v")) for b in range(BLOCKS))))
    index = items.select("item_id", "m", "item", "fp", values("fp").alias("e"))
    index = index.select("item_id", "m", "item", "fp", "e.b", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda x: x.bitwiseXOR(F.col("e.v")))).alias("v"))
    probes = windows.select("*", values("wfp").alias("e")).select("doc_id", "text_key", "start", "m", "window", "wfp", "e.b", "e.v")
    first = "CASE " + " ".join(f"WHEN bit_count({_block('fp', b)} ^ {_block('wfp', b)}) <= {NEAR} THEN {b}" for b in range(BLOCKS)) + " END"
    close = probes.join(bounded(index), ["m", "b", "v"]).where(F.expr(f"bit_count(fp ^ wfp) <= {radius} AND b = {first}"))

    exact = let(F.size(F.array_intersect(_bag("window"), _bag("item"))), lambda both: both / (F.size("window") + F.size("item") - both))
    found = close.select("doc_id", "text_key", "item_id", "start", exact.alias("similarity")).where(F.col("similarity") >= similarity)
    for size in sorted(r[0] for r in short.select("words").distinct().collect()):  # four at most
        wanted = short.where(F.col("words") == size).select("item_id", F.get(shingles(F.col("text"), size), 0).alias("h"))
        texts = docs.where(_n_words(F.col("text")) >= size).select("doc_id", text_key, shingles(F.col("text"), size).alias("all"))
        places = texts.select("doc_id", "text_key", F.posexplode_outer("all").alias("start", "h")).join(F.broadcast(wanted) if short.count() <= BROADCAST_ROWS else wanted, "h")
        found = found.unionByName(places.select("doc_id", "text_key", "item_id", "start", F.lit(1.0).alias("similarity")))
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("w"))
    return best.select("doc_id", "text_key", "item_id", F.col("w.similarity").alias("similarity"), (-F.col("w.s")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no window similar to an item, with all their columns."""
    return without(docs, matches(docs, benchmark).select("doc_id", F.col("text_key").alias("__key")))
