"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at three or fewer differing bits. One half of the bits then holds at most one of them, so
each half (its low 31 bits) is covered on its own with threshold t = 1. Anchors are the 2^26 codewords of the
[31,26] Hamming code, whose covering radius is R = 1: every fingerprint has one home anchor within R and
at most 16 anchors within R + t. Two fingerprints that link meet at the home anchor of either one, so homes are compared with
replicas, anchor by anchor, by an equi-join that checks all 64 bits. Equal fingerprints are one node before that.
Beyond ``CROSS_ROWS`` fingerprints, where many would share one of the 2^26 anchors by chance, each anchor is crossed with the four bytes of the other half: three
differing bits leave one byte equal, so the links are the same and an anchor has 1/256 of the rows for each byte.

The three bits are op1's contract. ``near_dedup`` links documents in the same way, by fingerprints and anchors, and further at a Jaccard similarity of 0.8 or more
of their five-word shingles, of which three bits show few; it finds all such pairs by an exact join on the rarest shingles of each document.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like any other; a null doc_id takes part
but is never a component's smallest id unless it is alone; repeated rows are copies; other columns are kept where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import components, materialize, scratch

MAX_BITS, CODE_BITS, CODE_CHECKS = 3, 31, 5
#: Distinct fingerprints beyond which anchors are crossed with bytes of the other half.
CROSS_ROWS = 1 << 23
#: One document in SAMPLE is searched for frequent shingles, of which FREQUENT at most are set last in the order of prefixes.
SAMPLE, FREQUENT = 16, 100_000


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 values (seed 42) of the word shingles, repeats included; a shorter text is one shingle, none without words."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the values; 0 without values."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits that are set in over half the XXH64 values (seed 42) of the word shingles; 0 without words."""
    return majority(shingle_hashes(words, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_key): the fingerprint as a signed long and a key of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [fingerprint(t.as_py().lower().split(), shingle) for t in part.column(2)]  # bytes.lower changes A-Z only
            fp = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), fp, part.column(1)], ["doc_id", "fp", "text_key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, text_key long")


def _checks(half: Column) -> Column:
    """Number of the bit (1 to 31) that must flip to give a codeword; 0 for a codeword."""
    out = F.lit(0)
    for c in range(CODE_CHECKS):
        mask = sum(1 << (k - 1) for k in range(1, CODE_BITS + 1) if k >> c & 1)
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, c)
    return out


def _flips() -> list[tuple[int, int, bool]]:
    """(check value, flipped bits, is it the home anchor) for every anchor within two flips; 497 rows whatever the data."""
    rows = [(0, 0, True)]
    for s in range(1, CODE_BITS + 1):
        rows.append((s, 1 << (s - 1), True))
        rows += [(s, 1 << (i - 1) | 1 << ((i ^ s) - 1), False) for i in range(1, CODE_BITS + 1) if i < i ^ s]
    return rows


def links(nodes: DataFrame, crossed: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints ``fp`` at three or fewer differing bits."""
    spark = nodes.sparkSession
    flips = F.broadcast(spark.createDataFrame(_flips(), "checks int, flip long, home boolean"))
    halves = nodes.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.when(F.col("side") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    at = halves.withColumn("half", half).withColumn("checks", _checks(F.col("half"))).join(flips, "checks")
    anchor = F.col("side").cast("long") * (1 << 32) + F.col("half").bitwiseXOR(F.col("flip"))
    if crossed:
        other = F.when(F.col("side") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
        at = at.withColumn("other", other).withColumn("byte", F.explode(F.array(*map(F.lit, range(4)))))
        value = F.call_function("shiftrightunsigned", F.col("other"), 8 * F.col("byte")).bitwiseAND(F.lit(255))
        anchor = anchor * 1024 + F.col("byte") * 256 + value
    at = at.select("fp", "home", anchor.alias("anchor"))
    home = at.where("home").select("anchor", F.col("fp").alias("a"))
    near = at.select("anchor", F.col("fp").alias("b"))
    pairs = home.join(near, "anchor").where(F.expr(f"a <> b AND bit_count(a ^ b) <= {MAX_BITS}"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, label, component_id): the component of each distinct fingerprint and its smallest doc_id."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes")
    labels = components(links(nodes, nodes.count() > CROSS_ROWS), "a", "b").withColumnsRenamed({"node": "fp"})
    tagged = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = tagged.groupBy("label").agg(F.min("least").alias("component_id"))
    return tagged.join(least, "label").select("fp", "label", "component_id")


def simhash_classes(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    out = prints.join(classes(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct XXH64 values (seed 42) of the word shingles, sorted; a shorter text is one shingle, none without words."""
    return np.unique(shingle_hashes(words, shingle))


def _mapped(docs: DataFrame, shingle: int, columns: str, row) -> DataFrame:
    """``columns`` (a long, an int, an array of longs and a long) of every document: (doc_id, text_key, then what ``row`` gives of its shingles' hashes)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    kind, names = rows.schema["doc_id"].dataType.simpleString(), columns.split()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [row(shingle_hashes(t.as_py().lower().split(), shingle)) for t in part.column(2)]
            arrays = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())[: len(names)])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["doc_id", "text_key", *names])

    kinds = ", ".join(f"{name} {k}" for name, k in zip(names, ("long", "int", "array<long>", "long"), strict=False))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, {kinds}")


def _set_id(values: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), 42)).view(np.int64))


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a sample, the most frequent last. They only order prefixes, so any list gives the same links."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    each = _mapped(sample, shingle, "id n all", lambda h: (0, len(v := np.unique(h)), v.view(np.int64))).select(F.explode("all").alias("h"))
    top = each.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64)


def _prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, id, n, prefix, fp): key and size of the shingle set, its rarest shingles, of which similar sets share one, and the fingerprint."""
    frequent = _frequent(docs, shingle).view(np.uint64)
    order = np.argsort(frequent)
    known = frequent[order]

    def row(hashes: np.ndarray):
        values = np.unique(hashes)
        n = len(values)
        rank = np.zeros(n, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            rank = np.where(known[at] == values, order[at] + 1, 0)
        prefix = values[np.lexsort((values, rank))][: n - (4 * n + 4) // 5 + 1]
        return _set_id(values), n, prefix.view(np.int64), int(np.uint64(majority(hashes)).view(np.int64))

    return _mapped(docs, shingle, "id n prefix fp", row)


def _similar(pairs: DataFrame, prints: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(x, y): pairs of set keys whose sets have a Jaccard similarity of 0.8 or more, by the sets themselves."""
    pairs = materialize(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    one = prints.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("text_key", "doc_id")).alias("d"))
    one = materialize(one.select(F.col("d.doc_id").alias("__id"), F.col("d.text_key").alias("__key")), "wanted")
    wanted = docs.join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_semi")
    sets = _mapped(wanted, shingle, "id n all", lambda h: (_set_id(v := np.unique(h)), len(v), v.view(np.int64))).dropDuplicates(["id"])
    sets = materialize(sets.select("id", "all"), "sets")
    x, y = (sets.select(F.col("id").alias(k), F.col("all").alias(f"{k}_all")) for k in "xy")
    both = pairs.join(x, "x").join(y, "y")
    return both.where("9 * size(array_intersect(x_all, y_all)) >= 4 * (size(x_all) + size(y_all))").select("x", "y")


def simhash_links(prints: DataFrame) -> DataFrame:
    """(x, y): set keys, linked with the smallest set key of the SimHash component that their fingerprint is in."""
    nodes = prints.select("fp", "id").distinct()
    same = classes(nodes.withColumnRenamed("id", "doc_id"))
    return nodes.join(same, "fp").where("id <> component_id").select(F.col("component_id").alias("x"), F.col("id").alias("y"))


def similar_sets(prints: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(x, y): links between set keys whose components are those of all pairs with three or fewer differing bits of their fingerprints, or
    with a Jaccard similarity of 0.8 or more.

    SimHash gives the first links. Each set is compared with the smallest key under each of its prefix shingles only, which settles families of near copies in
    as many comparisons as they have rows. Then sets that both leave apart are compared wherever they share a prefix shingle.
    """
    fits = "5 * least(x_.n, y_.n) >= 4 * greatest(x_.n, y_.n) AND 9 * (1 + least(x_.n - x_.pos, y_.n - y_.pos)) >= 4 * (x_.n + y_.n)"  # pos from 1
    nodes = prints.groupBy("id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "id", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos") + 1).alias("packed"))
    group = Window.partitionBy("key")
    here = F.struct("id", F.shiftright("packed", 32).cast("int").alias("n"), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    rows = rows.select("key", here.alias("y_"), F.min(here).over(group).alias("x_"), F.count("*").over(group).alias("met"))
    rows = materialize(rows.where("met > 1").drop("met"), "shared")
    star = rows.where("x_.id <> y_.id").where(fits).select(F.col("x_.id").alias("x"), F.col("y_.id").alias("y"))
    star = materialize(_similar(star, prints, docs, shingle).union(simhash_links(prints)), "star")
    labels = components(star, "x", "y").withColumnsRenamed({"node": "id"})
    left = rows.select("key", "y_", F.col("y_.id").alias("id")).join(labels, "id", "left").select("key", "y_", F.coalesce("label", "id").alias("label"))
    left = left.select("*", F.min("label").over(group).alias("low"), F.max("label").over(group).alias("high")).where("low <> high")
    left = materialize(left.select("key", "y_", "label"), "apart")
    a = left.select("key", F.col("y_").alias("x_"), F.col("label").alias("x_label"))
    pairs = a.join(left, "key").where(f"x_label <> label AND x_.id < y_.id AND {fits}").select(F.col("x_.id").alias("x"), F.col("y_.id").alias("y"))
    return star.union(_similar(pairs, prints, docs, shingle))


def near_dedup(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The document with the smallest doc_id of each component (null ids last), with all its columns; of repeated rows, one.

    Documents link at three or fewer differing bits of their SimHash fingerprints, found by anchors, or at a Jaccard similarity of 0.8 or more of their sets of word
    shingles. The join on prefixes finds every such pair, however far the fingerprints of similar texts lie apart. Texts without words are equal sets.
    """
    with scratch(docs.sparkSession, "kept"):
        best, repeats = _kept(docs, shingle)
    key = F.xxhash64("text")
    kept = docs.join(best.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_semi")
    if not repeats:
        return kept
    names = docs.columns
    return kept.withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).select(*names)


def _kept(docs: DataFrame, shingle: int) -> tuple[DataFrame, bool]:
    """(doc_id, text_key) of the document that stays of each component, as a written table, and whether rows repeat."""
    prints = materialize(_prefixes(docs, shingle), "prints")
    links_ = materialize(similar_sets(prints, docs, shingle), "similar")
    labels = components(links_, "x", "y").withColumnsRenamed({"node": "id"})
    tagged = prints.select("doc_id", "text_key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    best = tagged.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("w"))
    best = materialize(best.select("w.doc_id", "w.text_key"), "kept")
    return best, not prints.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
