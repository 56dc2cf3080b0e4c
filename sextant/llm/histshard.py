"""Sharding by histogram sort, in DataFrame operations only.

The order is that of (text hash, doc_id), so equal texts are neighbours. The key space is cut into cells by the leading
bits of the key. Each round counts the exact bytes and rows of the cells across all partitions; cells above the tolerance are
probed again with twelve more bits, first of the text hash and then of the doc_id's hash, until each cell is within
tolerance, is a single row, or has no bits left. Splitters are the cell borders nearest to the equal shares of bytes, so a shard is off its
share by at most one tolerance at either end. Rows then move once: to their cell, where they are numbered; the cells'
counted rows give the first slot of each.

The driver holds the cells only, at most 2^12 and 2^12 more for each cell above tolerance, whatever the number of rows.

Defined cases: a null text has size 1; null doc_ids come in the order of their hash; repeated rows are neighbours with slots of their own; an empty table gives no
rows; shards may be empty when there are fewer rows than shards; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import materialize

#: Bits that a round adds; a cell may hold this share of one shard's bytes or rows before it is probed again.
ROUND_BITS, TOLERANCE, BROADCAST_CELLS = 12, 0.01, 200_000
_LEVELS = 10  # five rounds for 60 bits of the text's hash, then five for the doc_id's


def _keys(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "doc_id").alias("b"))
    return rows.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "a", "b")


def _prefix(level: int) -> Column:
    """The key's first bits at a level, as a string that sorts like the key."""
    bits = [F.shiftrightunsigned(c, 64 - ROUND_BITS * (k + 1)).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)) for c in ("a", "b") for k in range(5)]
    return F.concat(*(F.lpad(F.hex(x), 3, "0") for x in bits[: level + 1]))


def cells(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[str, int, int]]:
    """(prefix, bytes, rows) of the final cells, in key order."""
    total = keys.agg(F.sum("size"), F.count("*")).first()
    if not total[1]:
        return []
    most_bytes, most_rows = (tolerance * x / shards for x in total)
    done: list[tuple[str, int, int]] = []
    heavy: list[str] | None = None
    for level in range(_LEVELS):
        part = keys if heavy is None else keys.where(_prefix(level - 1).isin(heavy))
        counted = [tuple(r) for r in part.groupBy(_prefix(level).alias("cell")).agg(F.sum("size"), F.count("*")).collect()]
        over = {c for c, n, rows in counted if rows > 1 and (n > most_bytes or rows > most_rows) and level + 1 < _LEVELS}
        done += [x for x in counted if x[0] not in over]
        heavy = sorted(over)
        if not heavy:
            break
    return sorted(done)


def splitters(sizes: list[int], shards: int) -> list[int]:
    """Shard of each cell: shards end at the cell border nearest to their equal share of the bytes."""
    total, below, out = sum(sizes), 0, []
    for n in sizes:
        # A cell goes to the shard that holds its middle.
        out.append(min(shards - 1, (2 * below + n) * shards // (2 * total)))
        below += n
    return out


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document."""
    spark = docs.sparkSession
    keys = materialize(_keys(docs), "keys")  # texts are read once; rounds count on this
    found = cells(keys, shards, tolerance)
    if not found:
        return keys.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    owner, first, table = splitters([n for _, n, _ in found], shards), [0] * shards, []
    for (cell, _, rows), s in zip(found, owner, strict=True):
        table.append((cell, s, first[s]))
        first[s] += rows
    places = spark.createDataFrame(table, "cell string, shard int, first long")
    by_level: dict[int, list[str]] = {}
    for cell, *_ in found:
        for k in range(3, len(cell), 3):
            by_level.setdefault(k // 3 - 1, []).append(cell[:k])
    cell = _prefix(0)
    for level in sorted(by_level):
        cell = F.when(_prefix(level).isin(sorted(set(by_level[level]))), _prefix(level + 1)).otherwise(cell)
    placed = keys.withColumn("cell", cell).join(F.broadcast(places) if len(table) <= BROADCAST_CELLS else places, "cell")
    unsigned = [F.col(k).bitwiseXOR(F.lit(-(1 << 63))) for k in "ab"]  # as the cells' prefixes count
    order = Window.partitionBy("cell").orderBy(*unsigned, "doc_id", "size", "text_crc32")
    slot = F.col("first") + F.row_number().over(order) - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
