"""Quality rules: base counts of words, symbols and repeats, and suffix-array repetition.

A block of documents is one array of word numbers. Prefix doubling sorts its suffixes by (document, words), so neighbours
share a prefix only inside a document; the ranks of every doubling step give the longest common prefix of neighbours. The
widest prefix a suffix shares with a neighbour is its deepest interval of common prefixes, and every maximal repeated
substring is one of these; their spans of at least ``min_repeat`` words are united. A document is rejected if
the spans cover too large a share of its words or its longest repeat is too long.

Defined cases: a null, empty or blank text has no words and fails the base rule; documents are independent of each other, so
copies and repeated rows get equal verdicts; bytes that are no UTF-8 are characters of words like others. Texts of any length are taken whole. A doubling step
keeps only the suffixes that were not yet told apart, so memory is linear in the text, and n log n only where nearly all of it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import without

#: Shortest repeated substring that counts, the largest share of a document's words that repeats may cover (per cent),
#: and the longest single repeat, as a share of the words (per cent) but at least ``MIN_LONGEST`` words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, MIN_LONGEST = 10, 30, 20, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
_SPACES, _SYMBOLS = b" \t\n\x0b\f\r", b"#*$%&|<>"
#: Bytes that begin no character of a word: white space and the continuation bytes of UTF-8.
_NO_CHARS = _SPACES + bytes(range(0x80, 0xC0))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _doubled(rank: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Refines ranks in place, by the first 2, 4, 8 ... elements, until no two are equal; unequal ranks are in suffix order.

    Yields for each step the positions (ascending) whose rank was shared before it, and their ranks after it.
    """
    n, h = len(rank), 1
    alive = np.flatnonzero(count > 1).astype(np.int32)
    while len(alive):
        ahead = np.where(alive + h < n, rank[np.minimum(alive + h, n - 1)].astype(np.int64) + 1, 0)
        key = rank[alive].astype(np.int64) * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        at, sorted_keys = alive[order], key[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        old = rank[at]
        fresh = np.concatenate([[True], old[1:] != old[:-1]])
        place = np.arange(len(at))
        base = np.maximum.accumulate(np.where(fresh, place, 0))
        mine = np.maximum.accumulate(np.where(new, place, 0))
        rank[at] = old + (mine - base)
        yield alive, rank[alive]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        alive = np.sort(at[np.repeat(size, size) > 1])
        h *= 2


def _same(level: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do the suffixes a and b share a rank at a level? Positions that it does not hold had a rank of their own before."""
    at, rank = level
    i, j = (np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (a, b))
    return (at[i] == a) & (at[j] == b) & (rank[i] == rank[j])


def _common_prefix(first: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes a and b, by the ranks of each doubling step."""
    n, a, b = len(first), a.copy(), b.copy()
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels), -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        hit = ok[_same(levels[k - 1], a[ok], b[ok]) if k else first[a[ok]] == first[b[ok]]]
        out[hit] += 1 << k
        a[hit] += 1 << k
        b[hit] += 1 << k
    return out


def repetition(word_lists: list[list[bytes]], min_repeat: int) -> np.ndarray:
    """(n_repeat_words, covered_words, longest_repeat) for each document, given its words."""
    lens = np.array([len(w) for w in word_lists], np.int64)
    n, numbers = int(lens.sum()), _Numbers()
    out = np.zeros((len(lens), 3), np.int64)
    if not n:
        return out
    ids = np.fromiter((numbers[w] for ws in word_lists for w in ws), np.int64, n)
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    per_doc = lambda flags: np.bincount(doc[flags], minlength=len(lens))
    _, number, count = np.unique(doc * np.int64(len(numbers)) + ids, return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])[number].astype(np.int32)
    del ids
    rank, levels = first.copy(), []
    inside = np.flatnonzero(doc[2:] == doc[:-2])  # first words of three-word windows
    for level in _doubled(rank, count[number]):
        levels.append(level)
        if len(levels) == 1 and len(inside):  # without this step no word occurs twice
            key = rank[inside].astype(np.int64) * n + first[inside + 2]
            order = np.argsort(key, kind="stable")
            s = key[order]
            same = s[1:] == s[:-1]
            twice = inside[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
            mark = np.zeros(n, bool)
            for k in range(3):
                mark[twice + k] = True  # words in windows found twice
            out[:, 0] = per_doc(mark)
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    del rank
    lcp = np.zeros(n + 1, np.int32)
    near = np.flatnonzero(first[suffixes[1:]] == first[suffixes[:-1]])
    lcp[near + 1] = _common_prefix(first, levels, suffixes[near], suffixes[near + 1])
    widest = np.empty(n, np.int32)
    widest[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    np.maximum.at(out[:, 2], doc, widest)
    begin = np.flatnonzero(widest >= min_repeat)
    steps = np.bincount(begin, minlength=n + 1) - np.bincount(begin + widest[begin], minlength=n + 1)
    out[:, 1] = per_doc(np.cumsum(steps)[:n] > 0)
    return out


def _line_counts(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(seen) - len(set(seen))


def _measure(texts: list[bytes], min_repeat: int) -> np.ndarray:
    lists = [t.split() for t in texts]
    out = np.empty((len(texts), len(COUNTS)), np.int64)
    for k, (t, ws) in enumerate(zip(texts, lists, strict=True)):
        symbols = len(t) - len(t.translate(None, _SYMBOLS))
        out[k, :4] = len(ws), len(t.translate(None, _NO_CHARS)), symbols, _line_counts(t)
    out[:, 4:] = repetition(lists, min_repeat)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_repeat: int = MIN_REPEAT, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: its id, the columns in ``keep``, and the counts in ``COUNTS`` (long)."""
    cols = [F.col(id_col), *[F.col(c) for c in keep if c != id_col]]
    rows = docs.select(*cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__text"))
    named = [f for f in rows.schema.fields if f.name != "__text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named), *(f"{c} long" for c in COUNTS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, lo, size, column = [], 0, 0, part.column(len(named))
            for k in range(len(column)):
                texts.append(column[k].as_py())
                size += len(texts[-1])
                if size >= block_bytes or k == len(column) - 1:
                    got = _measure(texts, min_repeat)
                    kept = part.slice(lo, k + 1 - lo)
                    yield pa.RecordBatch.from_arrays([*kept.columns[: len(named)], *(pa.array(got[:, j]) for j in range(len(COUNTS)))], [*(f.name for f in named), *COUNTS])
                    texts, lo, size = [], k + 1, 0

    return rows.mapInArrow(run, schema)


def verdict(measured: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, min_longest: int = MIN_LONGEST) -> DataFrame:
    """Adds base_failed and kept to measured documents."""
    base = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    method = f"100 * covered_words <= {max_covered} * n_words AND (longest_repeat <= {min_longest} OR 100 * longest_repeat <= {max_longest} * n_words)"
    return measured.withColumn("base_failed", F.expr(base)).withColumn("kept", F.expr(f"NOT base_failed AND {method}"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, in which ``doc_id`` and ``text`` are the id and the text.

    Only ids, text keys and texts go through Python; the few that fail are a written table, which takes them out.
    """
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("__key"), F.col("text"))
    judged = verdict(measure(keyed, keep=("__key",)))
    return without(docs, judged.where("NOT kept").select("doc_id", "__key"))
