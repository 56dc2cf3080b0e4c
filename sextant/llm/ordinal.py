"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector over hashed text features and ordered thresholds theta. Features are
the distinct lower-cased words and marks of their shape (symbols, capitals, repeats), hashed into 2^18 places, each with
weight n^-1/4 for n distinct ones. The grade of a labelled document is 0 if it is toxic, 1 if it is of low quality,
else 2. The model is fitted by adaptive gradient steps on at most ``MAX_ROWS`` labelled documents, those with the least hash
of the doc_id, whatever the size of the input; every document is scored on its whole text.

Defined cases: labels without a document and labelled nulls are ignored; of repeated labels each counts; a null, empty or blank text has no
features and gets the score of the thresholds alone; without labels all grades are equally likely; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest training sample, hashed places, passes over the sample, grades, least chance of the best grade for
#: selection, and labelled documents that must share a feature for it to get a weight.
MAX_ROWS, PLACES, PASSES, GRADES, SELECT, LEAST = 6000, 1 << 18, 16, 3, 0.5, 8


def features(text: str) -> np.ndarray:
    """Sorted places of the distinct words and shape marks of a text."""
    import xxhash

    found, words, odd, caps = set(), text.split(), 0, 0
    distinct = set(words)
    for w in distinct:
        low = w.lower()
        core = low.strip(".,;:!?*#$%&|\"'()")
        found.add(core or low)
        if core != low:
            tail = low[len(core) + low.find(core) :] if core else low
            if len(tail) > 1 or tail not in ".,;:!?":
                found.add("\x01" + tail[:4])
                odd += 1
        caps += len(w) > 2 and w.isupper()
    if distinct:  # shares in eighths: distinct words, words with symbols, words in capitals; and the length
        marks = (8 * len(distinct) // len(words), -(-8 * odd // len(distinct)), -(-8 * caps // len(distinct)), len(words).bit_length())
        found |= {f"\x02{k} {x}" for k, x in enumerate(marks)} | {f"\x03{k}" for k in (1, 2) if marks[k] >= 2} | ({"\x030"} if marks[0] <= 3 and len(words) < 2000 else set())
    places = np.fromiter((xxhash.xxh32_intdigest(f) % PLACES for f in found), np.int64, len(found))
    return np.unique(places)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, places: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        z = float(self.weights[places].sum()) * len(places) ** -0.25 if len(places) else 0.0
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - z, -30, 30)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit(samples: list[tuple[np.ndarray, int]], passes: int = PASSES, step: float = 0.5, shrink: float = 1e-4) -> Model:
    """Adaptive gradient descent on the negative log-likelihood; thresholds are the first one and positive gaps."""
    w, seen = np.zeros(PLACES), np.full(PLACES, 1.0)
    cuts, cut_seen = np.zeros(GRADES - 1), np.full(GRADES - 1, 1e-6)
    often = np.bincount(np.concatenate([x for x, _ in samples] or [np.zeros(0, np.int64)]), minlength=PLACES) >= LEAST
    sizes = [max(1, len(x)) ** -0.25 for x, _ in samples]
    samples = [(x[often[x]], g) for x, g in samples]
    counts = np.bincount([g for _, g in samples], minlength=GRADES) + 1.0
    share = np.cumsum(counts / counts.sum())[:-1]
    theta = np.log(share / (1 - share))
    cuts[0], cuts[1:] = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    # Rarer grades weigh more, so that few toxic documents still move the weights.
    cost = np.sqrt(counts.max() / counts)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(samples)):
            x, g = samples[k]
            if not len(x):
                continue
            scale = sizes[k]
            theta = np.concatenate([[cuts[0]], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
            z = w[x].sum() * scale
            s = 1 / (1 + np.exp(-np.clip(theta - z, -30, 30)))
            hi, lo = (s[g] if g < GRADES - 1 else 1.0), (s[g - 1] if g else 0.0)
            p = max(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
            # d(-log p)/dz and with respect to the thresholds
            dz = cost[g] * (d_hi - d_lo) / p
            dt = np.zeros(GRADES - 1)
            if g < GRADES - 1:
                dt[g] -= cost[g] * d_hi / p
            if g:
                dt[g - 1] += cost[g] * d_lo / p
            grad = dz * scale + shrink * w[x]
            seen[x] += grad**2
            w[x] -= step * grad / np.sqrt(seen[x])
            dc = np.concatenate([[dt.sum()], np.exp(cuts[1:]) * np.cumsum(dt[::-1])[::-1][1:]])
            cut_seen += dc**2
            cuts -= 0.1 * dc / np.sqrt(cut_seen)
    return Model(w.astype(np.float32), np.concatenate([[cuts[0]], cuts[0] + np.cumsum(np.exp(cuts[1:]))]))


def _places(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [features(t.as_py()).astype(np.int32) for t in part.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(got, pa.list_(pa.int32()))], [*keep, "places"])

    return rows.mapInArrow(run, ", ".join([*kinds, "places array<int>"]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the ``max_rows`` labels with the least hash of their doc_id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows)  # the documented bound of the sample
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    got = sorted((r["doc_id"], r["grade"], r["places"]) for r in _places(rows, ["doc_id", "grade"]).toLocalIterator())
    return fit([(np.array(p, np.int64), g) for _, g, p in got])


def score(docs: DataFrame, model: Model, select: float = SELECT) -> DataFrame:
    """(doc_id, expected_grade, p_low, p_best, selected): mean grade, chance of grade 0, chance of the best grade, and whether that is enough."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights of four bytes

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            p = np.array([m.chances(features(t.as_py())) for t in part.column(1)]).reshape(-1, GRADES)
            best = p[:, -1]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (p @ np.arange(GRADES), p[:, 0], best, best >= select))], ["doc_id", "expected_grade", "p_low", "p_best", "selected"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, p_low double, p_best double, selected boolean")
