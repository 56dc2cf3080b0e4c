"""Hybrid search: query parsing and mode detection on the driver, one plan over keyword, fuzzy and semantic legs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators import keyword, trigram, vector

LIMIT = 50


class Mode(Enum):
    AUTO, KEYWORD, FUZZY, SUBSTRING, SEMANTIC, HYBRID = range(6)


@dataclass(frozen=True)
class SearchQuery:
    text: str
    mode: Mode = Mode.AUTO
    limit: int = LIMIT
    fuzzy_threshold: float = 0.3
    semantic_threshold: float = 0.5
    weights: tuple[float, float, float] = (0.4, 0.2, 0.4)
    allow_fuzzy: bool = False
    require_exact: bool = False
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def parse(text: str) -> SearchQuery:
    """+x and -x are set aside, ~x asks for fuzzy search, quotes for exact search; what is left is the text, unless nothing is."""
    rest: list[str] = []
    flags: dict = {"allow_fuzzy": False, "require_exact": False}
    asked: dict[str, list[str]] = {"+": [], "-": []}
    todo = text.split()
    while todo:
        word = todo.pop(0)
        if word[0] in "+-" and len(word) > 1:
            asked[word[0]].append(word[1:])
        elif word[0] == "~":
            flags["allow_fuzzy"] = True
            rest += [word[1:]] if len(word) > 1 else []
        elif word[0] == '"':
            flags["require_exact"] = True
            taken = [word[1:]]
            while taken[0] and not taken[-1].endswith('"') and todo:
                taken.append(todo.pop(0))
            rest.append(" ".join(taken).removesuffix('"'))
        else:
            rest.append(word)
    return SearchQuery(" ".join(rest) or text, required=tuple(asked["+"]), excluded=tuple(asked["-"]), **flags)


def detect_mode(q: SearchQuery, has_keyword: bool = True, has_fuzzy: bool = True, has_vectors: bool = True, semantic_length: int = 10) -> Mode:
    """The first rule that holds decides."""
    runs, size = len(re.findall("[A-Za-z0-9]+", q.text)), len(q.text.encode())
    asks = any(x in q.text for x in ("?", "how", "what", "why"))
    rules = (
        (q.require_exact, Mode.KEYWORD),
        (q.allow_fuzzy and has_fuzzy, Mode.FUZZY),
        (runs == 1 and size < 20, Mode.KEYWORD),
        (has_vectors and (runs >= 3 and size >= semantic_length or asks), Mode.SEMANTIC),
        (has_keyword and has_fuzzy and has_vectors, Mode.HYBRID),
        (has_keyword, Mode.KEYWORD),
        (has_fuzzy, Mode.FUZZY),
        (has_vectors, Mode.SEMANTIC),
    )
    return next((mode for holds, mode in rules if holds), Mode.KEYWORD)


def mode_column(text: Column, has_keyword: bool = True, has_fuzzy: bool = True, has_vectors: bool = True, semantic_length: int = 10) -> Column:
    """Name of the mode of each plain query text (without quotes and signs), by the rules of ``detect_mode``."""
    runs, size = F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))), F.octet_length(text)
    asks = text.contains("?") | text.contains("how") | text.contains("what") | text.contains("why")
    rest = detect_mode(SearchQuery(""), has_keyword, has_fuzzy, has_vectors)  # what the availability of the indexes decides
    semantic = F.lit(has_vectors) & ((runs >= 3) & (size >= semantic_length) | asks)
    return F.when((runs == 1) & (size < 20), Mode.KEYWORD.name).when(semantic, Mode.SEMANTIC.name).otherwise(rest.name)


def fuse(legs: dict[str, DataFrame], weights: tuple[float, float, float]) -> DataFrame:
    """Legs (doc_id, score) by name keyword, fuzzy, semantic: each divided by its largest score, then weighted; absent is 0.

    A leg may have positions, the places of its terms, which the result carries; matched_text is empty, as no leg cuts text out.
    The legs are stacked and grouped once, in place of a chain of outer joins.
    """
    names = ("keyword", "fuzzy", "semantic")
    parts = []
    none = F.lit(None).cast("array<int>")
    for name in names:
        if (leg := legs.get(name)) is not None:
            top = leg.agg(F.max("score").alias("top"))  # one row
            positions = F.col("positions") if "positions" in leg.columns else none
            part = leg.join(F.broadcast(top)).select("doc_id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("s"), positions.alias("positions"))
            parts.append(part.select("doc_id", *((F.col("s") if n == name else F.lit(0.0)).alias(f"{n}_score") for n in names), "positions"))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    positions = F.coalesce(F.first("positions", ignorenulls=True), F.array().cast("array<int>")).alias("positions")
    merged = stacked.groupBy("doc_id").agg(*(F.round(F.max(f"{n}_score"), 6).alias(f"{n}_score") for n in names), positions)
    final = sum((F.col(f"{n}_score") * w for n, w in zip(names, weights, strict=True)), F.lit(0.0))
    return merged.select("doc_id", *(f"{n}_score" for n in names), F.round(final, 6).alias("final_score"), "positions", F.lit("").alias("matched_text"))


def with_rows(hits: DataFrame, rows: DataFrame, id_col: str = "id", columns: tuple[str, ...] = ("name", "description", "language", "tags")) -> DataFrame:
    """Hits with columns of the rows that they name; hits are few, so the rows are read with a broadcast join."""
    return hits.join(rows.select(F.col(id_col).cast("long").alias("doc_id"), *(c for c in columns if c in rows.columns)), "doc_id", "left")


@dataclass
class SearchRouter:
    """Searches over whichever of the indexes are given."""

    keywords: keyword.KeywordIndex | None = None
    grams: DataFrame | trigram.Texts | None = None
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | Callable[[Column], Column] | None = None  # of a text, or as a column expression
    limits: dict = field(default_factory=dict)

    def _leg(self, name: str, q: SearchQuery) -> DataFrame | None:
        if name == "keyword" and self.keywords is not None:
            return keyword.search_boolean(self.keywords, q.text).select("doc_id", "score", "positions")
        if name == "fuzzy" and self.grams is not None:
            return trigram.search_fuzzy(self.grams, q.text, q.fuzzy_threshold).select("doc_id", F.col("similarity").alias("score"))
        if name == "substring" and self.grams is not None:
            return trigram.search_substring(self.grams, q.text).withColumn("score", F.lit(1.0))
        if name == "semantic" and self.vectors is not None and self.embed is not None:
            near = vector.knn(self.vectors, self._embedded(q.text), q.limit)
            return vector.with_similarity(near, q.semantic_threshold).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
        return None

    def _embedded(self, text: str) -> list[float]:
        made = self.embed(F.lit(text)) if getattr(self.embed, "is_column", False) else self.embed(text)
        if isinstance(made, Column):  # one row, computed by Spark
            made = self.vectors.sparkSession.range(1).select(made).first()[0]
        return list(made)

    def search(self, query: str | SearchQuery) -> DataFrame:
        """(doc_id, keyword_score, fuzzy_score, semantic_score, final_score, positions, matched_text), best first, at most the query's limit."""
        q = parse(query) if isinstance(query, str) else query
        mode = q.mode
        if mode is Mode.AUTO:
            mode = detect_mode(q, self.keywords is not None, self.grams is not None, self.vectors is not None)
        wanted = {Mode.KEYWORD: {"keyword": "keyword"}, Mode.FUZZY: {"fuzzy": "fuzzy"}, Mode.SUBSTRING: {"fuzzy": "substring"}, Mode.SEMANTIC: {"semantic": "semantic"}}
        legs = {k: leg for k, v in wanted.get(mode, {n: n for n in ("keyword", "fuzzy", "semantic")}).items() if (leg := self._leg(v, q)) is not None}
        if not legs or not q.text.strip():
            from pyspark.sql import SparkSession

            return SparkSession.active().createDataFrame([], "doc_id long, keyword_score double, fuzzy_score double, semantic_score double, final_score double, positions array<int>, matched_text string")
        return fuse(legs, q.weights).orderBy(F.desc("final_score"), "doc_id").limit(q.limit)

    def search_keyword(self, text: str, limit: int = LIMIT) -> DataFrame:
        return self.search(SearchQuery(text, Mode.KEYWORD, limit))

    def search_fuzzy(self, text: str, threshold: float = 0.3, limit: int = LIMIT) -> DataFrame:
        return self.search(SearchQuery(text, Mode.FUZZY, limit, fuzzy_threshold=threshold))

    def search_semantic(self, text: str, threshold: float = 0.5, limit: int = LIMIT) -> DataFrame:
        return self.search(SearchQuery(text, Mode.SEMANTIC, limit, semantic_threshold=threshold))

    def analyze(self, text: str) -> Mode:
        return detect_mode(parse(text), self.keywords is not None, self.grams is not None, self.vectors is not None)

    def with_limit(self, text: str, limit: int) -> DataFrame:
        return self.search(replace(parse(text), limit=limit))

    def statistics(self) -> dict:
        """Availability and sizes of the indexes."""
        out = {"keyword": self.keywords is not None, "fuzzy": self.grams is not None, "semantic": self.vectors is not None}
        if self.keywords is not None:
            out["documents"] = self.keywords.stats.first()["n"]
            out["terms"] = self.keywords.terms().count()
        if self.grams is not None:
            grams = self.grams.table() if isinstance(self.grams, trigram.Texts) else self.grams
            out["trigrams"] = grams.select("gram").distinct().count()
        if self.vectors is not None:
            out["vectors"] = self.vectors.count()
        return out
