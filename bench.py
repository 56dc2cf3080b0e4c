"""Times the headline queries: one JSON line, seconds per query (median of the runs after a warm-up), index building apart from searching."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from sextant import queries as Q
from sextant.operators import keyword, trigram, vector
from sextant.operators.keyword import KeywordIndex
from sextant.plans.router import SearchRouter

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def seconds(run, runs: int = RUNS) -> float:
    """Median over the runs; the first, which compiles code, does not count."""
    run()
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        out.append(time.perf_counter() - began)
    return round(statistics.median(out), 3)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs, vectors = Q._docs(spark, SF_DIR), Q._table(spark, SF_DIR, "embeddings")
    snippets = Q.snippets(spark, SF_DIR)
    took: dict[str, float] = {}
    with tempfile.TemporaryDirectory() as folder:
        took["build_keyword_index"] = seconds(lambda: KeywordIndex.build(docs).write(f"{folder}/keyword"), 1)
        took["build_trigram_index"] = seconds(lambda: trigram.build(docs).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/grams"), 1)
        took["build_vectors"] = seconds(lambda: vector.embed_tokens(docs).write.mode("overwrite").parquet(f"{folder}/vectors"), 1)
        index, grams = KeywordIndex.read(spark, f"{folder}/keyword"), spark.read.parquet(f"{folder}/grams")
        router = SearchRouter(index, grams, spark.read.parquet(f"{folder}/vectors"), vector.hashing_embedder())
        runs = {
            "bm25_or": lambda: keyword.search_or(index, ["the", "ion"]).collect(),
            "bm25_and": lambda: keyword.search_and(index, ["the", "and"]).collect(),
            "phrase": lambda: keyword.search_phrase(index, "on the").collect(),
            "boolean": lambda: keyword.search_boolean(index, "+the ion -und").collect(),
            "substring": lambda: trigram.search_substring(grams, "thing of").collect(),
            "fuzzy": lambda: trigram.search_fuzzy(grams, "thingof and").collect(),
            "knn_cosine": lambda: vector.knn_of(vectors, 0).collect(),
            "hybrid": lambda: router.search("the thing").collect(),
            "semantic": lambda: router.search("how is the thing that was").collect(),
            "store_search": lambda: Q.catalog.search(snippets, "the").collect(),
            "tag_counts": lambda: Q.catalog.tag_counts(snippets).collect(),
            "detect_language": lambda: Q.QUERIES["detect_language"](spark, SF_DIR).write.format("noop").mode("overwrite").save(),
            "classify_input": lambda: Q.QUERIES["classify_input"](spark, SF_DIR).write.format("noop").mode("overwrite").save(),
        }
        for name, run in runs.items():
            took[name] = seconds(run)
    spark.stop()
    print(json.dumps({"metric": "sum of query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
