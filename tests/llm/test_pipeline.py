"""The corpus pipeline against the brute-force version of each stage."""

import random
from collections import defaultdict

import pytest
from test_pairs import brute_components, brute_fingerprint, brute_leaks, brute_lines, edited, sentence
from test_texts import BYTES, brute_quality

import corpus_pipeline
from sextant.llm import encoding, quality


def brute(documents, items):
    docs = {}
    for i, text in documents.items():
        n, repeats, covered, longest = brute_quality(text, quality.MIN_REPEAT)
        if n >= 50 and 100 * repeats <= 50 * n and 100 * covered <= quality.MAX_COVERED * n and (longest <= quality.MIN_LONGEST or 100 * longest <= quality.MAX_LONGEST * n):
            docs[i] = text
    gone = brute_lines(list(docs.values()), list(docs))
    for i, removed in gone.items():
        docs[i] = "\n".join(line for k, line in enumerate(docs[i].split("\n")) if k not in removed)
    docs = {i: t for i, t in docs.items() if t.split()}
    prints = {i: brute_fingerprint(t, 5) for i, t in docs.items()}
    label = brute_components(sorted(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = {i: t for i, t in docs.items() if label[i] == i}
    keys = list(docs)
    leaks = {keys[i] for i, _ in brute_leaks(list(docs.values()), items)}
    return {i: t for i, t in docs.items() if i not in leaks}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [sentence(rng, n) for n in (20, 40)]
    shared = sentence(rng, 60)
    texts = ["\n".join(sentence(rng, rng.choice((8, 30, 90))) for _ in range(3)) for _ in range(30)]
    texts += [texts[0], edited(rng, texts[1], 1), texts[2] + "\n" + shared, texts[3] + "\n" + shared, "spam " * 200, "short", "", None]
    texts += [f"{sentence(rng, 70)} {items[k % 2]} {sentence(rng, 30)}" for k in range(4)] + [texts[5].replace("\n", " ")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = brute(dict(enumerate(texts)), items)
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]] += r["length"]
    tok = encoding.encoder(BYTES).tok
    assert dict(pieces) == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected.items()}
    assert 20 < len(expected) < len(texts) - 8


def test_stage_names_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert pytest.importorskip("corpus_pipeline").ORACLE_SQL is None


@pytest.mark.parametrize("stage", ["simhash near-dedup", "packing"])
def test_stages_with_python_workers_release_the_heap(spark, stage, tmp_path):
    """Stages before them leave a full heap, beside which the workers found no room."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(0, "a b c d e f")], "doc_id long, text string")
    before = full()
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path)).count() == 1
    assert full() > before
