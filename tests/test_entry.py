"""The contract's module, and the registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = ("bm25_or", "phrase_two", "bool_phrase_only", "fuzzy", "substring_candidates", "knn_cosine", "hybrid_fusion", "store_search", "tag_counts", "detect_language", "classify_input", "debounce_sessions")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(tidy(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() > 0


def test_the_rest_stands_without_the_text_folder(tmp_path):
    """A copy without the folder and the pipeline still imports and registers the search queries."""
    import shutil

    shutil.copytree(f"{ROOT}/sextant", tmp_path / "sextant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_or' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
