import math

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import keyword, trigram, vector
from sextant.operators.indexes import IndexStore
from sextant.operators.keyword import KeywordIndex, parse_boolean
from sextant.plans import completion, router
from sextant.plans.router import Mode, SearchQuery
from sextant.streaming.upkeep import debounced, maintain_index


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the quick brown fox", "the lazy dog the end", "quick dog", "getUserName", "", "é ç"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def index(docs):
    return KeywordIndex.build(docs)


def found(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_bm25(index):
    # Four documents have tokens: 4, 5, 2 and 3 of them.
    n, avgdl = 4, 14 / 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    score = lambda tf, dl, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert found(keyword.search_term(index, "the")) == {0: round(score(1, 4, 2), 6), 1: round(score(2, 5, 2), 6)}
    assert found(keyword.search_or(index, ["dog", "dog"])) == {1: round(2 * score(1, 5, 2), 6), 2: round(2 * score(1, 2, 2), 6)}
    assert set(found(keyword.search_and(index, ["quick", "dog", "?"]))) == {2}
    assert found(keyword.search_and(index, ["quick", "zebra"])) == {} and found(keyword.search_or(index, [])) == {}


def test_phrases(docs, index):
    assert set(found(keyword.search_phrase(index, "quick brown"))) == {0}
    assert set(found(keyword.search_phrase(index, "the end"))) == {1}
    assert found(keyword.search_phrase(index, "the the")) == {}
    assert found(keyword.search_phrase(index, "get user")) == {}
    assert set(found(keyword.search_phrase(KeywordIndex.build(docs, code=True), "get user"))) == {3}


def test_boolean(index):
    assert found(keyword.search_boolean(index, "-the")) == {}
    assert found(keyword.search_boolean(index, "+the dog")) == found(keyword.search_term(index, "the"))
    assert set(found(keyword.search_boolean(index, "dog OR fox -lazy"))) == {0, 2}
    assert set(found(keyword.search_boolean(index, 'the "lazy dog"'))) == {1}
    q = parse_boolean('+a -b "c d" e AND + "open end')
    assert (q.required, q.excluded, q.phrases, q.optional) == (("a",), ("b",), ("c d", "open end"), ("e", "+"))


def test_round_trip(spark, index, tmp_path):
    index.write(str(tmp_path))
    assert found(keyword.search_or(KeywordIndex.read(spark, str(tmp_path)), ["the", "dog"])) == found(keyword.search_or(index, ["the", "dog"]))
    assert [r["term"] for r in index.with_prefix("").collect()] == [] and {r["term"] for r in index.with_prefix("qu").collect()} == {"quick"}


def test_trigram_search(docs):
    grams = trigram.build(docs)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(trigram.search_substring(grams, "QUICK")) == [0, 2] and ids(trigram.search_substring(grams, "qu")) == []
    assert set(ids(trigram.search_substring(grams, "uick d", docs))) == {2}
    loose, strict = trigram.search_fuzzy(grams, "quikc", 0.1), trigram.search_fuzzy(grams, "quikc", 0.9)
    assert set(ids(strict)) <= set(ids(loose)) and {0, 2} <= set(ids(loose))
    assert docs.where(trigram.may_contain(F.col("text"), "ab")).count() == 6


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vector.knn(v, [1.0, 0.0], 2).collect()] == [0, 1]
    assert [r["vec_id"] for r in vector.within_distance(vector.knn_of(v, 2, 3), 0.5).collect()] == [2]
    with pytest.raises(Exception, match="dimensions"):
        vector.knn(v, [1.0]).collect()
    new = spark.createDataFrame([(0, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert vector.upsert(v, new).count() == 3 and vector.remove(v, new).count() == 2
    assert vector.knn_many(v, v.selectExpr("vec_id AS query_id", "embedding AS query"), 1).where("query_id = vec_id").count() == 3


@pytest.mark.parametrize("text, mode", [("a_b", Mode.HYBRID), ("docker", Mode.KEYWORD), ('"x y"', Mode.KEYWORD), ("~dokcer", Mode.FUZZY), ("how so", Mode.SEMANTIC), ("one two three", Mode.SEMANTIC), ("show", Mode.KEYWORD)])
def test_modes(text, mode):
    assert router.detect_mode(router.parse(text)) is mode


def test_mode_without_indexes():
    assert router.detect_mode(router.parse("a_b"), has_vectors=False) is Mode.KEYWORD
    assert router.detect_mode(router.parse("a_b"), False, True, False) is Mode.FUZZY
    q = router.parse('+must -not ~near "a phrase" rest')
    assert (q.text, q.required, q.excluded, q.allow_fuzzy, q.require_exact) == ("near a phrase rest", ("must",), ("not",), True, True)
    assert router.parse("+only").text == "+only"


def test_router(docs, index):
    r = router.SearchRouter(index, trigram.build(docs))
    hits = r.search("quick").collect()
    assert {h["doc_id"] for h in hits} == {0, 2} and max(h["final_score"] for h in hits) == 0.4
    assert all(h["fuzzy_score"] == 1.0 and h["final_score"] == 0.2 for h in r.search(SearchQuery("quick", Mode.SUBSTRING)).collect())
    assert r.search(SearchQuery("", Mode.KEYWORD)).collect() == []
    both = r.search(SearchQuery("quick dog", Mode.HYBRID)).collect()
    assert all(0 <= h["final_score"] <= 1 for h in both) and both[0]["doc_id"] == 2
    assert r.statistics()["documents"] == 4


class Fake:
    def __init__(self, name, is_local, up=True, fails=0):
        self.name, self.is_local, self.up, self.fails, self.asked = name, is_local, up, fails, 0

    def is_available(self):
        return self.up

    def complete(self, request):
        self.asked += 1
        if self.asked <= self.fails:
            raise OSError("down")
        return f"{self.name}: {request.messages[-1][1]}"


def test_completion_routing():
    here, there = Fake("here", True), Fake("there", False)
    pick = lambda s, *m: completion.CompletionRouter([here], [there], s).select(completion.Request(m or (("user", "x"),), max_tokens=10)).name
    assert [pick(s) for s in completion.STRATEGIES] == ["here", "there", "here", "there", "here", "here"]
    assert pick("quality_optimized", *(("user", "x"),) * 3) == "there"
    assert pick("quality_optimized", ("user", "x" * 8000)) == "there"
    now = [0.0]
    flaky = Fake("flaky", True, fails=1)
    r = completion.CompletionRouter([flaky], [there], retry_seconds=0, clock=lambda: now[0], cache_size=1)
    ask = completion.Request((("user", "q"),))
    assert r.complete(ask) == "there: q" and r.complete(ask) == "there: q"
    assert (r.stats["cache_hits"], r.stats["failures"]) == (1, 1)
    now[0] = 400.0
    r.complete(ask)
    assert r.stats["cache_hits"] == 1
    with pytest.raises(Exception, match="no provider"):
        completion.CompletionRouter().complete(ask)


def test_completion_tables(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert completion.prompt_template(turns).first()["prompt"] == "<|user|>\na\n<|assistant|>\nb\n<|assistant|>\n"
    done = completion.complete_table(spark.createDataFrame([("x",), ("x",), (None,)], "prompt string"), lambda ps: [p.upper() for p in ps])
    assert sorted(map(str, (r["completion"] for r in done.collect()))) == ["None", "X", "X"]


def test_streams(spark, tmp_path):
    events = spark.sql("SELECT 1 AS user_id, timestamp_seconds(x) AS ts FROM VALUES (0), (1), (10) AS t(x)")
    assert sorted(r["n"] for r in debounced(events, "3 seconds").collect()) == [1, 2]
    source, store = str(tmp_path / "in"), IndexStore(spark, str(tmp_path / "index"))
    for k, text in enumerate(("old words", "new words")):
        spark.createDataFrame([(7, text), (8 + k, "other")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        query = maintain_index(stream, store, str(tmp_path / "log"))
        query.processAllAvailable()
        query.stop()
    assert store.segments() == [2, 4]
    assert {(r["term"], r["doc_id"]) for r in store.keywords().postings.collect()} == {("new", 7), ("words", 7), ("other", 8), ("other", 9)}


def test_sources(spark, tmp_path):
    from sextant.sources.files import completion_text, model_list, read_files

    (tmp_path / "a.py").write_text("print(1)\n")
    assert [tuple(r) for r in read_files(spark, str(tmp_path / "a.py")).collect()] == [("a.py", "print(1)\n")]
    replies = spark.createDataFrame([('{"models": [{"name": "llama3:8b", "size": 2048}, {"name": "codellama:7b", "size": 1}]}',)], "value string")
    assert [r["name"] for r in model_list(replies).collect()] == ["codellama:7b", "llama3:8b"]
    chunks = spark.createDataFrame([('{"response": "a"}',), ('{"message": {"content": "b"}, "done": true}',)], "value string")
    assert {tuple(r) for r in completion_text(chunks).collect()} == {("a", False), ("b", True)}


def test_changes_of_a_stored_index(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = IndexStore(spark, str(tmp_path / "ix"), lambda docs: vector.embed_tokens(docs, 8))
    assert store.count() == 0 and store.keywords().postings.count() == 0 and not store.contains(1)
    store.index(make([(1, "quick fox"), (2, "lazy dog"), (3, "")]))
    store.update(make([(1, "slow fox")]))
    store.remove(make([(2, ""), (77, "")]))
    told = []
    store.index_batch([make([(4, "new dog")]), make([(5, "old dog"), (2, "back again")])], lambda k, n: told.append((k, n)))
    texts = {1: "slow fox", 2: "back again", 3: "", 4: "new dog", 5: "old dog"}

    def check():
        fresh = KeywordIndex.build(make(list(texts.items())))
        key = lambda r: (r["term"], r["doc_id"], r["dl"], r["tf"], tuple(r["positions"]))
        index = store.keywords()
        assert sorted(map(key, index.postings.collect())) == sorted(map(key, fresh.postings.collect()))
        assert index.stats.collect() == fresh.stats.collect()
        assert sorted(store.grams().collect()) == sorted(trigram.build(make(list(texts.items()))).collect())
        assert {r["vec_id"] for r in store.vectors().collect()} == {1, 2, 4, 5} and {r["doc_id"] for r in store.documents().collect()} == set(texts)
        assert {h["doc_id"] for h in store.router().search("dog").collect()} == {4, 5} and store.contains(2) and not store.contains(77)

    check()
    assert told == [(1, 2), (2, 2)] and store.segments() == [1, 2, 3, 4, 5]
    store.compact()
    check()
    assert store.segments() == [6]
    store.index(make([(5, "old dog")]), 7)
    store.index(make([(5, "old dog")]), 7)  # a change that is run again
    check()
    store.clear()
    assert store.segments() == []


def test_vector_files(spark, tmp_path):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    vector.save(v, str(tmp_path / "v"))
    assert sorted(vector.load(spark, str(tmp_path / "v"), 2).collect()) == sorted(v.collect())
    with pytest.raises(Exception, match="not 3"):
        vector.load(spark, str(tmp_path / "v"), 3)
    with pytest.raises(Exception, match="none"):
        vector.load(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="dimensions"):
        vector.save(v.union(spark.createDataFrame([(2, [1.0])], v.schema)), str(tmp_path / "w"))
    assert [vector.contains(v, k).first()["found"] for k in (1, 5)] == [True, False]


def test_embedding_of_tables_and_of_expressions(spark):
    docs = spark.createDataFrame([(1, "the quick the fox getUserName"), (2, "dog"), (3, "!"), (4, None)], "doc_id long, text string")
    one = {r["vec_id"]: r["embedding"] for r in vector.embed_tokens(docs, 16).collect()}
    embed = vector.hashing_embedder(16)
    assert one == {r["doc_id"]: r["e"] for r in docs.where("doc_id < 3").select("doc_id", embed(F.col("text")).alias("e")).collect()}
    by_model = vector.embed_with(docs.where("doc_id < 3"), lambda texts: [[float(len(t))] for t in texts])
    assert {(r["vec_id"], r["embedding"][0]) for r in by_model.collect()} == {(1, 29.0), (2, 3.0)}


def test_semantic_and_hybrid_search(docs, index):
    r = router.SearchRouter(index, trigram.build(docs), vector.embed_tokens(docs), vector.hashing_embedder())
    assert r.analyze("how quick is it") is Mode.SEMANTIC and r.analyze("quick dog") is Mode.HYBRID
    best = r.search("how the quick brown fox").first()
    assert best["doc_id"] == 0 and best["semantic_score"] == 1.0 and best["keyword_score"] == 0.0
    both = r.search("quick dog").collect()
    assert both[0]["doc_id"] == 2 and both[0]["final_score"] == 1.0 and list(both[0]["positions"]) == [0, 1] and both[0]["matched_text"] == ""
    named = router.with_rows(r.search_keyword("lazy"), docs.withColumn("name", F.lit("n")), "doc_id").first()
    assert (named["doc_id"], named["name"]) == (1, "n")


def test_mode_columns_follow_the_rules(spark):
    texts = ["docker", "a_b", "how so", "one two three", "x y", "", "a" * 30, "why", "a b c"]
    have = [(True, True, True), (True, False, False), (False, True, False), (False, False, True), (True, True, False)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for h in have:
        got = [r[0] for r in rows.select(router.mode_column(F.col("t"), *h)).collect()]
        assert got == [router.detect_mode(SearchQuery(t), *h).name for t in texts]


def test_a_search_asks_texts_and_not_all_postings(spark, docs, index):
    """A term's filter stands before what is gathered by document: no window and no sort over all tokens."""
    plan = keyword.search_or(index, ["the", "dog"]).select("doc_id", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    assert sorted(r["doc_id"] for r in index.lengths().collect()) == [0, 1, 2, 3]
    twice = docs.union(spark.createDataFrame([(2, "Quick the")], docs.schema))  # two rows of one document are one document
    rows = {r["term"]: (r["dl"], r["tf"], list(r["positions"])) for r in KeywordIndex.build(twice).postings.where("doc_id = 2").collect()}
    assert rows == {"quick": (4, 2, [0, 0]), "dog": (4, 1, [1]), "the": (4, 1, [1])}
    assert {r["doc_id"]: (r["tf"], list(r["positions"])) for r in KeywordIndex.build(twice).hits(["quick"]).collect()} == {0: (1, [1]), 2: (2, [0, 0])}
    queries = spark.createDataFrame([(7, "quick dog"), (8, "none")], "query_id long, text string")
    plan = keyword.search_many(index, queries, 2)
    best = {(r["query_id"], r["doc_id"]): r["score"] for r in plan.collect()}
    assert best == {(7, k): v for k, v in found(keyword.search_or(index, ["quick", "dog"], 2)).items()}
    assert "hashpartitioning(query_id" in (shown := plan._jdf.queryExecution().executedPlan().toString()) and "doc_id#" not in "".join(x for x in shown.splitlines() if "hashpartitioning(query_id" in x).split("hashpartitioning(query_id")[1].split(")")[0]


def test_tokens_at_all_borders(spark):
    """The fast classes of characters cut where the borders of the reference do."""
    import re

    border = r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[A-Z][a-z])"
    texts = ["getUserName HTTPServer parseXMLFile snake_case_Name", "A1Bc AAb aB9Cd 9Ab xY\tZz", "\u00e9tat\u00c9Ab \u212aelvin \u0130x \U0001f600ab", " \x01ab\x01cd  -- ef-gh\u00a0ij\n\x0b", "", "-", "x" * 65 + " " + "y" * 64]
    kept = lambda s: [t.lower() for t in re.split(border, s) if 2 <= len(t) <= 64]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t")).alias("a"), T.tokenize_with_positions(F.col("t")).alias("b")).collect()
    for t, a, b in rows:
        assert a == kept(t)
        assert [tuple(x) for x in b] == [(x, i) for i, w in enumerate(re.findall("[^ \t\n\x0b\f\r]+", t)) for x in kept(w)]
    assert "A-Z" not in T.OTHER  # ranges are what was slow


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_many_nearest_in_parts_and_blocks(spark, monkeypatch, metric):
    """Every pair is compared, whatever the sizes of parts and blocks, as one query at a time does it; without a sort of all pairs."""
    import random

    rnd = random.Random(3)
    rows = [(k, [round(rnd.uniform(-1, 1), 1) for _ in range(3)]) for k in range(60)] + [(k, [0.5, 0.5, 0.0]) for k in range(60, 70)] + [(70, [0.0] * 3), (71, [1.0]), (72, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    monkeypatch.setattr(vector, "BLOCK", 4), monkeypatch.setattr(vector, "PART", 16)
    asked = [0, 5, 61, 70, 71]
    near = vector.knn_many(v, v.where(F.col("vec_id").isin(asked)).selectExpr("vec_id AS query_id", "embedding AS query"), 6, metric)
    got = sorted((r["query_id"], r["vec_id"], r["distance"]) for r in near.where("distance IS NOT NULL").collect())
    one = v.alias("v").crossJoin(v.where(F.col("vec_id").isin(asked)).selectExpr("vec_id AS query_id", "embedding AS query"))
    every = one.select("query_id", "vec_id", F.round(vector.distance(metric, F.col("embedding"), F.col("query")), 6).alias("distance")).collect()
    want = []
    for q in asked:
        own = sorted((r for r in every if r["query_id"] == q), key=lambda r: (r["distance"] is not None, r["distance"] or 0.0, r["vec_id"]))
        want += [(q, r["vec_id"], r["distance"]) for r in own[:6] if r["distance"] is not None]
    assert got == sorted(want)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(queries" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_a_store_keeps_the_tables_it_is_made_for(spark, docs, tmp_path):
    """No table that nobody asked for, no range partitioning, which would make all rows twice, and removals without a keyword table."""
    store = IndexStore(spark, str(tmp_path / "v"), lambda d: vector.embed_tokens(d, 8), keywords=False, trigrams=False)
    store.index(docs)
    store.remove(docs.where("doc_id = 1").select("doc_id"))
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["docs", "vectors"]
    assert {r["vec_id"] for r in store.vectors().collect()} == {0, 2, 3}
    assert {(r["doc_id"], r["dl"]) for r in store.documents().collect()} == {(0, 4), (2, 2), (3, 3), (4, None), (5, None)}
    store.compact()
    assert {r["doc_id"] for r in store.documents().collect()} == {0, 2, 3, 4, 5}
    many = docs.sparkSession.range(300).selectExpr("id AS doc_id", "concat('the word', id) AS text")
    whole = IndexStore(spark, str(tmp_path / "k"))
    whole.index(many)
    for part in (tmp_path / "k" / "postings" / "seg=1").glob("*.parquet"):  # each file has its own documents, sorted by term
        terms = [r["term"] for r in spark.read.parquet(str(part)).collect()]
        assert terms == sorted(terms) and "the" in terms


def test_grams_sought_in_texts(docs):
    """Without an index the grams asked for are sought in the texts, with the same result and no row for any other gram."""
    texts, grams = trigram.Texts(docs), trigram.build(docs)
    for query in ("quikc", "the", "\u00e9 \u00e7", "x", ""):
        assert sorted(trigram.search_fuzzy(texts, query, 0.1).collect()) == sorted(trigram.search_fuzzy(grams, query, 0.1).collect())
    for pattern in ("QUICK", "qu", "uick d"):
        assert sorted(trigram.search_substring(texts, pattern).collect()) == sorted(trigram.search_substring(grams, pattern).collect())
    assert "Generate" not in trigram.search_fuzzy(texts, "quikc")._jdf.queryExecution().optimizedPlan().toString()
