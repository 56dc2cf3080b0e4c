import pytest
from pyspark.sql import functions as F

from sextant.errors import ErrorCode, StoreError
from sextant.operators import catalog
from sextant.operators.catalog import SnippetStore


@pytest.fixture()
def store(spark, tmp_path):
    return SnippetStore.open(spark, str(tmp_path / "store"))


def fails(code, f, *args):
    with pytest.raises(StoreError) as e:
        f(*args)
    assert e.value.code is code


def test_life_of_a_snippet(spark, store, tmp_path):
    id_ = store.add("echo 'hello'", "hello-script", ["bash", "example"])
    assert (id_, store.count()) == (1, 1)
    row = store.get(id_)
    assert row["name"] == "hello-script" and row["tags"] == ["bash", "example"] and row["created_at"] == row["modified_at"]
    fails(ErrorCode.ALREADY_EXISTS, store.add, "x", "hello-script")
    fails(ErrorCode.INVALID_ARGUMENT, store.add, "x", "")
    fails(ErrorCode.INTERNAL_ERROR, store.add, "x", "twice", ["a", "a"])
    fails(ErrorCode.NOT_FOUND, store.remove, 999)
    fails(ErrorCode.NOT_FOUND, store.add_tag, 999, "t")
    store.add_tag(id_, "new")
    store.add_tag(id_, "new")
    store.remove_tag(id_, "bash")
    assert store.get(id_)["tags"] == ["example", "new"]
    other = store.add("#!/usr/bin/env python3\n", "tool", ["bash"])
    assert store.get(other)["language"] == "python"
    store.update(id_, "text", "renamed", ["old"], "go", "about")
    got = store.get(id_)
    assert (got["name"], got["language"], got["tags"], got["created_at"]) == ("renamed", "go", ["old"], row["created_at"])
    fails(ErrorCode.ALREADY_EXISTS, store.update, id_, "x", "tool", [], "", "")
    fails(ErrorCode.INVALID_ARGUMENT, store.update, id_, "x", "", [], "", "")
    fails(ErrorCode.NOT_FOUND, store.update, 999, "x", "n", [], "", "")
    assert not store.edit(id_, "text") and store.edit(id_, "more")
    store.remove(other)
    fails(ErrorCode.NOT_FOUND, store.get, other)
    store.close()
    fails(ErrorCode.STORE_NOT_OPEN, store.count)
    again = SnippetStore.open(spark, str(tmp_path / "store"))
    assert again.find_by_name("renamed") == id_ and again.add("z", "third") == 3


def rows(spark, *items):
    return spark.createDataFrame([(i, n, c, lang, "", tags) for i, n, c, lang, tags in items], "id long, name string, content string, language string, description string, tags array<string>")


@pytest.fixture()
def three(spark):
    return rows(spark, (1, "hello", "Hello World", "bash", ["bash", "utils"]), (2, "b", "say HELLO there utility", "python", ["python", "utils"]), (10, "c", "nothing", "bash", ["bash", "api"]))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_metadata(three):
    assert {r["tag"]: r["n"] for r in catalog.tag_counts(three).collect()} == {"bash": 2, "utils": 2, "python": 1, "api": 1}
    assert sorted(ids(catalog.by_tag(three, "bash"))) == [1, 10]
    assert sorted(ids(catalog.by_language(three, "bash"))) == [1, 10]
    assert ids(catalog.with_all_tags(three, ["bash", "api"])) == [10] and ids(catalog.with_all_tags(three, [])) == []
    assert sorted(ids(catalog.with_any_tag(three, ["python", "api"]))) == [2, 10]
    assert ids(catalog.in_key_order(three)) == [1, 10, 2]
    assert ids(catalog.resolve(three, "2")) == [2] and ids(catalog.resolve(three, "b")) == [2] and ids(catalog.resolve(three, "77")) == []


def test_search_scores(three):
    got = [(r["id"], r["score"], r["matched_text"]) for r in catalog.search(three, "HeLLo").collect()]
    assert got == [(1, 1.5, "hello"), (2, 0.5, "say HELLO there utility")]
    assert [(r["id"], r["score"]) for r in catalog.search(three, "util").collect()] == [(2, 0.8), (1, 0.3)]
    assert ids(catalog.search(three, "")) == [] and ids(catalog.search(three, "zzz")) == []
    assert len(ids(catalog.search(three, "h", 1))) == 1
    assert ids(catalog.search_filtered(three, "hello", language="python", limit=1)) == []  # the limit comes first


def test_bulk_changes(spark, three):
    stamped = three.selectExpr("*", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS modified_at", "0L AS checksum")
    new = spark.createDataFrame([("x", "hello", ["t"], "", ""), ("y", "n1.py", ["t"], "", ""), ("z", "n0.sh", ["t"], "", ""), ("w", "n1.py", ["t"], "", ""), ("v", "n2", ["t", "t"], "", ""), ("u", "", [], "", "")], "content string, name string, tags array<string>, language string, description string")
    table, rejected = catalog.bulk_add(stamped, new)
    got = {r["name"]: (r["id"], r["language"], r["content"]) for r in table.where("id > 10").collect()}
    assert got == {"n0.sh": (11, "bash", "z"), "n1.py": (12, "python", "w")}
    assert sorted((r["name"], r["reason"]) for r in rejected.collect()) == [("", "INVALID_ARGUMENT"), ("hello", "ALREADY_EXISTS"), ("n1.py", "ALREADY_EXISTS"), ("n2", "INTERNAL_ERROR")]
    assert sorted(ids(catalog.bulk_remove(stamped, spark.createDataFrame([(2,)], "id long")))) == [1, 10]
    retagged = {r["id"]: r["tags"] for r in catalog.retag(stamped, [1], ["+new", "-bash", "noise"]).collect()}
    assert retagged[1] == ["utils", "new"] and retagged[10] == ["bash", "api"]


def test_ordered_keys(spark):
    tree = spark.createDataFrame([(f"key{i}", f"value{i}") for i in range(100)], "k string, v string")
    assert catalog.is_unique(tree, "k") and catalog.is_in_order(tree.orderBy("k"), "k") and not catalog.is_in_order(tree.orderBy(F.desc("k")), "k")
    assert [r["k"] for r in catalog.key_range(tree, "k", "key10", "key12").collect()] == ["key10", "key11", "key12"]
    assert [r["k"] for r in catalog.key_scan(tree, "k", "key98", 5).collect()] == ["key98", "key99"]


def test_numbers_of_names_with_a_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(catalog, "SAMPLED", 50)
    names = [f"document-{k * 7919 % 2000:06d}" for k in range(2000)] + ["é", "a", "Z"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = {r["name"]: r["number"] for r in catalog.numbered(rows, "name").collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=str.encode), 1)}
    assert catalog.numbered(rows.limit(0), "name").count() == 0


def test_keyed_changes_and_visits(spark):
    tree = spark.createDataFrame([("b", "1"), ("a", "2")], "k string, v string")
    more = spark.createDataFrame([("b", "3"), ("c", "4")], "k string, v string")
    as_dict = lambda t: {r["k"]: r["v"] for r in t.collect()}
    assert as_dict(catalog.put(tree, more, "k")) == {"a": "2", "b": "3", "c": "4"} and as_dict(catalog.insert(tree, more, "k")) == {"a": "2", "b": "1", "c": "4"}
    assert as_dict(catalog.drop_keys(tree, more, "k")) == {"a": "2"}
    seen = []
    assert catalog.for_each(catalog.put(tree, more, "k"), "k", lambda r: seen.append(r["k"]) or len(seen) < 2) == 2 and seen == ["a", "b"]


def test_command_line(spark, tmp_path, capsys):
    import io

    from sextant import cli

    store = ["--store", str(tmp_path / "store")]
    (tmp_path / "x.py").write_text("print('hello')\n")
    out = io.StringIO()
    go = lambda *a, given="": cli.run(spark, [*store, *a], out, io.StringIO(given))
    assert go("add", str(tmp_path / "x.py"), "-t", "py") == 0 and go("add", "--stdin", "-n", "note", given="hello there") == 0
    assert go("add", "--stdin", given="no name") == 1 and go("add", "--stdin", "-n", "note", given="twice") == 1 and go("nonsense") == 1
    assert go("get", "99") == 2 and go("tag", "note", "bad") == 1 and go("add", str(tmp_path / "absent")) in (3, 4)
    assert go("tag", "note", "+a", "+b", "-a") == 0 and go("edit", "note", given="hello you") == 0
    out.truncate(0)
    assert go("get", "note", "--raw") == 0 and out.getvalue().endswith("hello you")
    assert go("search", "hello", "-t", "py") == 0 and "x.py" in out.getvalue() and go("list", "-l", "python") == 0
    assert go("rm", "note", given="n\n") == 0 and go("get", "note") == 0 and go("rm", "note", "-f") == 0 and go("get", "note") == 2
