import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import classify as C
from sextant.functions import text as T
from sextant.functions import vectors as V
from sextant.functions.language import BY_EXTENSION, detect_language, file_extension
from sextant.operators.keyword import sub_tokens


def value(spark, column, **given_):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in given_.items())
    return spark.createDataFrame([tuple(given_.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("getUserName HTTPServer parseXMLFile snake_case_Name", "get user name http server parse xml file snake case name"),
        ("a b c", ""),
        ("x" * 65, ""),
        ("x" * 64, "x" * 64),
        ("Öffnung straße", "ffnung stra"),
        ("", ""),
    ],
)
def test_tokenize(spark, text, expected):
    got = value(spark, T.tokenize(F.col("t")), t=text)
    assert got == expected.split()
    assert sub_tokens(text) == got


@pytest.mark.parametrize("code, expected", [("foo//c\nbaz", "foobaz"), ('foo"x"bar', "foobar"), ("a1 = 'it\\'s' + b2 # note\nfor c3", "a1 b2 for c3"), ("see http://host/path now", "see http"), ("call(arg_one, argTwo);", "call arg one arg two"), ("don't stop", "don")])
def test_tokenize_code(spark, code, expected):
    assert value(spark, T.tokenize_code(F.col("t")), t=code) == expected.split()


def test_positions_count_words(spark):
    got = value(spark, T.tokenize_with_positions(F.col("t")), t="\tgetUser  - nameOf\nx end")
    assert [(r["term"], r["pos"]) for r in got] == [("get", 0), ("user", 0), ("name", 2), ("of", 2), ("end", 4)]


def test_splitters(spark):
    assert value(spark, T.camel_split(F.col("t")), t="parseXMLFile") == ["parse", "XML", "File"]
    assert value(spark, T.snake_split(F.col("t")), t="_a__b_") == ["a", "b"]
    assert value(spark, T.punctuation_split(F.col("t")), t="a-b_c, d") == ["a", "b_c", "d"]


def test_trigrams(spark):
    decode = lambda xs: {bytes.fromhex(x) for x in xs}
    assert decode(value(spark, T.trigrams(F.col("t")), t="aBc")) == {b"$$a", b"$ab", b"abc", b"bc$", b"c$$"}
    assert value(spark, T.trigrams(F.col("t"), False), t="ab") == []
    assert decode(value(spark, T.trigrams(F.col("t")), t="")) == {b"$$$"}


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abAB é$ß\n", max_size=12))
def test_trigrams_like_bytes(spark, text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    expected = {data[i : i + 3] for i in range(len(data) - 2)}
    assert {bytes.fromhex(x) for x in value(spark, T.trigrams(F.col("t"), False), t=text)} == expected


def test_jaccard(spark):
    row = spark.sql("SELECT array() AS e, array('a') AS a, array('a', 'b') AS b")
    got = row.select(T.jaccard(F.col("e"), F.col("e")), T.jaccard(F.col("e"), F.col("a")), T.jaccard(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (1.0, 0.0, 0.5)


def test_checksum_and_formats(spark):
    assert value(spark, T.checksum(F.col("t")), t="123456789") == 0xCBF43926 == zlib.crc32(b"123456789")
    assert [value(spark, T.truncate(F.col("t"), n), t="abcdef") for n in (2, 3, 5, 6)] == ["ab", "abc", "ab...", "abcdef"]
    assert [value(spark, T.parse_id(F.col("t")), t=t) for t in ("17", "0", "-1", "1x", "", "9" * 19)] == [17, None, None, None, None, None]
    assert [value(spark, T.format_size(F.col("t")), t=float(n)) for n in (0, 1023, 1024, 5 << 20, 3 << 40, 5 << 50)] == ["0.0 B", "1023.0 B", "1.0 KB", "5.0 MB", "3.0 TB", "5120.0 TB"]
    assert [value(spark, T.extract_family(F.col("t")), t=t) for t in ("codellama:7b", "qwen-2.5:7b", "x-latest", "deepseek-coder:6.7b")] == ["codellama", "qwen", "x", "deepseek-coder"]
    assert [value(spark, T.is_code_model(F.col("t")), t=t) for t in ("CodeLlama", "granite-code", "llama3")] == [True, True, False]


@pytest.mark.parametrize(
    "content, name, expected",
    [
        ("#!/bin/bash\necho", "", "bash"),
        ("#!/usr/bin/env python3\n", "x.sh", "python"),
        ("#!/usr/bin/python3.11 -u\n", "", "python3.11"),
        ("#!bash\n", "a.py", "python"),
        ("#!/usr/bin/env -S node\n", "", "-S"),
        ("", "script.JS", "javascript"),
        ("", "Dockerfile.dev", "dockerfile"),
        ("", "Makefile", "makefile"),
        ("", ".bashrc", "bash"),
        ("", ".gitignore", "gitconfig"),
        ("", "trailing.", "text"),
        ("plain", "unknown", "text"),
        ("plain", "a.unknown", "text"),
    ],
)
def test_detect_language(spark, content, name, expected):
    assert value(spark, detect_language(F.col("c"), F.col("n")), c=content, n=name) == expected


def test_all_extensions(spark):
    rows = spark.createDataFrame([(f"f.{e}", lang) for e, lang in BY_EXTENSION.items()], "n string, l string")
    assert rows.where(detect_language(F.lit(""), F.col("n")) != F.col("l")).isEmpty()
    assert value(spark, file_extension(F.col("t")), t="rust") == ".rs" and value(spark, file_extension(F.col("t")), t="?") == ".txt"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("  \n", "EMPTY"),
        ("ab", "AMBIGUOUS"),
        ("#!/bin/sh", "CODE"),
        ("def f(x):\n    return x + 1\n\nclass A: pass", "CODE"),
        ("write a function that sorts a list", "NATURAL_LANG"),
        ("How do I sort this list with less memory?", "NATURAL_LANG"),
        ("hello", "AMBIGUOUS"),
    ],
)
def test_classify(spark, text, expected):
    assert value(spark, C.classify(F.col("t")), t=text) == expected


def test_single_precision_border(spark):
    # 0.5 for the start, 0.1 for one word, 0.1 for the ratio: above 0.7 in single precision.
    text = "write of (x) and [y] -> {z} the #ab ok"
    code, prose = value(spark, C.code_points(F.col("t")), t=text), value(spark, C.prose_points(F.col("t")), t=text)
    assert prose in (60, 70) and code >= 40


def test_vectors(spark):
    a, b, z = [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]
    f = lambda c, x, y: value(spark, c(F.col("a"), F.col("b")), a=x, b=y)
    assert f(V.cosine_similarity, a, b) == pytest.approx(2**-0.5)
    assert f(V.cosine_similarity, a, z) == 0.0 and f(V.cosine_similarity, a, [1.0]) == 0.0
    assert f(V.euclidean_distance, a, b) == 1.0 and f(V.euclidean_distance, a, [1.0]) == V.FLT_MAX
    assert value(spark, V.normalize(F.col("a")), a=b) == pytest.approx([2**-0.5] * 2)
    assert value(spark, V.normalize(F.col("a")), a=z) == z
    with pytest.raises(ValueError):
        V.distance("hamming", F.col("a"), F.col("b"))


def test_stop_words_are_sixty_odd():
    assert len(T.CODE_STOP_WORDS) == len(set(T.CODE_STOP_WORDS)) and all(re.fullmatch("[a-z]+", w) for w in T.CODE_STOP_WORDS)


def test_checksums_of_parts_and_sizes(spark):
    import zlib

    from sextant.functions import text as T

    c = T.Crc32()
    for part in ("ab", b"c", "é"):
        c.update(part)
    assert c.value == zlib.crc32("abcé".encode())
    row = spark.createDataFrame([(["ab", "c", "é"],)], "p array<string>").select(T.checksum_of_parts(F.col("p"))).first()
    assert row[0] == c.value
    sizes = [0, 1, 1023, 1024, 1280, 1331, 1435, 1536, 1792, 1 << 20, 1048576 + 52429, (1 << 30) - 1, 1 << 30, 5 << 40, (1 << 50) + 7]
    want = [f"{n / 1024**k:.1f} {u}" for n in sizes for k, u in [next((k, u) for k, u in enumerate(("B", "KB", "MB", "GB", "TB")) if n < 1024 ** (k + 1) or k == 4)]]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(T.format_size(F.col("n"))).collect()]
    assert got == want


def test_folding(spark):
    from sextant.functions.text import fold

    texts = ["ABC xyz", "ÉABC é", "İΣ aB", "Ⅷ B", "ǅ C", "", "ß Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t"))).collect()]
    assert got == ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]
