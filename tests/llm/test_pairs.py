"""SimHash, decontamination and line dedup against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from sextant.llm import decontaminate as D
from sextant.llm import linededup as L
from sextant.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
    return " ".join(words)


def brute_fingerprint(text, k=3):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    base = [sentence(rng, rng.choice((1, 2, 40, 300))) for _ in range(40)]
    texts = base + [edited(rng, rng.choice(base), rng.choice((0, 1, 2))) for _ in range(80)] + ["", " \n", None, "Äb ÄB", "äb äb"]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_classes(table(spark, texts)).collect()}
    prints = spark.createDataFrame([(rng.getrandbits(63) >> 40 << 40 | rng.getrandbits(3) << rng.choice((0, 20, 37)),) for _ in range(400)], "fp long").distinct()
    for rows in (prints, S.fingerprints(table(spark, texts)).select("fp").distinct()):
        assert sorted(S.links(rows).collect()) == sorted(S.links(rows, crossed=True).collect())
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    expected = brute_components(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: c for i, (_, c) in got.items()} == expected


def test_links_find_every_pair(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints)[:40]:
        for bits in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.add(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3}


def test_covering_code():
    flips = defaultdict(list)
    for s, flip, home in S._flips():
        flips[s].append((flip, home))
    assert all(sum(h for _, h in fs) == 1 and all(f.bit_count() <= (1 if h else 2) for f, h in fs) for fs in flips.values())
    assert len(flips) == 32 and all(len(fs) == 16 for s, fs in flips.items() if s)


def test_near_dedup_keeps_one_of_each_group(spark):
    a, b = "one two three four five six seven", "other words in this text are here now"
    docs = table(spark, [a, a, b, None, "", a], [5, 3, 7, 8, 9, None])
    assert sorted(r["doc_id"] for r in S.near_dedup(docs).collect()) == [3, 7, 8]
    repeated = table(spark, [a, a], [1, 1])
    assert S.near_dedup(repeated).count() == 1 and S.near_dedup(repeated).columns == docs.columns
    assert S.near_dedup(table(spark, [])).count() == 0
    assert S.near_dedup(docs.withColumns({"fp": F.lit(1), "label": F.lit("x")})).columns[-2:] == ["fp", "label"]


def brute_shingles(text, k=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_similar(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


@pytest.mark.parametrize("frequent", [0, 100])
def test_near_dedup_against_brute_force_jaccard(spark, monkeypatch, frequent):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "FREQUENT", frequent)
    rng = random.Random(5)
    common = sentence(rng, 30)
    base = [sentence(rng, rng.choice((1, 2, 4, 5, 9, 60, 200))) for _ in range(25)] + [f"{common} {sentence(rng, 90)}" for _ in range(15)]
    texts = base + [edited(rng, rng.choice(base), rng.choice((0, 1, 2, 4, 6))) for _ in range(110)] + [base[-1].upper(), "", None, " ", "a " * 80, "a " * 90]
    texts += [edited(rng, base[-1], 1) for _ in range(15)]
    sets = [brute_shingles(t) for t in texts]
    label = brute_components(range(len(texts)), lambda a, b: brute_similar(sets[a], sets[b]))
    assert {r["doc_id"] for r in S.near_dedup(table(spark, texts)).collect()} == {i for i, k in label.items() if i == k}
    far = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] != sets[b] and brute_similar(sets[a], sets[b]) and (brute_fingerprint(texts[a], 5) ^ brute_fingerprint(texts[b], 5)).bit_count() > 3]
    assert far  # pairs that three bits do not reach


def test_near_dedup_links_by_fingerprints(spark):
    """Repeats count in a fingerprint and not in a shingle set: equal fingerprints, Jaccard similarity under 0.8."""
    rng = random.Random(8)
    texts = ["one two three four five " * 300 + sentence(rng, 12) for _ in range(3)] + [sentence(rng, 60)]
    sets, prints = [brute_shingles(t) for t in texts], [brute_fingerprint(t, 5) for t in texts]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 and not brute_similar(sets[a], sets[b]) for a, b in combinations(range(3), 2))
    assert sorted(r["doc_id"] for r in S.near_dedup(table(spark, texts)).collect()) == [0, 3]


def test_component_rounds_write_few_files(spark, monkeypatch):
    from sextant.llm import common

    written, plain = [], common.materialize

    def counted(df, tag):
        out = plain(df, tag)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "materialize", counted)
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        labels = {r["node"]: r["label"] for r in common.components(edges, "a", "b").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert labels == dict.fromkeys(range(61), 0)
    assert max(written[1:]) <= 2 < written[0]


def lines_of(texts, ids):
    return [(i, k, frozenset(line.encode().split())) for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0)) for k, line in enumerate((t or "").split("\n"))]


def brute_lines(texts, ids):
    out, seen = defaultdict(list), []
    for i, k, s in lines_of(texts, ids):
        if s:
            if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                out[i].append(k)
            seen.append(s)
    return dict(out)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = [sentence(rng, rng.choice((3, 5, 6, 12, 40, 120)), 300) for _ in range(60)]
    family = [edited(rng, base[-1] + " a b c d e f g h", rng.choice((1, 2))) for _ in range(40)]
    pool = base + [edited(rng, rng.choice(base), 1) for _ in range(120)] + family + ["", "  ", "\ta  b\tc d  e f ", "f e d c b a"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.choice((1, 2, 5)))) for _ in range(150)] + ["", None, "\n\n", pool[0]]
    ids = list(range(len(texts) - 1)) + [None]
    got = {r["doc_id"]: r["removed"] for r in L.report(table(spark, texts, ids)).collect()}
    assert {i: r for i, r in got.items() if r} == brute_lines(texts, ids)


def test_line_dedup_of_short_lines(spark, tmp_path):
    import corpus_pipeline
    from sextant.llm.queries import op5_line_dedup

    rng = random.Random(6)
    pool = [sentence(rng, n, 7) for n in (1, 2, 3, 4, 4, 5, 5, 6, 8) for _ in range(7)] + ["", "  ", "\t", "}", " } ", "a a a a a a a", "a b c d", "e d c b a", "a b c", "a b c d a b c d"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.choice((1, 2, 4)))) for _ in range(60)] + ["a b c d", "e d c b a", None, ""]
    seen, expected = [], {}
    for i, k, s in lines_of(texts, range(len(texts))):
        if s:
            if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                expected.setdefault(i, []).append(k)
            seen.append(s)
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["removed"] for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r for i, r in got.items() if r} == expected
    twice = table(spark, ["All rights reserved.\none more line of five", "All rights reserved.\nother words in here now"])
    assert [r["text"] for r in corpus_pipeline.line_stage(spark, twice, "").orderBy("doc_id").collect()][1] == "other words in here now"


def test_line_dedup_of_a_large_family_and_frequent_words(spark, monkeypatch):
    rng = random.Random(16)
    base = sentence(rng, 60, 500)
    texts = [edited(rng, base, rng.choice((1, 3, 5))) for _ in range(250)]  # chains of near copies, some of them over the threshold
    texts += [" ".join(f"f{rng.randrange(9)}" for _ in range(rng.choice((6, 9, 14)))) for _ in range(150)]  # frequent words only
    texts += [" ".join(f"{k} {x}" for x in range(500)) for k in "ab"] + [" ".join(f"a {x}" for x in range(480))]
    got = lambda: {r["doc_id"]: r["removed"] for r in L.report(table(spark, texts)).collect() if r["removed"]}
    expected = brute_lines(texts, range(len(texts)))
    assert got() == expected
    monkeypatch.setattr(L, "FREQUENT", 4 * 3)  # words counted eight times or more are keys only as pairs
    assert got() == expected


def test_prefix_join_makes_few_rows_a_pair(spark):
    """Near copies have most of their keys in common, but need not meet at each of them."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(90)]
    texts = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(40) for k in [rng.randrange(90)]]
    docs = table(spark, texts).select("doc_id", "text")
    lines = L._table(L._lines(docs), L._rarity(docs, 18), 1, 18)
    pairs = L._pairs(lines, spark.createDataFrame([], "y long")).collect()
    assert {frozenset((r["x"], r["y"])) for r in pairs} == {frozenset((a["id"], b["id"])) for a in lines.collect() for b in lines.collect() if a["id"] != b["id"]}
    assert len(pairs) <= 4 * 40 * 39 / 2  # at each of up to 19 common keys before


def test_rarity_is_no_column_of_lines(spark):
    plans = []
    docs = table(spark, ["a b c d e", "a b c d f"]).select("doc_id", "text")
    real = L.materialize
    L.materialize = lambda df, tag: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if tag == "lines" else None) or real(df, tag)
    try:
        L._table(L._lines(docs), L._rarity(docs, 10), 1, 10)
    finally:
        L.materialize = real
    assert plans and " AS levels" not in plans[0]


def test_line_dedup_steps_are_cheap(spark, monkeypatch):
    line = "one line with quite a few words that two documents share"
    texts = [f"{line}\n \n\t\n\na  b", f" \n{line} now\n\t\na b", f"{line}\n\t a b \n\x0b"]
    docs, real, made = table(spark, texts), L.materialize, {}
    monkeypatch.setattr(L, "materialize", lambda df, tag: made.setdefault(tag, df) and real(df, tag))
    gone = L.removed_lines(docs)
    assert not made["lines"].schema["head"].dataType.containsNull  # else words are sorted as objects
    assert "SortAggregate" not in made["named"]._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in gone._jdf.queryExecution().optimizedPlan().toString()  # blank lines are told apart once, when lines are cut
    got = {}
    for r in gone.collect():
        got.setdefault(r["doc_id"], []).append(r["line_no"])
    assert {i: sorted(r) for i, r in got.items()} == brute_lines(texts, range(3)) == {1: [1, 3], 2: [0, 1]}


def test_line_dedup_documents(spark):
    line, other = "a line with five words", "and one more line of words"
    texts = [f"{line}\nx\n{other}", f"y\n{line}\n", line, "short line", None, ""]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in L.line_dedup(table(spark, texts)).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("y\n", 2), 3: ("short line", 10), 4: (None, 0), 5: ("", 0)}
    twice = table(spark, [line, line], [1, 1])
    assert L.line_dedup(twice.withColumn("removed", F.lit(1))).count() == 2
    assert L.report(table(spark, [])).count() == 0


def grams(text, size=5):
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if x]
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def brute_leaks(texts, items):
    out = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            size = min(5, max(1, len(grams(item, 1))))
            s, x = grams(t, size), grams(item, size)
            for at in range(max(1, len(s) - len(x) + 1)):
                w = s[at : at + len(x)]
                if x and w:
                    both = (Counter(w) & Counter(x)).total()
                    j = both / (len(w) + len(x) - both)
                    if j >= 0.8 and j > out.get((i, k), 0):
                        out[i, k] = j
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [sentence(rng, n) for n in (3, 8, 30, 45, 60)] + ["", "x x x x x x x x x x x x"]
    texts = [f"{sentence(rng, 30)} {items[k % 5]} {sentence(rng, 20)}" for k in range(10)]
    texts += [f"{sentence(rng, 9)}, {edited(rng, items[4], 1).upper()}! {sentence(rng, 9)}", edited(rng, items[3], 1), edited(rng, items[4], 20)]
    for k in range(24):  # words put in and taken out
        words = items[2 + k % 3].split()
        for _ in range(1 + k % 3):
            at = rng.randrange(len(words))
            words[at : at + k % 2] = [] if k % 2 else [f"i{rng.randrange(99)}"]
        texts.append(f"{sentence(rng, 25)} {' '.join(words)} {sentence(rng, 25)}")
    texts += [sentence(rng, 200) for _ in range(10)] + ["", None, items[2][: len(items[2]) // 2], items[6], "it is a secret: magic phrase, found", "magic secret phrase", "Secret"]
    items += ["Secret magic phrase", "hapax", "secret"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.matches(docs, bench).collect()}
    assert got == pytest.approx(brute_leaks(texts, items))
    kept = {r["doc_id"] for r in D.decontaminate(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in got}
    assert D.decontaminate(docs, bench.limit(0)).count() == len(texts) and D.matches(docs.limit(0), bench).count() == 0
