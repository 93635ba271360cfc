"""The Jaccard join against all pairs."""

import random

import pytest
from lodegraph.llm import jaccard
from lodegraph.llm.components import components
from pyspark.sql import functions as F

from .helpers import SF, documents, odd_texts


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts, n, percent):
    import re

    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def near_copies(seed, groups=12):
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(3000)]
    out = []
    for g in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 15, 30, 80, 200, 400]))]
        for _ in range(rnd.randint(1, 14)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                k = rnd.randrange(len(own))
                own[k : k + 1] = rnd.choice([[], [rnd.choice(vocab)], [own[k], rnd.choice(vocab)]])
                own = own or ["x"]
            out.append(" ".join(own))
            if g % 4 == 3:
                base = own  # chains: neighbours link, ends do not
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("n", "percent", "seed", "cells"), [(4, 85, 1, 24), (5, 80, 2, 24), (4, 85, 3, 2)])
def test_components_against_all_pairs(spark, monkeypatch, n, percent, seed, cells):
    monkeypatch.setattr(jaccard, "SLOT", 500)
    monkeypatch.setattr(jaccard, "CELLS", cells)
    texts = near_copies(seed) + odd_texts()
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.component_rows(documents(spark, texts), n, percent).collect()}
    want = brute(texts, n, percent)
    for k, w in enumerate(want):
        assert rows[k] == w, (k, texts[k][:60] if texts[k] else texts[k])


def test_every_linked_pair_shares_a_list():
    import numpy as np

    rnd = random.Random(9)
    for percent in (80, 85):
        plan = jaccard.Plan(percent)
        for _ in range(3000):
            size = rnd.choice([1, 2, 3, 5, 6, 7, 8, 10, 11, 13, 16, 17, 20, 24, 25, 40, 57, 58, 90, 200])
            a = {rnd.getrandbits(64) for _ in range(size)}
            b = set(a)
            while True:
                c = set(b)
                c = c - {rnd.choice(sorted(c))} if rnd.random() < 0.5 and len(c) > 1 else c | {rnd.getrandbits(64)}
                if 100 * len(a & c) < percent * len(a | c):
                    break
                b = c
            if a != b:
                x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
                (one, need), (two, _) = plan.keys(x), plan.keys(y)
                common = set(one.tolist()) & set(two.tolist())
                assert any(sum(k & 255 == b["block"] for k in common) > b["lists"] - b["enough"] for b in need), (percent, len(a), len(b))


def long_copies(size, percent):
    """Two texts of about size words, a near copy of each by one word and by many, and one beyond the limit."""
    rnd = random.Random(size + percent)
    out = []
    for _ in range(2):
        base = [f"w{rnd.randrange(50_000)}" for _ in range(size)]
        for changes in (0, 1, size // 100, size // 8):
            own = list(base)
            for k in rnd.sample(range(size), changes):
                own[k] = f"x{rnd.randrange(50_000)}"
            out.append(" ".join(own))
    return out


def test_near_copies_of_long_documents_go(spark):
    texts = [t for size in (10_000, 20_000, 70_000) for t in long_copies(size, 80)]
    want = brute(texts, 5, 80)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.component_rows(documents(spark, texts), 5, 80).collect()}
    assert rows == dict(enumerate(want))
    assert len({c for _, c in want}) == 12
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(documents(spark, texts)).collect()) == sorted({c for _, c in want})


def test_more_parts_than_differences_at_every_size():
    for percent in (80, 85):
        plan = jaccard.Plan(percent)
        for k in range(60):
            low, high = plan.lows[k], plan.lows[k + 1] - 1
            for (m, empty), differ in (
                (plan.parts(low, 2 * high), 2 * high * (100 - percent) // (100 + percent)),
                (plan.across(k), (high + 100 * high // percent) * (100 - percent) // (100 + percent)),
            ):
                assert (m, empty) == (0, 0) if not differ else m == differ + 1 + empty, (percent, low)


def test_components_of_very_long_documents(spark):
    texts = long_copies(45_000, 85) + long_copies(100_000, 85)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.component_rows(documents(spark, texts), 4, 85).collect()}
    assert rows == dict(enumerate(brute(texts, 4, 85)))
    assert len({c for _, c in rows.values()}) == 8


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (5, "a b c d e f g"), (6, None), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.component_rows(docs, 4, 85).collect()), key=str)
    assert got == sorted([(None, 4, 3), (3, 4, 3), (3, 4, 3), (5, 4, 3), (6, 0, 6), (7, 0, 7)], key=str)
    assert sorted((r["doc_id"] for r in jaccard.one_of_each(docs).collect()), key=str) == sorted([3, 6, 7], key=str)
    assert jaccard.component_rows(docs.where("false"), 4, 85).count() == 0


def test_a_null_id_links_what_stands_at_both_sides(spark):
    base = [f"w{k}" for k in range(200)]
    one, two, three = base, base[:100] + ["x"] + base[101:], base[:100] + ["x"] + base[101:150] + ["y", "z", "q"] + base[153:]
    far = " ".join(f"v{k}" for k in range(60))
    rows = [(1, " ".join(one)), (None, " ".join(two)), (2, " ".join(three)), (None, far), (None, far), (9, "other words of another text here"), (9, "second text of this doc_id stays too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([t for _, t in rows], 4, 94)
    assert want[2][1] == 0 and brute([rows[0][1], rows[2][1]], 4, 94)[1][1] == 1  # over the null row alone
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.component_rows(docs, 4, 94).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (9, 9), (9, 9)], key=str)
    assert sorted((r["doc_id"] for r in jaccard.one_of_each(docs, 4, 94).collect()), key=str) == sorted([1, None, 9, 9], key=str)


def family(seed, size=80, members=150):
    """One original and copies with more and more changes, many of them just beyond the limit; some are copies of copies."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(members):
        own = rnd.choice(out[-9:]).split() if rnd.random() < 0.15 else list(base)
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(own))
            own[k : k + 1] = rnd.choice([[], [f"x{rnd.randrange(99)}"], [own[k], "y"]])
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_about_the_limit(spark, seed):
    texts = [t for k in range(3) for t in family(10 * seed + k)]
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.component_rows(documents(spark, texts), 4, 85).collect()}
    assert rows == {k: c for k, (_, c) in enumerate(brute(texts, 4, 85))}


def test_lists_and_sets_are_dealt_once(spark):
    """What a leader's members need crosses one exchange, as text, and the lists are ranked once: both were done twice on larger tables."""
    docs, plan = documents(spark, family(7)), jaccard.Plan(85)
    indexed = jaccard.materialize(jaccard.index_lists(docs, 4, plan), "test-index")
    sets = indexed.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.min("n_shingles").alias("n_shingles"))
    found = jaccard.materialize(indexed.select("fp", F.explode("keys").alias("key"), F.lit(2).cast("long").alias("size")), "test-found")
    needs = indexed.select("fp", F.inline("blocks")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert plan_of(jaccard.shortest(found, needs)).count("row_number()") == 1
        lists = jaccard.leading(jaccard.materialize(jaccard.shortest(found, needs), "test-lists"))
        pairs = lists.where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
        assert pairs.count()
        assert plan_of(jaccard.judged(docs, sets, pairs, 4, 85)).count("MapInArrow") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components(spark):
    rnd = random.Random(8)
    edges = [(k, k + 1) for k in range(40, 120)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(500, k) for k in range(501, 700)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_query(spark):
    rows = jaccard.op7_jaccard(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    want = {ids[k]: (n, ids[c]) for k, (n, c) in enumerate(brute([texts[i] for i in ids], 4, 85))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
