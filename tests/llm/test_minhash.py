import random
import re
from collections import Counter

import pytest

from objectlake.llm import common, components, minhash, queries


def brute_set(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(docs, num=85, den=100):
    """id: (shingles, component), by comparing all pairs."""
    ids = sorted(docs)
    sets = {i: brute_set(docs[i]) for i in ids}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.kept == (r.doc_id == r.component_id)}


def test_near_duplicates_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert found(queries.near_duplicates_query(spark, sf)) == brute(docs)


@pytest.mark.parametrize("block", [512, 4])
def test_groups_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rng = random.Random(4)
    docs, n = {}, 0
    for _ in range(6):
        base = [rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(150)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(150)] = f"edit{rng.randint(0, 10**6)}"
            docs[n] = " ".join(copy)
            n += 1
            if rng.random() < 0.4:
                docs[n] = "\n".join(copy).upper()
                n += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(minhash.near_duplicates(df)) == brute(docs)


def test_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    docs = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute(docs)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(5, 5), (1, None), (7, 6), (6, 7)] + [(1000, i) for i in range(1001, 1100)]
    up = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in up} and len(got) == len(up)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    hashes = minhash.WordHashes()
    a = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    b = a[:3000] + [f"v{i}" for i in range(1000)]
    x, y = (minhash.shingles(" ".join(t).encode(), hashes) for t in (a, b))
    true = len(set(x) & set(y)) / len(set(x) | set(y))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - true) < 0.13
    assert Counter(len(minhash.shingles(t, hashes)) for t in (b"", b"one", b"a b c d e", b"a b c d e f")) == {0: 1, 1: 2, 2: 1}


def test_bands_follow_the_similarity():
    assert minhash.bands_rows(85, 100) == (21, 6) and minhash.slack(85, 100, 126) == 0.13
    for num in (5, 20, 50, 70, 80, 85, 90, 95, 99, 100):
        bands, rows = minhash.bands_rows(num, 100)
        assert (1 - (num / 100) ** rows) ** bands <= minhash.MISS
        assert bands * rows <= minhash.HASHES or rows == 1
        p, n = num / 100, bands * rows
        assert minhash.slack(num, 100, n) >= 4 * (p * (1 - p) / n) ** 0.5


@pytest.mark.parametrize("block", [512, 16])
def test_a_chain_of_near_copies(spark, block, monkeypatch):
    """Each text differs a little from the one before, so the ends of the chain share nothing."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    docs = {}
    for i in range(3000 if block == 512 else 300):
        docs[i] = " ".join(words)
        words[rng.randrange(120)] = f"w{rng.randint(0, 10**6)}"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}


def test_large_groups_that_blocks_leave_apart(spark, monkeypatch):
    """Members of one top in several blocks, of which some link only across blocks."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    sets = {i: list(range(100 * (i // 2), 100 * (i // 2) + 50 + i % 2)) for i in range(1, 24)}
    np = minhash.np
    df = spark.createDataFrame([(i, len(x), np.array(x, np.uint64).tobytes()) for i, x in sets.items()], "id long, n_shingles long, set binary")
    ties = spark.createDataFrame([(i, 1) for i in sets if i > 1], "id long, top long")
    got = {r.node: r.component for r in minhash.linked(ties, df, 8, 85, 100).collect()}
    assert got == {i: i - i % 2 for i in sets if i > 1}


def test_likely_rows(spark, monkeypatch):
    """All that is asked for stays, and little else."""
    ids = spark.range(0, 4000, 2).withColumn("id", minhash.F.col("id") * 7919)
    rows = spark.range(0, 40_000).withColumn("id", minhash.F.col("id") * 7919)
    got = {r.id for r in common.likely(rows, ids).collect()}
    assert {i * 7919 for i in range(0, 4000, 2)} <= got and len(got) < 2100
    monkeypatch.setattr(common, "BITS", 1 << 15)
    assert {i * 7919 for i in range(0, 4000, 2)} <= {r.id for r in common.likely(rows, ids).collect()}
    assert common.likely(rows, ids.limit(0)).count() == 0
    assert {r.id for r in common.without(rows, ids).collect()} == {r.id for r in rows.collect()} - {i * 7919 for i in range(0, 4000, 2)}


def test_hot_classes(spark, monkeypatch):
    """Most rows are copies of one text, and keys with more than a few rows are split."""
    monkeypatch.setattr(common, "SHARE", 10)
    docs = {i: "one text that very many rows have" if i % 4 else f"a text that number {i} has alone" for i in range(300)}
    assert found(minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))) == brute(docs)


def test_low_similarity(spark):
    """Most pairs near 0.5 share none of 21 bands of 6."""
    rng = random.Random(6)
    docs = {}
    for i in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(204)]
        docs[2 * i] = " ".join(base)
        docs[2 * i + 1] = " ".join(base[: rng.randint(128, 150)] + [f"v{rng.randint(0, 10**6)}" for _ in range(60)])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs, 50)
    assert sum(k != c for k, (_, c) in want.items()) > 10
    assert found(minhash.near_duplicates(df, num=50)) == want
