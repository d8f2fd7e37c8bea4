import hashlib
import random
from collections import Counter, defaultdict

import pytest

from objectlake.llm import queries, repeats


def brute(texts, length=200):
    """The removed bytes of each text, by counting every window."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, until = [], 0
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[max(i, until) : i + length] = b"\1" * (i + length - max(i, until))
                until = i + length
        out.append(hit)
    return out


def digest(texts):
    out = []
    for t, hit in zip(texts, brute(texts), strict=True):
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), runs, hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


def answers(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_repeats_query(spark, sf):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([k for k, _ in docs], digest([t for _, t in docs]), strict=True))
    got = answers(queries.repeats_query(spark, sf).collect())
    assert got == want
    assert sum(n for _, n, *_ in want.values()) > 0


@pytest.mark.parametrize(("seed", "group", "segment"), [(1, 50_000, 4096), (2, 6, 2)])
def test_repeats_random(spark, lake, seed, group, segment, monkeypatch):
    """With a small ``group`` the tree is divided level by level; with a small ``segment`` suffixes answer for few occurrences."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(seed)

    def words(n):
        return "".join(rng.choice(["an", "the ", "é", "of ", "tion", "\n", "x"]) for _ in range(n))

    shared = [words(rng.randint(50, 400)) for _ in range(8)]
    texts = []
    for _ in range(60):
        text = words(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            text += s[a : rng.randint(a, len(s))] + words(rng.randint(0, 60))
        texts.append(text)
    texts += ["a" * 300, "a" * 250, "ab" * 200, None, "", texts[0], shared[0] * 3]
    got = answers(queries.repeats_query(spark, lake(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect())
    assert got == dict(enumerate(digest([(t or "").encode() for t in texts])))


def test_a_group_of_copies_over_many_batches(spark, lake):
    """Copies of one passage, in different surroundings and in none, in batches of a few rows."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    texts = [passage] * 40 + ["".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + passage + str(i) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = answers(queries.repeats_query(spark, lake(documents=df)).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch") if before is None else spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == dict(enumerate(digest([t.encode() for t in texts])))


def test_odd_rows(spark, odd):
    """Nulls, empty texts, repeated rows, and carried columns whose names are those of results."""
    rows = repeats.removed(odd.withColumnRenamed("rank", "n_bytes"), carry=("doc_id", "n_bytes", "n_chars")).collect()
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert Counter((r.n_bytes, r.n_removed) for r in rows) == Counter(d[:2] for d in digest(texts))
    assert Counter((r.carried.doc_id, r.carried.n_bytes) for r in rows) == Counter((r.doc_id, r["rank"]) for r in odd.collect())
    assert repeats.removed(odd.limit(0)).count() == 0


def test_ids_of_any_kind(spark):
    """Two different texts under one id, ids that are text, and rows without an id."""
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdef ") for _ in range(330)) for _ in range(2))
    rows = [("x", a), ("x", b), (None, b), ("y", a[:250]), ("x", a)]
    got = repeats.removed(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r.carried.doc_id, r.n_bytes, r.n_removed) for r in got) == Counter((k, len(t), n) for (k, t), (_, n, *_) in zip(rows, digest([t.encode() for _, t in rows]), strict=True))


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(3)
    anchor = b"ANCHOR"
    for _ in range(200):
        n = rng.randint(1, 9)
        befores = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(n)]
        afters = [anchor + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(n)]
        different = list(dict.fromkeys(zip(befores, afters, strict=True)))
        befores, afters = [b for b, _ in different], [a for _, a in different]
        times = [rng.choice([1, 1, 2]) for _ in different]
        group, least = repeats.Group([b[::-1] for b in befores], afters, times), 10
        found = list(group.maximal(least))
        got = {(b, a, tuple(sorted(o.tolist()))) for b, a, o, _ in found}
        want, pairs = set(), range(len(different))
        left, right = defaultdict(int), defaultdict(int)
        for i in pairs:
            for j in pairs[: i + 1]:
                if i == j and times[i] < 2:
                    continue
                b, a = repeats.common(befores[i][::-1], befores[j][::-1]), repeats.common(afters[i], afters[j])
                if a + b >= least:
                    if i != j:
                        want.add((b, a, tuple(m for m in pairs if repeats.common(befores[m][::-1], befores[i][::-1]) >= b and repeats.common(afters[m], afters[i]) >= a)))
                    else:
                        want.add((b, a, (i,)))
                    for m in (i, j):
                        left[m], right[m] = max(left[m], b), max(right[m], a)
        assert want <= got
        for b, a, o in got:
            assert b + a >= least and (len(o) > 1 or times[o[0]] > 1)
            nexts = {befores[m][::-1][b : b + 1] for m in o}
            assert len(nexts) > 1 or nexts == {b""}  # extended to the left by different bytes, or an end
            assert all(befores[m][::-1][:b] == befores[o[0]][::-1][:b] and afters[m][:a] == afters[o[0]][:a] for m in o)
        lo, hi = group.covered(least)
        assert {m: (lo[m], hi[m]) for m in pairs if hi[m]} == {m: (left[m], right[m]) for m in left}


def test_common_prefix():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"\0a") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert repeats.common(a, b) == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    every = {w: p for p, a, b in zip(*[x.tolist() for x in repeats.anchors(text)], strict=True) for w in range(a, b + 1)}
    assert sorted(every) == list(range(2801))
    for i in range(0, 2800, 7):
        (at,), (first,), (last,) = repeats.anchors(text[i : i + 200])
        assert every[i] == i + at and first == last == 0


def test_anchors_of_long_texts(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.choice(b"abcd ") for _ in range(5000)) + b"z" * 900 + b"xy" * 700
    whole = [x.tolist() for x in repeats.anchors(text)]
    monkeypatch.setattr(repeats, "STRETCH", 130)
    assert [x.tolist() for x in repeats.anchors(text)] == whole
