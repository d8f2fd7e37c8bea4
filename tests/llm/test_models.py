import re
import zlib
from collections import Counter

import numpy as np
import pytest

from objectlake.llm import features, langid, quality, queries


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


# ---- language ----------------------------------------------------------------------


def test_language_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf).set_index("doc_id")
    out = queries.language_query(spark, sf).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.index]).all()
    held = out[out.held_out].join(docs)
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_ignores_labels_of_held_out_rows(spark, lake):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", queries.F.when(queries.held_out(), "xx").otherwise(queries.F.col("lang"))).withColumn("source", queries.F.lit("z"))
    a = {tuple(r) for r in queries.language_query(spark, lake(documents=other)).collect()}
    assert a == {tuple(r) for r in queries.language_query(spark, "/root/testdata/sf0.001").collect()}


def test_language_odd_rows(spark, odd, lake):
    rows = queries.language_query(spark, lake(documents=odd)).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        if not text[r.doc_id] or not re.search(r"[^\W\d_]", text[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "en" and 0 <= r.score <= 1  # the one language that was learned


def test_language_nothing_to_learn(spark, odd, lake):
    rows = queries.language_query(spark, lake(documents=odd.withColumn("lang", queries.F.lit(None).cast("string")))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_language_empty(spark, odd, lake):
    assert queries.language_query(spark, lake(documents=odd.limit(0))).count() == 0


def test_families_then_pairs():
    words = {"en": "the and of with", "de": "der und nicht schon", "fr": "le que dans une", "es": "los por para muy", "qq": "zzxq vvkj qqxz"}
    rng = np.random.default_rng(1)
    rows = []
    for code, vocabulary in words.items():
        for _ in range(20):
            x = langid.vector(" ".join(rng.choice(vocabulary.split(), 12)))
            rows.append((code, *features.thin(x)))
    model = langid.train(rows)
    assert model.families == ["germanic", "qq", "romance"] and model.pairs == [("germanic", "de", "en"), ("romance", "es", "fr")]
    got = model.predict(np.stack([langid.vector(v) for v in words.values()]))
    assert [g for g, _ in got] == list(words)


def test_predictions_by_brute_force():
    """One separator at a time, in double loops."""
    rng = np.random.default_rng(5)
    codes = {"germanic": ["da", "de", "en"], "romance": ["fr"], "uralic": ["fi", "hu"]}
    pairs = [(f, a, b) for f, some in codes.items() for i, a in enumerate(some) for b in some[i + 1 :]]
    n = len(codes) + len(pairs)
    model = langid.Model(list(codes), codes, rng.standard_normal((16, n)).astype(np.float32), rng.standard_normal(n).astype(np.float32), [(1.5, 0.1)] * n, pairs)
    x = rng.standard_normal((40, 16)).astype(np.float32)
    for row, (language, score) in zip(x, model.predict(x), strict=True):
        chance = [1 / (1 + np.exp(-(1.5 * (sum(float(p) * float(w) for p, w in zip(row, model.weights[:, i], strict=True)) + float(model.offsets[i])) + 0.1))) for i in range(n)]
        family = max(range(len(codes)), key=lambda i: chance[i])
        votes = dict.fromkeys(codes[list(codes)[family]], 0.0)
        for i, (of, a, b) in enumerate(pairs):
            if of == list(codes)[family]:
                votes[a] += chance[len(codes) + i]
                votes[b] += 1 - chance[len(codes) + i]
        best = max(votes, key=votes.get)
        want = chance[family] / sum(chance[: len(codes)]) * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1)
        assert language == best and abs(score - want) < 1e-4


def test_every_language_is_learned(spark):
    """Also where there are very many, and some are rare."""
    rows = [(i, f"{chr(97 + i % 20)}{chr(97 + i // 20 % 20)}q " * 20, f"l{i % 100}") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.families) == 100


def test_long_texts_are_counted_whole(monkeypatch):
    text = "abc défg " * 500
    whole = features.char_counts(text, (1, 2, 3), 12, True)
    monkeypatch.setattr(features, "PART", 100)
    parts = features.char_counts(text, (3,), 12, True)
    assert parts.sum() >= whole[2 << 12 :].sum()


# ---- quality -----------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 5))
    lines, seen, doubled = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(hit), n < 10 or 100 * len(hit) > 20 * n


def answers(rows):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    rows = queries.quality_query(spark, sf).collect()
    assert answers(rows) == Counter((k, *brute_measures(t)) for k, t in zip(docs.doc_id.tolist(), docs.text, strict=True))
    assert not any(r.kept and r.base_failed for r in rows)
    label = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    right = [r.kept == bool(label[r.doc_id]) for r in rows if r.doc_id in label]
    assert sum(right) > 0.95 * len(right)


def test_quality_of_rows_kept_out_of_the_fit(spark, lake):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    label = dict(labels.select("doc_id", "quality").collect())
    rows = queries.quality_query(spark, lake(documents=docs, labels=labels.where("doc_id % 4 <> 0"))).collect()
    right = [r.kept == bool(label[r.doc_id]) for r in rows if r.doc_id in label and r.doc_id % 4 == 0]
    assert len(right) > 50 and sum(right) > 0.9 * len(right)


def test_quality_odd_rows(spark, odd, lake):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = queries.quality_query(spark, lake(documents=odd, labels=labels)).collect()
    assert answers(rows) == Counter((r.doc_id, *brute_measures(r.text)) for r in odd.collect())


@pytest.mark.parametrize("which", ["documents", "labels"])
def test_quality_empty(spark, odd, lake, which):
    tables = {"documents": odd, "labels": spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")}
    tables[which] = tables[which].limit(0)
    rows = queries.quality_query(spark, lake(**tables)).collect()
    assert all(r.kept != r.base_failed for r in rows) and len(rows) == (0 if which == "documents" else odd.count())


def test_calibration():
    rng = np.random.default_rng(2)
    true = rng.random(4000)
    y = np.where(rng.random(4000) < true, 1.0, -1.0)
    a, b = features.platt(3 * np.log(true / (1 - true)), y)
    assert abs(a - 1 / 3) < 0.05 and abs(b) < 0.15
