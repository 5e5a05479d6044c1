import zlib

import pytest

from haulage.llm import toxicity
from haulage.llm.decontaminate import words_of


def brute_segments(scores):
    """Maximal-scoring segments by the recursive definition: the best segment, then those left and right of it."""
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12 or (where and abs(total - best) <= 1e-12 and j - i < where[1] - where[0]):
                best, where = total, (i, j)
    if not where:
        return []
    i, j = where
    return brute_segments(scores[:i]) + [(i, j + 1, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]


def test_segments_against_the_definition():
    m = toxicity.Model({"bad$": 1.03, "vile$": 0.52, "rude$": 0.31}, drift=-0.2)
    import random

    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice(["bad", "vile", "rude", *["fine"] * rng.randint(1, 8)]) for _ in range(30))
        words = words_of(text.encode())
        want = brute_segments([m.of(w) for w in words])
        got = m.segments(words)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted for r in held if toxic[r.doc_id])
    bad, wrong = sum(toxic[r.doc_id] for r in held), sum(r.predicted for r in held if not toxic[r.doc_id])
    print(len(held), bad, hit, wrong)
    assert hit / bad > 0.85 and wrong / (len(held) - bad) < 0.02
    m = toxicity.fit(docs, labels.withColumn("toxic", labels.toxic).where(f"crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"))
    assert m.curve == pytest.approx(toxicity.fit(docs, labels).curve)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x " * 60_000, 5), (None, "bad", 5), (3, "bad", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, m).collect()
    assert len(rows) == 5 and not any(r.predicted for r in rows)
    assert toxicity.drop_toxic(docs, m).columns == docs.columns
    assert toxicity.score(docs.where("false"), m).count() == 0


def test_odd_rows_with_a_fitted_model(spark):
    """Long, null, empty, repeated and clashing rows against a model that has tokens; ids that repeat keep their texts apart."""
    clean, foul = "the garden is green and the sky is wide today", "you vile rotten scum and vile rotten liar"
    rows = [(k, f"{clean if k % 10 else foul} word{k % 7}") for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(600)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert m.score and toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").where("false"), labels).score == {}
    odd = [(1000, None, 5), (1001, "", 5), (1002, clean + " x" * 300_000, 5), (1003, foul, 5), (1003, foul, 5), (1003, clean, 5), (None, foul, 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, score int")
    got = sorted(((r.doc_id, r.predicted) for r in toxicity.score(docs, m).collect()), key=str)
    assert got == [(1000, 0), (1001, 0), (1002, 0), (1003, 0), (1003, 1), (1003, 1), (None, 1)]
    kept = toxicity.drop_toxic(docs, m)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1000, 1001, 1002, 1003]
    assert toxicity.score(docs.where("false"), m).count() == 0
