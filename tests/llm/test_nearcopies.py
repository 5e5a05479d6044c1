"""The pipeline's near copies: five-word shingles of Jaccard similarity 0.8 or more."""

import random

import pytest

from haulage.llm import nearcopies, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, low, high):
    """A copy with some words replaced, of a similarity between low and high."""
    while True:
        other = list(words)
        for at in rng.sample(range(len(words)), rng.randint(1, len(words) // 12)):
            other[at] = f"new{rng.randrange(10**6)}"
        if low <= jaccard(" ".join(words), " ".join(other)) < high:
            return other


def brute(texts):
    """Least id reachable over pairs of at least 0.8, all pairs that share a shingle compared."""
    by, root = {}, {d: d for d in texts}
    sets = {d: shingles(t) for d, t in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sorted(sets.items()):
        for o in {o for g in s for o in by.get(g, ())}:
            if len(s & sets[o]) >= 0.8 * len(s | sets[o]):
                a, b = sorted((find(d), find(o)))
                root[b] = a
        for g in s:
            by.setdefault(g, []).append(d)
    return {d: find(d) for d in texts}


def test_planted_near_copies(spark):
    rng = random.Random(3)
    texts = {}
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((100, 400, 1000)))]
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(edited(rng, words, 0.8, 0.96) if k % 3 else edited(rng, words, 0.5, 0.79))
    want = {d for d, c in brute(texts).items() if d == c}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert len(texts) - len(want) == 200 and got == want


def test_whole_table_against_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs).collect()} == want


@pytest.mark.parametrize("small", (256, 4))
def test_large_buckets(spark, small):
    """Chains of edits: members of one bucket that are like each other, but not like its first."""
    rng = random.Random(4)
    texts = {}
    for k in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for m in range(12):
            texts[100 * k + m] = " ".join(words)
            words = edited(rng, words, 0.8, 0.96)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs, small=small).collect()} == brute(texts)


def test_repeated_id_with_two_texts(spark):
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, first), (5, first + " end"), (5, second), (5, second), (6, second + " end")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(3, first), (5, second), (5, second)]


def test_fingerprints_meet_by_the_grid_join(spark, monkeypatch):
    """Without the bands, copies whose fingerprints are within three bits go, and only if they are similar."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "end"]), 3: "One two", 4: "one TWO ", 5: " ".join(f"v{rng.randrange(10**6)}" for _ in range(500))}
    far = [*words]
    for at in range(0, 2000, 120):
        far[at] = f"other{at}"
    texts[6] = " ".join(far)
    texts[7] = " ".join(texts[5].split()[:250] * 2)
    bits = {d: simhash.fingerprint(t.encode()) for d, t in texts.items()}
    assert (bits[1] ^ bits[2]).bit_count() <= 3 < (bits[1] ^ bits[6]).bit_count() and jaccard(texts[1], texts[6]) >= 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {1, 3, 5, 7}
    monkeypatch.setattr(nearcopies, "near_links", lambda docs, points, *_: points.select(points["key"].alias("a"), points["key"].alias("b")).where("false"))
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {1, 3, 5, 6, 7}
