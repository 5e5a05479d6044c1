import random

import numpy as np
import xxhash

from haulage.llm import simhash


def plain_fingerprint(text):
    b = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", b) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(fps):
    """Least id reachable over links of at most three differing bits."""
    ids = sorted(fps)
    arr = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_whole_table_against_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == brute(fps)


def test_links_and_hot_cells(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    rows = [(i, simhash._signed(f)) for i, f in enumerate(sorted(fps))]
    points = spark.createDataFrame(rows, "doc long, fp long")
    want = brute({i: f & (2**64 - 1) for i, f in rows})
    for most in (16384, 8, 2):
        links = simhash.near_links(points, most=most)
        roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
        assert {i: roots.get(i, i) for i, _ in rows} == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", None), (4, "Same words here now", "x"), (4, "Same words here now", "x"), (None, "same WORDS here now", "x"), (7, "w" * 200_000, "x"), (8, "é a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(map(tuple, simhash.simhash_groups(df).collect()), key=str)
    by = {}
    for d, f, c in got:
        by.setdefault(d, []).append((f, c))
    assert len(got) == len(rows) and by[1] == [("0" * 16, 1)] and by[2] == by[3] == [("0" * 16, 1)]
    assert len(by[4]) == 2 and by[None][0][1] == 4 and by[8][0][0] == f"{plain_fingerprint('é a'):016x}"
    assert simhash.simhash_groups(df.where("false")).count() == 0
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 4, 7, 8, None}
