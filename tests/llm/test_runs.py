import hashlib
import random
from zlib import crc32

import numpy as np

from haulage.llm import queries, runs


def brute_lyndon(s):
    n = len(s)
    return [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i for i in range(n)]


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, 2 * q) and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def report(doc_id, text):
    words = (text or "").encode().split()
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    text = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def digests(df):
    return sorted((str(r.doc_id), tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_lyndon_arrays_and_runs_by_definition():
    rng = random.Random(13)
    for _ in range(1500):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 30))]
        assert runs.lyndon_array(np.array(s)).tolist() == brute_lyndon(s)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, a = rng.randint(0, 60), rng.randint(1, 3)
            s = [rng.randrange(a) for _ in range(n)]
            if n and rng.random() < 0.6:
                b, p = rng.randrange(n), rng.randint(1, 9)
                s = s[:b] + [s[b + k % min(p, n - b)] for k in range(n - b)] + [rng.randrange(a) for _ in range(rng.randint(0, 10))]
            docs.append([str(x).encode() for x in s])
        assert [list(map(tuple, r.tolist())) for r in runs.runs_of(docs)] == [brute_runs(d) for d in docs]


def test_fingerprints_that_agree_by_chance_do_not_decide(monkeypatch):
    monkeypatch.setattr(runs._Extensions, "_same", lambda self, a, b, size: np.ones(len(a), bool))
    s = [1, 2, 3] * 5 + [4, 5, 6, 7] + [8, 9] * 7
    assert list(map(tuple, runs.find_runs(np.array(s)).tolist())) == brute_runs(s)


def test_whole_query_against_brute_force(spark, small):
    got = digests(queries.op13_runs(spark, small))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((str(d), report(d, t)) for d, t in docs)
    assert sum(r[1][0] > 0 for r in got) > 10


def test_odd_rows(spark):
    long = " ".join(["a b"] * 100_000 + ["c"] + [f"w{k}" for k in range(50_000)] * 2)
    rows = [(1, None, 0), (2, "", 0), (3, " \t\r\n", 0), (4, "é x " * 12, 0), (None, "q r s " * 9, 0), (4, "x " * 11, 0), (5, "x " * 12 + "y", 0), (5, "x " * 12 + "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = runs.periodic_runs(df, runs.planted)
    assert digests(queries.F and found.withColumn("collapsed_sha256", queries.F.sha2("collapsed", 256))) == sorted((str(d), report(d, t)) for d, t, _ in rows)
    big = runs.periodic_runs(spark.createDataFrame([(6, long)], "doc_id long, text string")).first()
    assert [tuple(r) for r in big.runs] == [(0, 200_000, 2), (200_001, 100_000, 50_000)] and len(big.collapsed.split()) == 50_003
    assert runs.periodic_runs(df.where("false")).count() == 0
