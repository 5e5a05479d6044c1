import math
import re
import zlib
import random
from collections import Counter

import numpy as np

import pytest
from haulage.llm import ann, linededup, mixing


def brute_nearest(rows, queries, k):
    usable = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(queries):
        if q in usable:
            near = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:k]
            out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return out


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_nearest_against_brute_force(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    q = [i for i, _ in rows if i % 50 == 0]
    for block in (4096, 64):
        assert result(ann.nearest(v, v.where("vec_id % 50 = 0"), 10, block)) == brute_nearest(rows, q, 10)


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, []), (9, [float("inf"), 1.0]), (10, [-3.0, 1e-3]), (11, [1e8, 1.0]), (7, [1.0]), (12, [0.001, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    assert result(ann.nearest(df, df, 3)) == brute_nearest(rows, {i for i, _ in rows}, 3)
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0
    assert ann.nearest(df, df.where("false")).count() == 0


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w] + [0]


def test_mixing_against_plain_counts(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    c = Counter(w for d, t in texts if not held[d] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for known, symbols in ((131_072, 1024), (300, 64)):
        got = {r.doc_id: r for r in mixing.score_documents(docs, known=known, symbols=symbols).collect()}
        for d, t in texts:
            w = tokens(t)
            r = got[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in c for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        own = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
        print(symbols, sum(r.score for r in own), sum(r.base_score for r in own), np.mean([r.score > r.base_score for r in own]))


def test_mixing_is_a_distribution(spark):
    """The probabilities of all one-token continuations (known tokens, and one unknown) sum to one."""
    words = ["a", "b", "c", "d", "e"]
    train = [(k, " ".join(words[(k * 7 + j * j) % 5] for j in range(9)), "x") for k in range(40)]
    train = [(d, t, x) for d, t, x in train if zlib.crc32(str(d).encode()) % 7 != 2]
    m, counts = mixing.fit(spark.createDataFrame(train, "doc_id long, text string, n string"), known=3, symbols=3)
    every = {bytes(r.token): r.n for r in counts.collect()}
    total = 0.0
    for w in [*every, b"unknown"]:
        place = m.index.get(w, -1)
        s = m.symbols(np.array([place]))
        (p,) = mixing._mix(m, [s], m.weights)
        total += 10 ** p.sum() * (1 if s[0] else (every.get(w, 0) + 1) / (m.rare_total + m.rare_kinds + 1))
    assert math.isclose(total, 1, rel_tol=1e-9)


def plain_mix(m, sym):
    """log10 probabilities of one document's symbols, bit by bit; weights and own counts change once a block."""
    tree, w = m.tree, m.weights.copy()
    shown, out = np.zeros((2, tree.right.shape[0])), []
    c = mixing.contexts(sym, np.zeros(1, np.int64))
    nodes = tree.right.shape[0]
    for at in range(0, len(sym), mixing.BLOCK):
        step, seen, hits = np.zeros_like(w), np.zeros(len(w)), []
        for t in range(at, min(at + mixing.BLOCK, len(sym))):
            total = 0.0
            for d in range(tree.size[sym[t]]):
                node, bit = tree.nodes[tree.start[sym[t]] + d], tree.bits[tree.start[sym[t]] + d]
                x = np.array([m.tables[0][node], *[m.tables[k + 1][c[k][t] * nodes + node] for k in range(3)], math.log((shown[1][node] + 0.3) / (shown[0][node] + 0.3))])
                p = 1 / (1 + math.exp(-min(max(float(x @ w[d]), -12), 12)))
                total += math.log10(p if bit else 1 - p)
                step[d] += (bit - p) * x
                seen[d] += 1
                hits.append((bit, node))
            out.append(total)
        w += mixing.RATE * step / (seen + 16)[:, None]
        for bit, node in hits:
            shown[bit][node] += 1
    return out


def test_mixing_against_a_plain_mixer(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id % 7 < 4")
    m, _ = mixing.fit(docs, symbols=64)
    texts = [mixing.tokens_of(r.text.encode())[:400] for r in docs.limit(6).collect()]
    rows = [m.symbols(p) for p in m.look_up(texts)]
    for got, sym in zip(mixing._mix(m, rows, m.weights), rows):
        assert np.allclose(got, plain_mix(m, sym), atol=1e-4)


def test_mixing_match_predictor_against_plain_counts(spark, sf001):
    """Scores of pieces from counts kept in dictionaries; a document that occurs twice is told apart."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    train = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in texts}
    cut = {}
    for d, t in texts:
        starts, context, own = mixing.cut_pieces(np.array([mixing.hash_of(w) for w in mixing.tokens_of(t.encode())], np.uint64), np.zeros(1, np.int64))
        assert starts[0] == 0 and (np.diff(starts) > 0).all()
        cut[d] = list(zip(context[1:].tolist(), own[1:].tolist()))
    memory = Counter(x for d in cut if train[d] for x in cut[d])
    totals = Counter(x for d in cut if train[d] for x, _ in cut[d])
    tried, hits = Counter(), Counter()
    for d in cut:
        own, ctx = Counter(cut[d]), Counter(x for x, _ in cut[d])
        for x in cut[d] if train[d] else ():
            if totals[x[0]] > ctx[x[0]]:
                gate = min(mixing.GATES, totals[x[0]] - ctx[x[0]])
                tried[gate] += 1
                hits[gate] += memory[x] > own[x]
    assert hits[1] > 0
    got = {r.doc_id: r.bits_per_byte for r in mixing.score_documents(docs).collect()}
    held = [(d, t) for d, t in texts if train[d] and len(t) > 500]
    seen = Counter(t for _, t in held)
    twice, once = [got[d] for d, t in held if seen[t] > 1], [got[d] for d, t in held if seen[t] == 1]
    assert len(twice) > 5 and np.mean(np.array(twice) < np.quantile(once, 0.1)) > 0.95


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Word " * 60_000, 1), (3, "word", 1), (None, "w", 1)], "doc_id long, text string, score int")
    rows = mixing.score_documents(docs).collect()
    assert len(rows) == 5 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert mixing.score_documents(docs.where("false")).count() == 0
    only = mixing.score_documents(docs.where("doc_id = 2")).collect()
    assert only[0].n_tokens == 1


def grams(line):
    return {line} if len(line) < 5 else {line[i : i + 5] for i in range(len(line) - 4)}


def brute_lines(texts, similarity=0.8):
    """Text after dropping every line but the first of each component; all pairs of distinct lines are compared."""
    first, where = {}, []
    for d, t in sorted(texts):
        for pos, line in enumerate(t.split("\n")):
            if n := line.strip(" ").lower():
                first.setdefault(n, (d, pos))
                where.append((d, pos, n))
    lines = list(first)
    sets = [grams(x) for x in lines]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = 0
    for i, s in enumerate(sets):
        c = Counter(j for g in s for j in by[g] if j > i)
        for j, n in c.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(i)
                links += 1
    keep = {}
    for k, x in enumerate(lines):
        keep[find(k)] = min(keep.get(find(k), first[x]), first[x])
    at = {x: k for k, x in enumerate(lines)}
    return {(d, pos) for d, pos, n in where if (d, pos) != keep[find(at[n])]}, links


def test_lines_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone, links = brute_lines(texts.items())
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
    wrong = [d for d in texts if got[d].text != want[d]]
    print(len(gone), links, wrong)
    assert len(wrong) <= 0.02 * len(texts)
    assert all(got[d].n_chars == len(got[d].text) and got[d].n_lines == texts[d].count("\n") + 1 for d in texts)


def planted_recall(spark, rows):
    """Lines that brute force drops, and how many of them the operator drops (it may drop no others)."""
    gone, _ = brute_lines(rows)
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = Counter(d for d, _ in gone)
    assert all(n <= want[d] for d, n in got.items())
    return len(gone), sum(got.values())


@pytest.mark.parametrize("shared,own", [(12, 18), (24, 8), (30, 10)])
def test_lines_planted_near_copies(spark, shared, own):
    """Recall of planted alike lines among lines that all share one passage."""
    rng = random.Random(shared)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    passage, rows = " ".join(word() for _ in range(shared)), []
    for k in range(150):
        line = [word() for _ in range(own)]
        other = [*line]
        other[rng.randrange(own)] = word()
        rows += [(2 * k, " ".join([*line, passage])), (2 * k + 1, " ".join([*other, passage]))]
    gone, found = planted_recall(spark, rows)
    assert gone >= 100 and found >= 0.95 * gone


def test_lines_without_spaces(spark):
    """Recall of planted alike lines that have no spaces: codes, addresses with one beginning, Chinese, short ones."""
    rng, alnum = random.Random(5), "abcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    chinese = [chr(c) for c in range(0x4E00, 0x5E00)]
    rows = []
    for k in range(100):
        for j, (head, letters, low, high) in enumerate([("", alnum, 60, 160), ("https://www.example.com/articles/", alnum, 20, 60), ("", chinese, 20, 90), ("", alnum, 5, 40)]):
            line = some(letters, low, high)
            at = rng.randrange(len(line))
            rows += [(8 * k + 2 * j, head + line), (8 * k + 2 * j + 1, head + line[:at] + "?" + line[at + 1 :])]
    gone, found = planted_recall(spark, rows)
    assert gone >= 250 and found >= 0.97 * gone


def test_lines_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a\n\nA \nb", 1), (4, "b\nc", 1), (4, "b\nc", 1), (None, "c\nd", 1), (5, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df).collect()), key=str)
    assert (3, "a\n\nb", 4, 1) in got and (1, None, 0, 0) in got and (2, "", 1, 0) in got
    assert [g for g in got if g[0] == 4] == [(4, "", 2, 2)] * 2 and (None, "c\nd", 2, 0) in got
    assert linededup.dedup_lines(df.where("false")).count() == 0


def test_queries_are_dealt_into_groups(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 2 = 0"), 5, 32).collect()))
    assert one == sorted(map(tuple, ann.nearest(df, df.where("vec_id % 2 = 0"), 5, 32, group_bytes=4096).collect())) and len(one) == 1000
