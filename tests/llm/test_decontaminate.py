import hashlib
import random
import re

from haulage.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in texts:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str) if any(x[0] is None for x in out) else sorted(out)


def result_rows(df):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()]


def result(df):
    return sorted(result_rows(df))


def test_whole_table_against_brute_force(spark, sf001):
    docs, bench = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sum(w[5] for w in want) > 5
    assert result(dc.contamination(docs, bench)) == want
    assert result(dc.contamination(docs, bench, shard_chars=2000)) == want
    clean = dc.decontaminate(docs, bench)
    after = {r.doc_id: r.text for r in clean.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for d, _, hit, _, _, bad in want:
        if not bad:
            assert after[d] == before[d]
        elif d in after:
            assert len(words(after[d])) == len(words(before[d])) - hit


def test_short_items_overlaps_and_repeats(spark):
    items = [(1, "a b a b a b a b a b a b"), (2, "b a"), (3, "Solo"), (4, "a b a b a b a b a b c"), (5, ""), (6, None), (7, "x y z x y z x y z"), (8, "é-1 é"), (10, "y z x")]
    texts = [(1, "a b a b a b a b a b a b a b c"), (2, "solo. SOLO!"), (3, None), (4, ""), (5, "x y z x y z x y z x y z"), (6, "é 1 é"), (7, "q " * 50_000 + "b a"), (8, "b,a"), (8, "b,a"), (9, "y z x y z")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(dc.contamination(docs, bench)) == brute(texts, items)
    assert result(dc.contamination(docs, bench, shard_chars=7)) == brute(texts, items)
    assert result(dc.contamination(docs, bench.where("false"))) == brute(texts, [])
    assert dc.contamination(docs.where("false"), bench).count() == 0
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 7}


def test_many_shards_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "TASK_BYTES", 1 << 14)
    rng = random.Random(5)
    long = " ".join(rng.choice(["w%d" % i for i in range(400)]) for _ in range(3000))
    items = [(1, long), (2, "b a"), (3, "Solo"), (4, "x y z x y z x"), (5, ""), (6, None), (7, long[2000:2200]), (8, "p " * 40 + "q " * 40), (9, "k" * 5000 + " l"), (None, "b a")]
    texts = [(0, long), (1, None), (2, ""), (3, "solo b a"), (3, "solo b a"), (4, "p " * 9 + "q"), (5, "p p p p p q q q q q"), (6, "x y z x y z"), (None, "x y z x y z x"), (7, "k" * 5000 + " L")]
    for d in range(10, 200):
        at = rng.randrange(len(long) - 400)
        texts.append((d, f"so {long[at : at + rng.randrange(20, 200)]} on"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(texts, [x for x in items if x[0] is not None]), key=str)
    assert sum(w[5] for w in want) > 100
    for chars in (400, 5000, 1_000_000):
        assert sorted(result_rows(dc.contamination(docs, bench, shard_chars=chars)), key=str) == want
        assert dc.contamination(docs.where("false"), bench, shard_chars=chars).count() == 0
    cut = [sorted(map(str, dc.decontaminate(docs, bench, shard_chars=chars).collect())) for chars in (400, 1_000_000)]
    assert cut[0] == cut[1]


def test_the_corpus_is_read_once(spark, sf001, monkeypatch):
    docs, passes = spark.read.parquet(f"{sf001}/documents.parquet"), []
    route = dc._routed
    monkeypatch.setattr(dc, "_routed", lambda texts, *more: passes.append(texts) or route(texts, *more))
    monkeypatch.setattr(dc, "_scan", lambda *a: 1 / 0)
    found = dc.found_spans(docs, spark.read.parquet(f"{sf001}/benchmark.parquet"), shard_chars=1000)
    assert len(passes) == 1 and "documents.parquet" not in found._jdf.queryExecution().toString()
