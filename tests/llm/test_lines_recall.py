"""Recall of like lines with scattered changes at the edge of the similarity, and column names that clash in the stages."""

import random
from collections import Counter

from pyspark.sql import functions as F

from haulage.llm import decontaminate, linededup, simhash


def jaccard(a, b):
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def scattered(rng, words, lo, hi, low=0.80, high=0.825):
    """A line of that many characters and another of that similarity to it, single characters changed all over."""
    while True:
        n, line = rng.randint(lo, hi), ""
        while len(line) < n:
            line += rng.choice(words) + " "
        line = line[:n].strip()
        other, j = list(line), 1.0
        while j >= high:
            other[rng.randrange(len(other))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            j = jaccard(line, "".join(other))
        if j >= low:
            return line, "".join(other)


def test_recall_of_scattered_changes_at_every_length(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiourstlnmdpk") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows, cell = [], {}
    for lo, hi in ((60, 80), (90, 110), (155, 165), (240, 260), (490, 510), (880, 920)):
        for _ in range(150):
            k = len(rows) // 2
            a, b = scattered(rng, words, lo, hi)
            rows += [(2 * k, a), (2 * k + 1, b)]
            cell[k] = lo
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_dropped").collect()}
    found = Counter(lo for k, lo in cell.items() if got[2 * k + 1] == 1)
    assert not any(got[2 * k] for k in cell) and len(found) == 6 and min(found.values()) >= 143, found


def test_stages_keep_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    names = ["gone", "_d", "_t", "_h", "_s", "of", "text_hash", "own_hash", "cuts"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)
    df = spark.createDataFrame([(1, text, *range(9)), (2, text, *range(9)), (3, "another line of quite some length\nand more", *range(9))], schema)
    lines = linededup.dedup_lines(df)
    assert {(r.doc_id, r.n_dropped, tuple(r[n] for n in names)) for r in lines.collect()} == {(1, 0, tuple(range(9))), (2, 1, tuple(range(9))), (3, 0, tuple(range(9)))}
    near = simhash.drop_near_copies(df)
    assert near.columns == df.columns and sorted(r[0] for r in near.collect()) == [1, 3]
    items = spark.createDataFrame([(1, text), (2, "x " * 40)], "item_id long, text string")
    clean = decontaminate.decontaminate(df, items, shard_chars=40)
    assert clean.columns == df.columns and [tuple(r[n] for n in names) for r in clean.collect()] == [tuple(range(9))]


def test_shingles_from_bytes_are_those_of_characters(spark):
    lines = ["", "abcd", "abcde", "abcdef ghijk lmnop", "one\ttwo\x00three\nfour", "größer als alles", "漢字かな交じり文の例です", "mixed 😀 faces 😀 twice over", "x" * 300]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    for k in (5, 12):
        got = df.select("line", linededup._every(F.col("line"), k).alias("got")).collect()
        grams = {r.line: [r.line[i : i + k] for i in range(len(r.line) - k + 1)] for r in got}
        every = [(g,) for g in sorted({g for own in grams.values() for g in own})]
        hashes = {r[0]: r[1] for r in spark.createDataFrame(every, "g string").select("g", F.xxhash64("g")).collect()}
        assert {r.line: r.got for r in got} == {line: [hashes[g] for g in own] for line, own in grams.items()}


def test_small_buckets_are_settled_without_dealing_again(spark, monkeypatch):
    """Alike lines behind a passage that a few unlike lines share are met in its own buckets."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    passage, rows = " ".join(word() for _ in range(24)), []
    for k in range(8):
        line = [word() for _ in range(14)]
        rows += [(2 * k, " ".join([*line, passage])), (2 * k + 1, " ".join([*line[:-1], word(), passage]))]
    assert all((jaccard(a, b) >= 0.8) == (i // 2 == j // 2) for i, a in rows for j, b in rows)
    monkeypatch.setattr(linededup, "_rare", lambda *_: (_ for _ in ()).throw(AssertionError("dealt again")))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_dropped").collect()
    assert {r.doc_id: r.n_dropped for r in got} == {d: d % 2 for d, _ in rows}
