"""Near copies by SimHash fingerprints and the similarity of their word shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Candidates are
first the texts of one fingerprint and the links of the grid join of fingerprints (segment-popcount embedding, see
simhash). As edits move many near copies by more than its three bits, candidates also
share one of 20 bands of four MinHashes (a pair of similarity 0.8 is missed once in 38,000 times); every link is
verified on the sets themselves. A bucket of a few texts is compared whole in one task. In a larger one every text is
held against the bucket's first; those it is not like are then compared with all others of the bucket, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import as_bytes, cut, in_batches, pieces
from haulage.llm.components import connected_components
from haulage.llm.simhash import fingerprint
from haulage.llm.simhash import near_links as grid_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, DEPTH = 20, 4
#: Pairs with fewer agreeing MinHashes (of 80) are not held against each other: 64 are expected at 0.8, give or take 3.6.
AGREE = 45
_HASH_BLOCK = 1024
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * DEPTH, 1), np.uint64) | np.uint64(1)


def grams(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's five-word shingles as hashes; a shorter text is its own shingle."""
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)] if words else []), min(len(words), 1)
    else:
        shingles, n = map(b" ".join, zip(*(islice(words, i, None) for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def signature(own: np.ndarray) -> np.ndarray:
    """The 80 MinHashes of a set of hashes."""
    low = np.full(BANDS * DEPTH, (1 << 32) - 1, np.uint32)
    for at in range(0, len(own), _HASH_BLOCK):
        mixed = (own[None, at : at + _HASH_BLOCK] ^ _MIX[0]) * _MIX[1]
        low = np.minimum(low, (mixed.min(1) >> np.uint64(32)).astype(np.uint32))
    return low


def _long(data: bytes) -> int:
    x = xxhash.xxh64_intdigest(data, SEED)
    return x - (1 << 64) if x >= 1 << 63 else x


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to the name of the text's set, its fingerprint and its 20 bands."""
    for batch in pieces(batches):
        keys, fps, bands = [], [], []
        for text in as_bytes(batch.column(2)):
            own = grams(text)
            low = signature(own).reshape(BANDS, DEPTH)
            keys.append(_long(own.tobytes()))
            fps.append(fingerprint(text))
            bands.append([_long(bytes([b]) + row.tobytes()) for b, row in enumerate(low)])
        fps = pa.array(np.array(fps, np.uint64).view(np.int64))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), fps, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, signature, set)."""
    for batch in pieces(batches):
        own = [grams(t) for t in as_bytes(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array([signature(g).tobytes() for g in own], pa.binary()), pa.array([g.tobytes() for g in own], pa.binary())], names=["key", "sig", "grams"])


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _bucket_links(keys: list[int], sigs: list[bytes], sets: list[bytes], side: list[int], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of a bucket. Rows of side 1 are alike already in one component; rows of side 0 meet every row."""
    sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1)
    lab = np.arange(len(keys))
    joined = np.flatnonzero(np.array(side) == 1)
    if len(joined):
        lab[joined] = joined[0]
    own = [np.frombuffer(s, np.uint64) for s in sets]
    out = []
    for i in np.flatnonzero(np.array(side) == 0):
        for j in np.flatnonzero((sig == sig[i]).sum(1) >= AGREE):
            if lab[i] != lab[j] and _alike(own[i], own[j], similarity):
                out.append((keys[i], keys[j]))
                lab[lab == lab[i]] = lab[j]
    return out


def _meet(similarity: float):
    """mapInArrow over rows (bucket, key, side, sig, grams) sorted by the bucket: links inside the buckets."""

    def out(links) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in pieces(batches):
            for bucket, key, side, sig, own in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if len(held) > 1:
                        yield out(finish(held))
                    now, held = bucket, {}
                if key not in held or side == 0:
                    held[key] = (sig, own, side)
        if len(held) > 1:
            yield out(finish(held))

    def finish(held: dict) -> list[tuple[int, int]]:
        sigs, sets, side = zip(*held.values())
        return _bucket_links(list(held), list(sigs), list(sets), list(side), similarity)

    return run


def _verify(similarity: float):
    """mapInArrow over rows (key, rep, grams, rep_grams): the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a, b = ([np.frombuffer(s, np.uint64) for s in batch.column(k).to_pylist()] for k in (2, 3))
            ok = pa.array([_alike(x, y, similarity) for x, y in zip(a, b)], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


def _bucket_rows(members: DataFrame, sets: DataFrame, similarity: float, *by: str) -> DataFrame:
    rows = members.join(sets, "key").select(F.xxhash64(*by).alias("bucket"), "key", "side", "sig", "grams")
    return in_batches(rows.repartition("bucket").sortWithinPartitions("bucket"), _meet(similarity), "a long, b long")


def _large(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links in large buckets (band, key, n)."""
    reps = cut(members.groupBy("band").agg(F.min("key").alias("rep")))
    stars = cut(members.join(reps, "band").where("key != rep").select("band", "key", "rep"))
    own = sets.select("key", "grams")
    pairs = stars.select("key", "rep").distinct().join(own, "key").join(own.select(F.col("key").alias("rep"), F.col("grams").alias("rep_grams")), "rep")
    links = cut(in_batches(pairs.select("key", "rep", "grams", "rep_grams"), _verify(similarity), "a long, b long"))
    unlike = cut(stars.join(links.select(F.col("a").alias("key"), F.col("b").alias("rep")), ["key", "rep"], "left_anti").select("band", "key"))
    if unlike.isEmpty():
        return links
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = cut(unlike.groupBy("band").agg(F.count("*").alias("m")).join(members.select("band", "n").distinct(), "band").select("band", blocks("m").alias("left"), blocks("n").alias("right")))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = unlike.join(sizes, "band").select("band", "key", F.lit(0).alias("side"), place("left").alias("i"), span("right").alias("j"))
    rest = members.join(unlike, ["band", "key"], "left_anti").select("band", "key", F.lit(1).alias("side"))
    # Unlike texts are on the right too: not yet joined to any, so they count as rows of their own (side 2).
    rest = rest.unionByName(unlike.withColumn("side", F.lit(2)))
    right = rest.join(sizes, "band").select("band", "key", "side", span("left").alias("i"), place("right").alias("j"))
    return links.unionByName(_bucket_rows(left.unionByName(right), sets, similarity, "band", "i", "j"))


def _texts(docs: DataFrame, points: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of these keys, from the rows where they stand first."""
    wanted = points.join(keys, "key", "left_semi").select("key", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"))
    return docs.join(wanted, ["doc_id", "text_hash"]).select("key", "text").dropDuplicates(["key"])


def fingerprint_links(docs: DataFrame, points: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of similar sets among the pairs that the fingerprints' grid join links, and between the sets of each
    fingerprint and its first; points: (key, at (doc_id, text_hash), fp)."""
    reps = cut(points.groupBy("fp").agg(F.min("key").alias("doc"), F.max("key").alias("last")))
    same = points.join(reps.where("doc != last"), "fp").where("key != doc").select("key", F.col("doc").alias("rep"))
    pairs = cut(same.unionByName(grid_links(reps.select("doc", "fp")).select(F.col("a").alias("key"), F.col("b").alias("rep"))).distinct(), reps)
    ends = pairs.select("key").unionByName(pairs.select(F.col("rep").alias("key"))).distinct()
    own = cut(in_batches(_texts(docs, points, ends), _sets, "key long, sig binary, grams binary")).select("key", "grams")
    both = pairs.join(own, "key").join(own.select(F.col("key").alias("rep"), F.col("grams").alias("rep_grams")), "rep")
    return cut(in_batches(both.select("key", "rep", "grams", "rep_grams"), _verify(similarity), "a long, b long"), pairs)


def near_links(docs: DataFrame, points: DataFrame, similarity: float = SIMILARITY, small: int = 256) -> DataFrame:
    """Links (a, b) that join all similar sets into the right groups; points: (key, at (doc_id, text_hash), bands)."""
    rows = points.select(F.explode("bands").alias("band"), "key")
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.bit_xor(F.xxhash64("key")).alias("who")).where("n > 1")
    # Bands with the same members are one bucket.
    buckets = cut(buckets.groupBy("n", "low", "who").agg(F.min("band").alias("band")).select("band", "n"))
    members = cut(rows.join(buckets, "band").select("band", "key", "n"))
    texts = _texts(docs, points, members.select("key").distinct())
    sets = cut(in_batches(texts, _sets, "key long, sig binary, grams binary"))
    links = cut(_bucket_rows(members.where(F.col("n") <= small).select("band", "key", F.lit(0).alias("side")), sets, similarity, "band"))
    large = members.where(F.col("n") > small)
    return links if large.isEmpty() else links.unionByName(_large(large, sets, similarity, small))


def groups(docs: DataFrame, similarity: float = SIMILARITY, small: int = 256) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, component_id (the least doc_id of its group) and keep,
    the (doc_id, text_hash) that stands for the group.

    Texts without words are alike. A null doc_id takes part in no group of its own.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    marked = cut(in_batches(src, _sketch, "doc_id long, text_hash long, key long, fp long, bands array<long>"))
    points = cut(marked.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    close = fingerprint_links(src, points, similarity)
    joined = connected_components(close.unionByName(near_links(src, points, similarity, small)))
    roots = cut(joined, joined, close)
    named = points.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "at")
    named = cut(named, roots, points)
    least = cut(named.groupBy("root").agg(F.min("at").alias("keep")))
    named = cut(named.join(least, "root").select("key", "keep"), named, least)
    return marked.select("doc_id", "text_hash", "key").join(named, "key", "left").select("doc_id", "text_hash", F.col("keep.doc_id").alias("component_id"), "keep")
