"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits form 32 segments of two bits. The bit count of each segment (0, 1, 2) is kept in unary
(00, 01, 11), so the Manhattan distance of two embeddings is the number of bits in which their unary words
differ; it never exceeds the Hamming distance. The segments form six groups. Two points within Manhattan distance
three differ in at most three groups, so they agree in at least three: every point is put in the 20 grid cells
given by its coordinates in three of the groups, and only points of one cell are compared, first by the bound,
then by exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.names import free
from haulage.llm.common import as_bytes, cut, in_batches
from haulage.llm.components import connected_components

SHINGLE, SEED = 3, 42
_LOW = 0x5555555555555555
_HASH_BLOCK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _group_masks(segments: list[int], groups: int = 6) -> list[list[int]]:
    """The segments dealt into groups of even size."""
    cuts = [round(i * len(segments) / groups) for i in range(groups + 1)]
    return [segments[i:j] for i, j in zip(cuts, cuts[1:])]


def _cell_masks(segments: list[int]) -> list[tuple[int, list[int]]]:
    """For each three groups: the unary bits of their segments, and the segments left over."""
    out = []
    for chosen in combinations(_group_masks(segments), 3):
        fixed = [s for g in chosen for s in g]
        out.append((sum(3 << (2 * s) for s in fixed), [s for s in segments if s not in set(fixed)]))
    return out


CELLS = _cell_masks(list(range(32)))
#: A cell that outgrew a task is dealt again by the segments left over, now by their bits themselves: of six groups of
#: those, three are untouched by three flipped bits.
FINE_CELLS = [[mask for mask, _ in _cell_masks(rest)] for _, rest in CELLS]
#: A fine cell that outgrew a task is dealt once more, by the bits themselves of the segments that the first cells took.
FINEST_CELLS = [[mask for mask, _ in _cell_masks([s for s in range(32) if s not in set(rest)])] for _, rest in CELLS]


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text's three-word shingles; a text without words gives zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:])), len(words) - SHINGLE + 1
    digest, ones, left = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n
    while left > 0:
        size = min(left, _HASH_BLOCK)
        h = np.fromiter((digest(s, SEED) for s in islice(shingles, size)), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        left -= size
    return int((ones * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def embed(fp):
    """Column of the unary segment bit counts of a fingerprint column."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    low = fp.bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _np_embed(fp: np.ndarray) -> np.ndarray:
    x = fp.view(np.uint64)
    low, high = x & np.uint64(_LOW), (x >> np.uint64(1)) & np.uint64(_LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def _forest(n: int, i: np.ndarray, j: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Labels of n rows joined by the pairs (i, j): every label is the least row it can reach."""
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _near(fp: np.ndarray, emb: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within the radius: the Manhattan bound first, then the fingerprints themselves."""
    maybe = np.flatnonzero(np.bitwise_count(emb[i] ^ emb[j]) <= radius)
    return maybe[np.bitwise_count(fp[i[maybe]] ^ fp[j[maybe]]) <= radius]


def _links(cell: np.ndarray, doc: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the rows of each cell; rows of a cell lie together. Memory is bounded by blocks of pairs."""
    n = len(fp)
    ufp, emb = fp.view(np.uint64), _np_embed(fp)
    start = np.r_[0, np.flatnonzero(np.any(cell[1:] != cell[:-1], axis=1)) + 1] if n else np.zeros(0, int)
    size = np.diff(np.r_[start, n])
    lab = np.arange(n)
    small = np.repeat(size <= 64, size)
    left = np.repeat(start + size, size) - np.arange(n) - 1  # rows of the cell after this one
    found_i, found_j = [], []
    for d in range(1, 64):
        i = np.flatnonzero(small & (left >= d))
        if not len(i):
            break
        ok = _near(ufp, emb, i, i + d, radius)
        found_i.append(i[ok])
        found_j.append(i[ok] + d)
    if found_i:
        lab = _forest(n, np.concatenate(found_i), np.concatenate(found_j), lab)
    for s, m in zip(start[size > 64], size[size > 64]):
        own = np.arange(m)
        for at in range(0, m, 256):
            stop = min(at + 256, m)
            bound = np.bitwise_count(emb[s + at : s + stop, None] ^ emb[None, s + at : s + m]) <= radius
            i, j = np.nonzero(bound)
            keep = (j > i) & (own[at + i] != own[at + j])
            i, j = i[keep] + at, j[keep] + at
            ok = np.bitwise_count(ufp[s + i] ^ ufp[s + j]) <= radius
            if ok.any():
                own = _forest(m, i[ok], j[ok], own)
        lab[s : s + m] = s + own
    moved = np.flatnonzero(lab != np.arange(n))
    return doc[moved], doc[lab[moved]]


def _meet(keys: int, radius: int, most: int | None):
    """mapInArrow over rows (keys..., doc, fp) sorted by the keys: links inside cells; the rows of a cell of more
    than `most` go on unlinked, with the numbers of their masks (the first key, or the first two), to be dealt more
    finely."""

    def masks(rows: np.ndarray) -> np.ndarray:
        return rows[:, 0] if keys == 2 else rows[:, 0] * 32 + rows[:, 1]

    def out(kind: int, a, b, combo) -> pa.RecordBatch:
        n = len(a)
        return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(combo, pa.int64())], names=["kind", "a", "b", "combo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, keys + 2), np.int64)
        hot: bytes | None = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if hot is not None:
                same = np.all(rows[:, :keys] == np.frombuffer(hot, np.int64), axis=1)
                if same.any():
                    yield out(1, rows[same, keys], rows[same, keys + 1], masks(rows[same]))
                if same.all():
                    continue
                hot, rows = None, rows[~same]
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero(np.any(rows[:, :keys] != rows[-1, :keys], axis=1))
            at = last[-1] + 1 if len(last) else 0
            done, held = rows[:at], rows[at:]
            yield from finish(done)
            if most and len(held) > most:
                hot = held[0, :keys].tobytes()
                yield out(1, held[:, keys], held[:, keys + 1], masks(held))
                held = held[:0]
        yield from finish(held)

    def finish(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            a, b = _links(rows[:, :keys], rows[:, keys], rows[:, keys + 1].copy(), radius)
            yield out(0, a, b, np.zeros(len(a), np.int64))

    return run


_LINK = "kind int, a long, b long, combo long"


def near_links(points: DataFrame, radius: int = 3, most: int = 16384) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius into the right groups.

    points: (doc, fp), each fp once. Within a cell only a spanning forest of the close pairs goes on, never all
    pairs. A cell of more than `most` points is dealt again into 20 finer cells of about 16 more bits.
    """
    if radius > 3:
        raise ValueError("the grid covers a radius of at most 3")
    e = embed(F.col("fp"))
    cells = points.select("doc", "fp", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("combo"), e.bitwiseAND(F.lit(_signed(m))).alias("cell")) for k, (m, _) in enumerate(CELLS)])).alias("c"))
    cells = cells.select("c.combo", "c.cell", "doc", "fp").repartition("combo", "cell").sortWithinPartitions("combo", "cell")
    first = cut(cells.mapInArrow(_meet(2, radius, most), _LINK))
    links = first.where("kind = 0").select("a", "b")
    over = first.where("kind = 1").select("combo", F.col("a").alias("doc"), F.col("b").alias("fp"))
    if over.isEmpty():
        return links
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for k, ms in enumerate(FINE_CELLS)])
    coarse = F.array(*[F.lit(_signed(m)) for m, _ in CELLS])
    fine = over.select("combo", "doc", "fp", F.posexplode(F.element_at(masks, (F.col("combo") + 1).cast("int"))).alias("sub", "mask"))
    fine = fine.select("combo", F.col("sub").cast("long").alias("sub"), F.col("fp").bitwiseAND(F.col("mask")).alias("mask"), embed(F.col("fp")).bitwiseAND(F.element_at(coarse, (F.col("combo") + 1).cast("int"))).alias("cell"), "doc", "fp")
    fine = fine.repartition("combo", "sub", "mask", "cell").sortWithinPartitions("combo", "sub", "mask", "cell")
    second = cut(fine.mapInArrow(_meet(4, radius, most), _LINK))
    links, over = links.unionByName(second.where("kind = 0").select("a", "b")), second.where("kind = 1").select(F.col("combo").alias("code"), F.col("a").alias("doc"), F.col("b").alias("fp"))
    if over.isEmpty():
        return links
    table = lambda cells: F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in cells])
    at = (F.shiftright("code", 5) + 1).cast("int")
    same = [F.col("fp").bitwiseAND(F.get(F.element_at(table(FINE_CELLS), at), F.col("code").bitwiseAND(F.lit(31)).cast("int"))), embed(F.col("fp")).bitwiseAND(F.element_at(coarse, at))]
    finest = over.select("code", F.xxhash64(*same).alias("cell"), "doc", "fp", F.posexplode(F.element_at(table(FINEST_CELLS), at)).alias("sub", "mask"))
    finest = finest.select("code", F.xxhash64("cell", "sub", F.col("fp").bitwiseAND(F.col("mask"))).alias("cell"), "doc", "fp").repartition("code", "cell").sortWithinPartitions("code", "cell")
    return links.unionByName(finest.mapInArrow(_meet(2, radius, None), _LINK).select("a", "b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and wordless texts have fingerprint zero and link like any other. Rows that repeat a doc_id are each
    returned; a null doc_id takes part in no link of its own, but gets the group of its fingerprint (null if only
    null ids have it). Further columns of docs are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = cut(in_batches(src, _fingerprints, "doc_id long, fp long"))
    points = cut(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = connected_components(near_links(points, radius))
    named = cut(points.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("fp", F.coalesce("root", "doc").alias("component_id")), roots, points)
    return marked.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without the rows of each group of near copies but its least (doc_id, text); rows with a null doc_id stay.

    Near copies are met by the grid join of their fingerprints, verified by their five-word shingles; those whose
    fingerprints lie apart are looked for too: see nearcopies. Of a doc_id with several texts only the
    copied ones go; rows that repeat both the doc_id and the text of the row that stays, stay too.
    """
    from haulage.llm import nearcopies  # which needs the fingerprints from here

    groups = nearcopies.groups(docs, similarity).where("doc_id is not null")
    of, text_hash = free(docs, "of", "text_hash")
    gone = cut(groups.where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("keep"))).select(F.col("doc_id").alias(of), F.col("text_hash").alias(text_hash)).distinct())
    same = (docs["doc_id"].cast("long") == F.col(of)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text_hash))
    return docs.join(gone, same, "left_anti").select(docs.columns)
