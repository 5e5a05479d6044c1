"""Nearest neighbours by a block matrix join over int8 tiles.

Query and candidate vectors are packed into blocks; each pair of blocks meets once in a tile. A tile's distances come
from the product of the int8 codes, with an error bound from the quantisation errors of both vectors; only pairs whose
least possible distance could still be among the k nearest are recomputed from the original vectors in double
precision, and each query keeps a heap of its k best over the tiles of a task. The heaps are merged last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulage.llm.common import cut, in_batches

#: Vectors in a block, and queries whose heaps a task holds at once.
BLOCK, HELD = 4096, 65_536
#: Bytes of the query vectors that one task builds (some 250,000 of 128 components).
GROUP = 256 << 20
#: Most components of which the sum of products of int8 codes is exact in 32-bit floats.
_FLOAT_DIM = (1 << 24) // 127**2
_BLOCK = "dim int, ids binary, vecs binary"


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    plain = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & plain & F.exists("embedding", lambda x: x != 0))


def _pack(block: int):
    """mapInArrow: rows (vec_id, embedding) to blocks of at most `block` vectors of one dimension."""

    def out(dim: int, ids: list, vecs: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())], names=["dim", "ids", "vecs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), block):
                    some = rows[at : at + block]
                    a, b, n = held.get(dim, ([], [], 0))
                    a.append(ids[some])
                    b.append(flat[starts[some][:, None] + np.arange(dim)])
                    held[dim] = (a, b, n + len(some))
                    if n + len(some) >= block:
                        yield out(dim, *held.pop(dim)[:2])
        for dim, (a, b, _) in held.items():
            yield out(dim, a, b)

    return run


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as floats wide enough for exact products), scales, squared norms of the coded vectors, errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None])
    coded = q * scale[:, None]
    exact = np.float32 if x.shape[1] <= _FLOAT_DIM else np.float64
    return q.astype(exact), scale, np.einsum("ij,ij->i", coded, coded), np.linalg.norm(x - coded, axis=1) * (1 + 1e-9) + 1e-12


class _Best:
    """The k nearest so far of each query of a block: ids and distances, nearest first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.scale, self.norm, self.err = _codes(x)
        self.far = np.full(len(ids), np.inf)
        self.near: list[list[tuple[float, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        q, scale, norm, err = _codes(y)
        for at in range(0, len(self.ids), 512):
            self._tile(slice(at, at + 512), ids, y, q, scale, norm, err)

    def _tile(self, s: slice, ids, y, q, scale, norm, err) -> None:
        dot = (self.q[s] @ q.T).astype(np.float64) * self.scale[s][:, None] * scale[None, :]
        coded = self.norm[s][:, None] + norm[None, :] - 2 * dot
        slack = 1e-7 * (self.norm[s][:, None] + norm[None, :])  # rounding of the three terms
        bound = self.err[s][:, None] + err[None, :]
        low = np.sqrt(np.maximum(coded - slack, 0)) - bound
        high = np.sqrt(np.maximum(coded + slack, 0)) + bound
        own = self.ids[s][:, None] == ids[None, :]
        high[own] = np.inf
        low[own] = np.inf
        k = min(self.k, len(ids))
        reach = np.minimum(self.far[s], np.partition(high, k - 1, axis=1)[:, k - 1] if k == self.k else np.inf)
        rows, cols = np.nonzero(low <= reach[:, None])
        keep = np.isfinite(low[rows, cols])
        rows, cols = rows[keep], cols[keep]
        for part in range(0, len(rows), 1 << 16):
            r, c = rows[part : part + (1 << 16)], cols[part : part + (1 << 16)]
            d = np.sqrt(((self.x[s][r] - y[c]) ** 2).sum(axis=1))
            order = np.lexsort((ids[c], d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(r)]):
                b = min(b, a + self.k)
                i = s.start + int(r[a])
                best = sorted([*self.near[i], *zip(d[a:b].tolist(), ids[c[a:b]].tolist())])[: self.k]
                self.near[i] = best
                if len(best) == self.k:
                    self.far[i] = best[-1][0]


def _tiles(most: int):
    """mapInArrow over tiles (query block, candidate block): each task's `most` best of every query it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, _Best] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                dim, ids, vecs, q_ids, q_vecs = (column[k] for column in batch.columns)
                dim, key = dim.as_py(), q_ids.as_py()
                if key not in best:
                    while best and sum(len(b.ids) for b in best.values()) > HELD:
                        yield report(best.pop(next(iter(best))))
                    best[key] = _Best(np.frombuffer(key, np.int64), np.frombuffer(q_vecs.as_buffer()).reshape(-1, dim).copy(), most)
                best[key].meet(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vecs.as_buffer()).reshape(-1, dim))
        for b in best.values():
            yield report(b)

    def report(b: _Best) -> pa.RecordBatch:
        rows = [(int(q), v, d) for q, near in zip(b.ids, b.near) for d, v in near]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, group_bytes: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest vectors by Euclidean distance, ties to smaller ids.

    vectors and queries: vec_id, embedding. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null vec_id, take no part; only vectors of equal dimension are compared; a query is never its own
    neighbour. Rows that repeat a vec_id count once (the smallest vector). Fewer than k candidates give all of them.
    """
    once = lambda df: _usable(df).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    cand = in_batches(once(vectors), _pack(block), _BLOCK)
    asked = cut(in_batches(once(queries), _pack(block), _BLOCK).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")))
    # queries are dealt into groups of at most some GROUP bytes, and every group meets every tile of candidates: a
    # task builds one group and one tile, whatever the number of queries
    size = asked.agg(F.sum(F.length("q_vecs"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    tiles = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.withColumn("q_group", F.pmod(F.xxhash64("q_ids"), F.lit(groups)))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    cand = cand.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)))
    cand = cand.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    same = (cand["tile"] == asked["tile"]) & (F.col("group") == F.col("q_group")) & (F.col("dim") == F.col("q_dim"))
    pairs = cand.join(asked.hint("shuffle_hash"), same).select("dim", "ids", "vecs", "q_ids", "q_vecs")
    found = in_batches(pairs, _tiles(k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
