"""Periodic runs of words: Lyndon arrays by the grouping phase of a suffix sorter, roots extended by common extensions.

A run is a stretch of words of smallest period q, of at least two periods and 12 words, that no neighbouring word extends.
Phase one of Baier's suffix sorter groups the positions of a sequence by their longest Lyndon prefix, so it gives the
Lyndon array directly. Done under the order of the words and under its reverse, the Lyndon prefixes hold a root of
every run; a root [i, i+p) is extended as far as words p apart agree, to both sides.

Only stretches of which every six words occur twice in their document are grouped: in a run of 12 words or more each word
lies in six words in a row that come again one period further, so no run is lost. The stretches of a batch of documents
are one sequence, with a symbol of its own between any two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import as_bytes, in_batches, pieces

LEAST, GRAM = 12, 6
#: The odd factors of the two rolling fingerprints (fixed values).
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string"


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each position; the end counts as the least symbol.

    Groups start as the symbols and are taken from the greatest down. Every position of the group points at the nearest
    position to its left that is in no greater group and not in this one; what is pointed at k times takes the group's
    word k times onto its own and moves to a group just above its old one. Positions taken are spliced out of the links
    to the left, so each is followed once.
    """
    n = len(symbols)
    kinds, first = np.unique(symbols, return_inverse=True)
    order = np.argsort(first, kind="stable")
    ends = np.cumsum(np.bincount(first, minlength=len(kinds)))
    members = [m.tolist() for m in np.split(order, ends[:-1])]
    group, width = first.tolist(), [1] * len(kinds)
    below, above = list(range(-1, len(kinds) - 1)), list(range(1, len(kinds) + 1))
    left, taken, out = list(range(-1, n - 1)), bytearray(n + 1), [1] * n
    top = len(kinds) - 1
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        members[top], wide = (), width[top]
        for i in own:
            taken[i] = 1
            out[i] = wide
        asked: dict[int, int] = {}
        for i in own:
            p = left[i]
            if p >= 0 and taken[p]:
                path = [i]
                while p >= 0 and taken[p]:
                    path.append(p)
                    p = left[p]
                for q in path:
                    left[q] = p
            if p >= 0:
                asked[p] = asked.get(p, 0) + 1
        if asked:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in asked.items():
                key = (-k, group[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            for k, old in sorted(moved) if len(moved) > 1 else moved:  # the most asked for come to lie highest
                new, up = len(width), above[old]
                width.append(width[old] - k * wide)
                members.append(moved[k, old])
                below.append(old)
                above.append(up)
                above[old] = new
                if up < len(below):
                    below[up] = new
                for p in moved[k, old]:
                    group[p] = new
        top = below[top]
    return np.array(out, np.int64)


class _Extensions:
    """Longest common extensions of a sequence, by fingerprints of all prefixes and halving steps."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = n = len(symbols)
        mixed = (symbols.astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.full(n + 1, MIX, np.uint64))
            self.powers, self.sums = powers, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:n])])

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of this size at a and b > a agree, by fingerprint."""
        with np.errstate(over="ignore"):
            return (self.sums[a + size] - self.sums[a]) * self.powers[b - a - 1] == self.sums[b + size] - self.sums[b]

    def _most(self, limit: np.ndarray, same) -> np.ndarray:
        low, step = np.zeros(len(limit), np.int64), 1 << int(limit.max(initial=0)).bit_length()
        while step:
            more = low + step <= limit
            more[more] = same(more, (low + step)[more])
            low[more] += step
            step >>= 1
        return low

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._most(self.n - b, lambda at, size: self._same(a[at], b[at], size))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many positions before a and before b agree."""
        return self._most(a, lambda at, size: self._same(a[at] - size, b[at] - size, size))


def find_runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), sorted, of the runs of at least `least` symbols. Numbers that no other position has may
    be used to part stretches."""
    if len(symbols) < least:
        return np.zeros((0, 3), np.int64)
    ext, found = _Extensions(symbols), []
    for order in (symbols, symbols.max() - symbols):
        period = lyndon_array(order)
        i = np.flatnonzero(np.arange(len(symbols)) + period < len(symbols))
        p = period[i]
        start = i - ext.left(i, i + p)
        size = i + p + ext.right(i, i + p) - start
        good = size >= np.maximum(least, 2 * p)
        found.append(np.stack([start[good], size[good], p[good], i[good]], 1))
    every = np.concatenate(found)
    runs, which = np.unique(every[:, :3], axis=0, return_inverse=True)
    true = np.array([_is_run(symbols, *r) for r in runs.tolist()], bool)
    if true.all():
        return runs
    # fingerprints of unlike stretches agreed: these roots are extended word by word
    again = [_extended(symbols, i, p) for _, _, p, i in every[~true[which.ravel()]].tolist()]
    again = [r for r in again if r[1] >= max(least, 2 * r[2])]
    return np.unique(np.array([*runs[true].tolist(), *again], np.int64).reshape(-1, 3), axis=0)


def _is_run(symbols: np.ndarray, s: int, size: int, p: int) -> bool:
    e = s + size
    return bool(np.array_equal(symbols[s : e - p], symbols[s + p : e]) and (s == 0 or symbols[s - 1] != symbols[s - 1 + p]) and (e == len(symbols) or symbols[e] != symbols[e - p]))


def _extended(symbols: np.ndarray, i: int, p: int) -> tuple[int, int, int]:
    s, e = i, i + p
    while s and symbols[s - 1] == symbols[s - 1 + p]:
        s -= 1
    while e < len(symbols) and symbols[e] == symbols[e - p]:
        e += 1
    return s, e - s, p


def _repeated(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in six words in a row that occur twice in their document (or, by chance of hashing, others too)."""
    n, out = len(ids) - GRAM + 1, np.zeros(len(ids), bool)
    if n < 2:
        return out
    with np.errstate(over="ignore"):
        key = doc[:n].astype(np.uint64) * MIX
        for k in range(GRAM):
            key = (key ^ (key >> np.uint64(31))) * MIX + ids[k : k + n].astype(np.uint64)
    inside = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    twice = np.zeros(len(order), bool)
    equal = key[order[1:]] == key[order[:-1]]
    twice[1:] |= equal
    twice[:-1] |= equal
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[order[twice]] += 1
    edge[order[twice] + GRAM] -= 1
    return np.cumsum(edge)[:-1] > 0


def runs_of(words: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs (start, length, period)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    kept = np.flatnonzero(_repeated(ids, doc))
    none = np.zeros((0, 3), np.int64)
    if not len(kept):
        return [none] * len(words)
    # stretches of kept words, each followed by a number of its own
    ends = np.append((np.diff(kept) > 1) | (np.diff(doc[kept]) > 0), True)
    last, place = np.flatnonzero(ends), np.arange(len(kept)) + np.cumsum(ends) - ends
    seq = np.empty(len(kept) + len(last), np.int64)
    seq[place] = ids[kept]
    seq[place[last] + 1] = len(known) + np.arange(len(last))
    at = np.full(len(seq), -1, np.int64)
    at[place] = kept
    found = find_runs(np.unique(seq, return_inverse=True)[1].astype(np.int64))
    if not len(found):
        return [none] * len(words)
    first = at[found[:, 0]]
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = doc[first]
    rows = np.stack([first - offset[owner], found[:, 1], found[:, 2]], 1)
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    return [rows[cuts[k] : cuts[k + 1]] for k in range(len(words))]


def _report(words: list[bytes], runs: np.ndarray) -> tuple:
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    if best:
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
    s, n, p = best or (None, None, None)
    listed = [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()]
    return len(runs), s, n, p, 1000 * n // p if best else None, listed, hashlib.sha256(lines.encode()).hexdigest(), b" ".join(words)


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli; ties by start,
    then period; nulls where there is none), runs (all, by start, then period), runs_sha256 (of `start,length,period` and
    a line feed for each) and collapsed: the words, joined by one space, without what lies in a run after its first period.

    Words are what white space of ASCII parts. Null and empty texts have no words. change(doc_id, words) may give other
    words to look at. Repeated rows are reported each; other columns are left out. A text is one task's work, a batch
    of texts at most a few megabytes, or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            words = [(t or b"").split() for t in as_bytes(batch.column(1))]
            if change:
                words = [change(i, ws) for i, ws in zip(ids, words)]
            told = [(len(ws), *_report(ws, runs)) for ws, runs in zip(words, runs_of(words))]
            arrays = [pa.array([t[k] for t in told], pa.int64()) for k in range(6)]
            runs = pa.array([t[6] for t in told], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            arrays += [runs, pa.array([t[7] for t in told], pa.string()), pa.array([t[8] for t in told], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, {SCHEMA}")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with, in a tenth of the documents, a tail that repeats: word i from a = g mod n on is word a + (i-a) mod p,
    with g = h div 10, p = 1 + (n-a) div (3 + g mod 8) and h the crc32 of the number of the document."""
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
