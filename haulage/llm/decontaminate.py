"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words of any item. Training text is streamed through it word by word; the length
of the longest suffix that is a run of some item is tracked, and wherever it reaches the window length (or a whole
shorter item) the words under the window are hit. A benchmark too large for one automaton is cut into shards; texts
meet only the automata of shards with which they share some words on end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.names import free
from haulage.llm.common import as_bytes, cut, in_batches, pieces

WINDOW = 10
#: Characters of items in one automaton, which takes about 130 bytes for each. A benchmark of up to as many is one
#: broadcast automaton; a larger one is cut into shards, of which tasks build the automata.
SHARD_CHARS = 1_000_000
#: Words on end that route texts to shards, and bits of the set that tells which of them the benchmark has.
GRAM, BITS = 6, 1 << 27
#: Bytes of texts that one automaton of a shard is built for.
TASK_BYTES = 64 << 20
#: Lower-cases A-Z and turns every other ASCII byte but digits and letters into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of the items' word sequences, with what is needed to report windows and items."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        paths = []
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if seq:
                paths.append((item, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        n = len(self.len)
        self.items: list[set[int]] = [set() for _ in range(n)]
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.shortest = min((min(len(s), window) for _, s in paths), default=0)
        for item, seq in paths:
            v = 0
            for c in seq:
                v = self.next[v][c]
                u = v
                while u > 0 and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if len(seq) < window:
                self.short[v].append((len(seq), item))
        order = sorted(range(n), key=lambda s: self.len[s])
        self.has_short = [False] * n
        for s in order[1:]:
            self.has_short[s] = bool(self.short[s]) or self.has_short[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:  # another item has been here
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def windows_at(self, state: int, matched: int) -> list[tuple[int, list[int]]]:
        """(length, items) of the windows that end where the automaton is in this state with this matched length."""
        out = []
        u, top = state, matched
        if matched >= self.window:
            while self.len[self.link[u]] >= self.window:
                u = self.link[u]
            out.append((self.window, sorted(self.items[u])))
        if self.has_short[state]:
            u = state
            while u > 0 and self.has_short[u]:
                out += [(n, [item]) for n, item in self.short[u] if n <= top]
                u = self.link[u]
                top = self.len[u]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans [start, end) under windows, and the items whose windows occur."""
        n = len(words)
        if not self.shortest or n < self.shortest:
            return [], set()
        get = self.ids.get
        seq = np.fromiter((get(w, -1) for w in words), np.int64, n)
        edge = np.diff(np.r_[False, seq >= 0, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window, has_short = self.next, self.link, self.len, self.window, self.has_short
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            v = m = 0
            for i, c in enumerate(seq[a:b].tolist(), a):
                while v and c not in nxt[v]:
                    v = link[v]
                    m = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    m += 1
                if m >= window or has_short[v]:
                    for size, items in self.windows_at(v, m):
                        found.update(items)
                        if spans and i + 1 - size <= spans[-1][1]:
                            start = i + 1 - size
                            while spans and start <= spans[-1][1]:
                                start = min(start, spans.pop()[0])
                            spans.append((start, i + 1))
                        else:
                            spans.append((i + 1 - size, i + 1))
        return spans, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


_FOUND = "spans array<struct<start:long,end:long>>, items array<long>"


def _shards(benchmark: DataFrame, shard_chars: int) -> tuple[DataFrame, int]:
    """The items with a text, and how many shards they make; their size is measured first."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return items, max(1, -(-total // shard_chars))


def _automaton(items: DataFrame, window: int):
    """The broadcast automaton of a benchmark that makes one shard."""
    return items.sparkSession.sparkContext.broadcast(Automaton([(r.item_id, r.text.encode()) for r in items.collect()], window))


def _scanned(own: Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, text_hash, n_words, spans, items) of a batch (doc_id, text_hash, text, more)."""
    words, where, items = [], [], []
    for text in as_bytes(batch.column(2)):
        w = words_of(text)
        spans, found = own.scan(w)
        words.append(len(w))
        where.append([{"start": a, "end": b} for a, b in spans])
        items.append(sorted(found))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.record_batch([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(where, spans_type), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])


def _scan(texts: DataFrame, automaton) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of the rows of texts (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in pieces(batches):
            yield _scanned(own, batch)

    return in_batches(texts, run, f"doc_id long, text_hash long, n_words long, {_FOUND}")


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; known remembers a bounded number of them."""
    if len(known) > 1 << 18:
        known.clear()
    return np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` words on end, of hashes of the words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for j in range(size if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def _item_pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text, keys): the items' words in pieces of some `most` bytes that share all but one word of a window with
    the next, so every window lies in a piece; and of each window the least hash of GRAM words (of all, in shorter
    ones) on end, with how many words that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in pieces(batches, 16):
            ids, texts, keys = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                start = 0
                while start < len(words) and (start == 0 or len(words) - start >= window):
                    step = max(1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")) - start)
                    own = words[start : start + step + window - 1]
                    wide = min(len(own), window)
                    size = min(wide, GRAM)
                    least = np.unique(np.lib.stride_tricks.sliding_window_view(_grams(_hashes(own, known), size), wide - size + 1).min(axis=1))
                    ids.append(item)
                    texts.append(b" ".join(own))
                    keys.append([{"key": k, "size": size} for k in least.view(np.int64).tolist()])
                    start += step
            key_type = pa.list_(pa.struct([("key", pa.int64()), ("size", pa.int32())]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(keys, key_type)], names=["item_id", "text", "keys"])

    return in_batches(items, run, "item_id long, text string, keys array<struct<key:long,size:int>>")


def _bits(keys: DataFrame):
    """A broadcast bit set of BITS bits in which every key has one."""
    at = F.shiftrightunsigned(F.col("key").bitwiseAND(BITS - 1), 6).alias("at")
    rows = keys.select(at, F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _routed(texts: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, keys, text): the corpus pass. keys: hashes of words on end that have their bit; texts
    without one are left out of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = bits.value, {}
        for batch in pieces(batches):
            texts, keys, n_words = as_bytes(batch.column(2)), [], []
            for k, text in enumerate(texts):
                words = words_of(text)
                h, found = _hashes(words, known), []
                for size in sizes:
                    g = _grams(h, size)
                    at = g & np.uint64(BITS - 1)
                    found.append(g[(own[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1])
                found = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
                n_words.append(len(words))
                keys.append(found.view(np.int64))
                if not len(found):
                    texts[k] = None
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text_hash", "n_words", "keys", "text"])

    return in_batches(texts, run, "doc_id long, text_hash long, n_words long, keys array<long>, text string")


def _scan_dealt(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, spans, items) of the texts of rows (id, text_hash, text, shard, salt, kind).

    Rows come grouped by (shard, salt), the items (kind 0) before the texts; a task holds one automaton at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items, own = None, [], None
        for batch in pieces(batches):
            marks = list(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))))
            start = 0
            for end in range(1, len(marks) + 1):
                if end < len(marks) and marks[end] == marks[start]:
                    continue
                part, (shard, salt, kind) = batch.slice(start, end - start), marks[start]
                start = end
                if (shard, salt) != group:
                    group, items, own = (shard, salt), [], None
                if kind == 0:
                    items += zip(part.column(0).to_pylist(), as_bytes(part.column(2)))
                    continue
                if own is None:
                    own, items = Automaton(items, window), []
                out = _scanned(own, part)
                yield out.filter(pa.compute.greater(pa.compute.list_value_length(out["spans"]), 0)).select(["doc_id", "text_hash", "spans", "items"])

    return in_batches(rows, run, f"doc_id long, text_hash long, {_FOUND}")


def _merge_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, all spans, all items) with overlapping spans made one."""
    for batch in pieces(batches):
        spans = [[{"start": a, "end": b} for a, b in _merge([(x["start"], x["end"]) for x in row])] for row in batch.column(2).to_pylist()]
        yield batch.set_column(2, batch.schema.field(2), pa.array(spans, batch.schema.field(2).type))


def _found_in_shards(texts: DataFrame, items: DataFrame, shards: int, window: int, shard_chars: int) -> DataFrame:
    """found_spans for a benchmark of many shards, each of which tasks turn into automata.

    One pass over the corpus finds the texts that share the least hash of some window of the benchmark (a bit set of
    fixed size goes before the join with the hashes); only these texts are dealt to the shards they may match, as many
    tasks for a shard as its texts have bytes for, and streamed through its automaton there.
    """
    own = _item_pieces(items, window, max(1, shard_chars // 8)).withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    own = cut(own)
    keys = cut(own.select("shard", F.explode("keys").alias("k")).select("shard", "k.key", "k.size").distinct())
    sizes = sorted(r.size for r in keys.select("size").distinct().collect())
    bits = _bits(keys)
    routed = cut(_routed(texts, bits, sizes))
    bits.destroy()
    some = routed.where(F.size("keys") > 0)
    pairs = cut(some.select("doc_id", "text_hash", F.explode("keys").alias("key")).join(keys.select("key", "shard"), "key").select("doc_id", "text_hash", "shard").distinct(), keys)
    wanted, told = pairs.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("as"), "shard"), some.select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"])
    dealt = cut(told.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("as"))).select("doc_id", "text_hash", "text", "shard"), pairs)
    salts = cut(dealt.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / TASK_BYTES).cast("int").alias("salts")))
    dealt = dealt.join(salts, "shard").select(F.col("doc_id").alias("id"), "text_hash", "text", "shard", F.pmod(F.xxhash64("doc_id", "text_hash"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"))
    every = own.join(salts, "shard").select(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("text_hash"), "text", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    rows = every.unionByName(dealt).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    parts = cut(_scan_dealt(rows, window), own, dealt, salts)
    parts = parts.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = cut(in_batches(parts, _merge_passes, f"doc_id long, text_hash long, {_FOUND}"))
    same = routed["doc_id"].eqNullSafe(merged["doc_id"]) & (routed["text_hash"] == merged["text_hash"])
    none = lambda c: F.coalesce(merged[c], F.array().cast(merged.schema[c].dataType))
    return routed.join(merged, same, "left").select(routed["doc_id"], routed["text_hash"], "n_words", none("spans").alias("spans"), none("items").alias("items"))


def found_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of each row of docs, however many shards the benchmark makes."""
    items, shards = _shards(benchmark, shard_chars)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    if shards == 1:
        return _scan(texts, _automaton(items, window))
    return _found_in_shards(texts, items, shards, window, shard_chars)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word positions).

    Null texts have no words; wordless items and items with a null id or text have no window; an empty benchmark
    hits nothing. Repeated rows give repeated results; further columns are ignored.
    """
    found = found_spans(docs, benchmark, window, id_col, text_col, shard_chars)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text", id_col: str = "doc_id", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs with the hit spans cut out of their texts; a document of which more than max_coverage of the words are hit
    is dropped whole. All columns stay; documents without a hit are untouched (null texts too)."""
    items, shards = _shards(benchmark, shard_chars)
    place = docs.columns.index(text_col)

    def cleaned(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts, keep = as_bytes(batch.column(place)), []
        for k, (text, own) in enumerate(zip(texts, spans)):
            keep.append(not own or sum(b - a for a, b in own) <= max_coverage * len(words_of(text)))
            if own and keep[-1]:
                texts[k] = without_spans(text, own)
        column = pa.array(texts, pa.binary()).cast(batch.schema.field(place).type)
        return batch.set_column(place, batch.schema.field(place), column).filter(pa.array(keep, pa.bool_()))

    if shards == 1:
        automaton = _automaton(items, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = automaton.value
            for batch in pieces(batches):
                yield cleaned(batch, [own.scan(words_of(t))[0] for t in as_bytes(batch.column(place))])

        return in_batches(docs, run, docs.schema)
    found = found_spans(docs, benchmark, window, id_col, text_col, shard_chars).where(F.size("spans") > 0)
    of, text_hash, cuts = free(docs, "of", "text_hash", "cuts")
    found = found.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text_hash), F.col("spans").alias(cuts)).dropDuplicates([of, text_hash])
    same = docs[id_col].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(text_hash))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = [[(x["start"], x["end"]) for x in row or ()] for row in batch.column(batch.num_columns - 1).to_pylist()]
            yield cleaned(batch.select(range(batch.num_columns - 1)), spans)

    return in_batches(docs.join(found, same, "left").select(*[docs[c] for c in docs.columns], cuts), run_joined, docs.schema)
