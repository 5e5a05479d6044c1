"""Language-model scores by online logistic mixing of hashed-context bit predictors.

The most frequent training tokens are symbols, all others share one escape symbol. A symbol is coded as the bits of
its path in a Huffman tree. Each bit is predicted in several contexts: none, the previous symbol, the last frequent
symbol, a hash of the last two frequent symbols, and what the document itself has shown so far. The predictions are
mixed in the logistic domain with weights gated by the depth of the bit and refined block by block while the document
is read. An escaped token is then coded by its smoothed training frequency among the escaped tokens, so that
probabilities over all known tokens and one unknown token sum to one.

Over these, a match predictor remembers the whole corpus: texts are cut where their tokens' hashes say so, and for each
piece the hash of the three tokens before it is the context. Where training texts have that context, one more bit says
whether the piece is one that followed it; the bit's probability is gated by how often the context occurred and learnt
from all training pieces, each judged without the document that holds it. Counts of tokens, contexts and pieces cover
all training documents and are gathered by shuffles that grow with them.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import as_bytes, cut, fold, in_batches

#: Symbols of the mixer, most tokens whose counts are broadcast (all others are joined).
SYMBOLS, KNOWN = 1024, 131_072
CONTEXTS, BLOCK, LANES, RATE, BATCH = 1024, 128, 256, 0.15, 6 << 20
#: First weights: no context, the three contexts, the document itself.
WEIGHTS = (0.1, 0.3, 0.3, 0.3, 0.1)
#: One in PIECE tokens ends a piece; tokens before a piece that are its context; occurrences of a context told apart.
PIECE, BEFORE, GATES, SEED = 24, 3, 4, 42
END = b""
_POWER = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end token."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in as_bytes(batch.column(0)):
            counts.update(tokens_of(text))
            if len(counts) > 600_000:
                yield flush()
    yield flush()


@dataclass
class Tree:
    """Huffman tree over the symbols: each symbol's path as slices of flat arrays of nodes and bits."""

    nodes: np.ndarray
    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray
    right: np.ndarray  # right[node, symbol] = 1 where the symbol's path takes the 1-branch
    under: np.ndarray

    @staticmethod
    def of(freq: np.ndarray) -> Tree:
        n = len(freq)
        heap = [(int(f), s, s) for s, f in enumerate(freq)]
        heapq.heapify(heap)
        kids: list[tuple[int, int]] = []
        while len(heap) > 1:
            fa, _, a = heapq.heappop(heap)
            fb, _, b = heapq.heappop(heap)
            kids.append((a, b))
            heapq.heappush(heap, (fa + fb, n + len(kids), n + len(kids) - 1))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        todo = [(n + len(kids) - 1, [])] if kids else []
        while todo:
            node, path = todo.pop()
            if node < n:
                paths[node] = path
            else:
                for bit in (0, 1):
                    todo.append((kids[node - n][bit], [*path, (node - n, bit)]))
        size = np.array([len(p) for p in paths], np.int64)
        right, under = np.zeros((len(kids), n), np.float32), np.zeros((len(kids), n), np.float32)
        for s, p in enumerate(paths):
            for node, bit in p:
                under[node, s] = 1
                right[node, s] = bit
        return Tree(np.array([x for p in paths for x, _ in p], np.int64), np.array([b for p in paths for _, b in p], np.int64), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size, right, under)


@dataclass
class Mixer:
    index: dict[bytes, int]  # frequent token -> place in the arrays below
    count: np.ndarray
    symbol: np.ndarray  # 0: escaped
    total: int
    kinds: int
    tree: Tree | None = None
    tables: list[np.ndarray] | None = None  # stretched predictions: no context, then the three contexts
    weights: np.ndarray | None = None
    hashes: np.ndarray | None = None  # of the tokens, by place

    def __post_init__(self):
        named = self.symbol > 0
        self.rare_total = self.total - int(self.count[named].sum())
        self.rare_kinds = self.kinds - int(named.sum())

    def look_up(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        get = self.index.get
        return [np.fromiter((get(w, -1) for w in d), np.int64, len(d)) for d in docs]

    def symbols(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.symbol[places], 0) if len(self.symbol) else np.zeros(len(places), np.int64)


def contexts(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three contexts of each symbol of a chain of documents; first: the places where documents begin."""
    n = len(sym)
    begin = np.zeros(n, bool)
    begin[first] = True
    doc = np.cumsum(begin) - 1
    prev = np.r_[0, sym[:-1]]
    prev[begin] = 1
    last = np.maximum.accumulate(np.where(sym > 0, np.arange(n), -1))  # the last frequent symbol up to here
    before = np.r_[-1, last[:-1]]
    before = np.where(before >= first[doc], before, -1)
    f1 = np.where(before >= 0, sym[before], 1)
    before2 = np.where(before > 0, np.r_[-1, last[:-1]][before], -1)
    before2 = np.where(before2 >= first[doc], before2, -1)
    f2 = np.where(before2 >= 0, sym[before2], 1)
    return prev % CONTEXTS, f1 % CONTEXTS, ((f1 * 0x9E3779B1 + f2 * 0x85EBCA77) >> 7) % CONTEXTS


def _chain(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


def _count_contexts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Mixer = shared.value
        held = np.zeros((3, CONTEXTS * SYMBOLS), np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for at in range(0, len(texts), LANES):
                places, first = _chain(m.look_up([tokens_of(t) for t in texts[at : at + LANES]]))
                sym = m.symbols(places)
                for k, c in enumerate(contexts(sym, first)):
                    held[k] += np.bincount(c * SYMBOLS + sym, minlength=held.shape[1])
        k, slot = np.nonzero(held)
        for at in range(0, len(k), 100_000):
            s = slice(at, at + 100_000)
            yield pa.record_batch([pa.array((k[s] * held.shape[1] + slot[s]).astype(np.int32)), pa.array(held[k[s], slot[s]])], names=["slot", "n"])

    return run


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p)).astype(np.float32)


def _tables(tree: Tree, slots: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Stretched bit predictions of each (context, node) from the symbol counts; no context is the prior of the others."""
    held = np.zeros(3 * CONTEXTS * SYMBOLS, np.float32)
    held[slots] = n
    held = held.reshape(3, CONTEXTS, SYMBOLS)[:, :, : tree.right.shape[1]]
    plain = held[0].sum(axis=0)
    p0 = (tree.right @ plain + 0.5) / (tree.under @ plain + 1.0)
    out = [_stretch(p0)]
    for c in held:
        out.append(_stretch((c @ tree.right.T + 4.0 * p0) / (c @ tree.under.T + 4.0)).ravel())
    return out


def _mix(m: Mixer, rows: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """log10 probabilities of each document's symbols; documents are read side by side."""
    tree, lanes = m.tree, len(rows)
    sym, first = _chain(rows)
    nodes, depth = tree.right.shape[0], weights.shape[0]
    w = np.repeat(weights[None], lanes, axis=0).reshape(lanes * depth, -1)
    score, shown = np.zeros(len(sym)), np.zeros((2, lanes * nodes), np.float32)
    ends = np.cumsum([len(r) for r in rows])[:-1]
    if not nodes:
        return np.split(score, ends)
    c1, c2, c3 = contexts(sym, first)
    sizes = np.array([len(r) for r in rows], np.int64)
    lane = np.repeat(np.arange(lanes), sizes)
    step = (np.arange(len(sym)) - first[lane]) // BLOCK
    order = np.argsort(step, kind="stable")
    stops = np.cumsum(np.bincount(step))
    for a, b in zip(np.r_[0, stops[:-1]], stops):
        t = order[a:b]
        size = tree.size[sym[t]]
        tok = np.repeat(t, size)
        inner = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
        flat = tree.start[sym[tok]] + inner
        node, bit, d = tree.nodes[flat], tree.bits[flat], lane[tok]
        own, gate = d * nodes + node, d * depth + np.minimum(inner, depth - 1)
        x = np.stack([m.tables[0][node], m.tables[1][c1[tok] * nodes + node], m.tables[2][c2[tok] * nodes + node], m.tables[3][c3[tok] * nodes + node], np.log((shown[1][own] + 0.3) / (shown[0][own] + 0.3))], axis=1)
        p = 1 / (1 + np.exp(-np.clip((x * w[gate]).sum(axis=1), -12, 12)))
        score[t] = np.bincount(np.repeat(np.arange(len(t)), size), np.log10(np.where(bit == 1, p, 1 - p)), len(t))
        err = bit - p
        seen = np.bincount(gate, minlength=len(w))
        for k in range(x.shape[1]):
            w[:, k] += RATE * np.bincount(gate, err * x[:, k], len(w)) / (seen + 16.0)
        for v in (0, 1):
            hit = own[bit == v]
            if len(hit):
                shown[v] += np.bincount(hit, minlength=shown.shape[1]).astype(np.float32)
    return np.split(score, ends)


def hash_of(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, SEED)


def cut_pieces(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the pieces of a chain of documents (first: their starts), and the pieces' contexts and hashes. A
    document's first tokens are a piece without context (0)."""
    n = len(hashes)
    into = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))  # place in the document
    begin = (into == 0) | (into == BEFORE)
    begin[1:] |= (hashes[:-1] % np.uint64(PIECE) == 0) & (into[1:] > BEFORE)
    starts = np.flatnonzero(begin)
    place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    own = np.add.reduceat(hashes * _POWER[place % len(_POWER)], starts)
    before = sum(hashes[np.maximum(starts - k, 0)] * _POWER[k] for k in range(1, BEFORE + 1))
    return starts, np.where(into[starts] == 0, np.uint64(0), before), own


def fit(train: DataFrame, known: int = KNOWN, symbols: int = SYMBOLS) -> tuple[Mixer, DataFrame]:
    """The mixer and the table (token, n) of all training tokens. train: doc_id, text.

    Only the counts of at most `known` frequent tokens (and of the end token) and the fixed-size context tables reach
    the driver, and so are broadcast; all other counts stay a distributed table.
    """
    spark = train.sparkSession
    texts = train.select(F.col("text").cast("string").alias("text"))
    counts = cut(in_batches(texts, _count, "token binary, n long", BATCH).groupBy("token").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = sums[0] // (known * 64)  # at most 64 * known tokens are more frequent
    least, room = floor + 1, known
    for r in counts.groupBy("n").count().where(F.col("n") > floor).orderBy(F.desc("n")).limit(known).collect():
        room -= r["count"]
        if room < 0:
            least = r["n"] + 1
            break
    rows = counts.where((F.col("n") >= least) | (F.col("token") == F.lit(END))).collect() if sums[1] else []
    rows.sort(key=lambda r: (bytes(r.token) != END, -r.n, bytes(r.token)))
    symbol = np.zeros(len(rows), np.int64)
    symbol[: symbols - 1] = np.arange(1, min(len(rows), symbols - 1) + 1)
    m = Mixer({bytes(r.token): k for k, r in enumerate(rows)}, np.array([r.n for r in rows], np.int64), symbol, sums[0], sums[1])
    freq = np.r_[max(1, m.rare_total), m.count[symbol > 0]]
    m.tree = Tree.of(freq)
    shared = spark.sparkContext.broadcast(m)
    got = in_batches(texts, _count_contexts(shared), "slot int, n long", BATCH).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    m.tables = _tables(m.tree, got["slot"].to_numpy(), got["n"].to_numpy())
    depth = int(m.tree.size.max()) if len(m.tree.size) else 0
    m.weights = np.tile(np.array(WEIGHTS), (max(depth, 1), 1))
    m.hashes = np.array([hash_of(t) for t in m.index], np.uint64)
    return m, counts


_TOLD = "kind int, uid long, doc_id long, train boolean, n_tokens long, n_bytes long, known long, base double, piece int, context long, hash long, own_n int, own_total int, mixed double, token binary"
_DOC, _PIECE, _TOKEN = range(3)


def _score(shared):
    """mapInArrow (uid, doc_id, train, text): a row for each document, one for each of its pieces with the probability
    of the tokens that are known here, and one for each other token of a piece, whose count has to be joined."""
    kinds = [("kind", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("piece", pa.int32()), ("context", pa.int64()), ("hash", pa.int64()), ("own_n", pa.int32()), ("own_total", pa.int32()), ("mixed", pa.float64()), ("token", pa.binary())]

    def out(kind: int, n: int, **columns) -> pa.RecordBatch:
        own = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
        return pa.record_batch([pa.array(own[name], t) if name in own else pa.nulls(n, t) for name, t in kinds], names=[name for name, _ in kinds])

    def repeats(x: np.ndarray) -> np.ndarray:
        """How often each value occurs."""
        _, where, n = np.unique(x, return_inverse=True, return_counts=True)
        return n[where].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Mixer = shared.value
        base_of = np.log10((m.count + 1) / (m.total + m.kinds + 1))
        rare_of = np.where(m.symbol > 0, 0.0, np.log10((m.count + 1) / (m.rare_total + m.rare_kinds + 1)))
        for batch in batches:
            uids, doc_id, train, texts = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), as_bytes(batch.column(3))
            for at in range(0, len(texts), LANES):
                docs = [tokens_of(t) for t in texts[at : at + LANES]]
                n = len(docs)
                places = m.look_up(docs)
                mixed = _mix(m, [m.symbols(p) for p in places], m.weights)
                known = [p[p >= 0] for p in places]
                yield out(_DOC, n, uid=uids[at : at + n], doc_id=doc_id.slice(at, n), train=train[at : at + n], n_tokens=[len(d) for d in docs], n_bytes=[len(t or b"") for t in texts[at : at + n]], known=[len(k) for k in known], base=[float(base_of[k].sum()) for k in known])
                uid, was = uids[at : at + n], train[at : at + n]
                chain, first = _chain(places)
                lane = np.repeat(np.arange(n), [len(d) for d in docs])
                seen, score = chain >= 0, np.concatenate(mixed)
                score[seen] += rare_of[chain[seen]]
                left, flat = np.flatnonzero(~seen), [t for d in docs for t in d]
                rare = [flat[k] for k in left.tolist()]
                hashes = m.hashes[np.maximum(chain, 0)] if len(m.hashes) else np.zeros(len(chain), np.uint64)
                hashes[left] = np.fromiter(map(hash_of, rare), np.uint64, len(rare))
                starts, context, own = cut_pieces(hashes, first)
                doc = lane[starts]
                head = np.r_[True, doc[1:] != doc[:-1]]
                number = np.arange(len(starts)) - np.repeat(np.flatnonzero(head), np.bincount(doc))
                context[head] = uid.astype(np.uint64)[doc[head]] * _POWER[-1] + _POWER[-2]  # nobody else's
                apart = doc.astype(np.uint64) * _POWER[-3]
                own_n = repeats(context * _POWER[0] + own + apart)
                own_n[head] = 0  # never a match
                yield out(_PIECE, len(starts), uid=uid[doc], train=was[doc], piece=number.astype(np.int32), context=context.view(np.int64), hash=own.view(np.int64), own_n=own_n, own_total=repeats(context + apart), mixed=np.add.reduceat(score, starts))
                if rare:
                    yield out(_TOKEN, len(rare), uid=uid[lane[left]], piece=number[np.searchsorted(starts, left, "right") - 1].astype(np.int32), token=rare)

    return run


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, known: int = KNOWN, symbols: int = SYMBOLS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows outside the held-out fold; a training row is scored without its own pieces. A null or empty
    text is its end token alone; without training rows every probability is 1 and both scores are 0. Repeated rows
    count as often as they occur and are each returned; further columns are ignored; bits_per_byte is null for an empty
    text.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    m, counts = fit(src.where(fold(F.col("doc_id"), folds) != held), known, symbols)
    shared = docs.sparkSession.sparkContext.broadcast(m)
    rows = src.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (fold(F.col("doc_id"), folds) != held).alias("train"), "text")
    told = cut(in_batches(rows, _score(shared), _TOLD, BATCH))
    pieces = told.where(F.col("kind") == _PIECE)
    # Contexts that occur once teach nothing about another piece, so only the others go on.
    totals = pieces.groupBy("context").agg(F.count("*").alias("every"), F.count_if(F.col("train") & (F.col("own_n") > 0)).alias("total"))
    totals = cut(totals.where("every > 1 AND total > 0").select("context", "total"))
    marked = cut(pieces.where("own_n > 0").select("uid", "piece", "train", "context", "hash", "own_n", "own_total", "mixed").join(totals, "context"), totals)
    memory = cut(marked.where("train").groupBy("context", "hash").agg(F.count("*").alias("n")))
    without = lambda n, mine: F.coalesce(F.col(n), F.lit(0)) - F.when(F.col("train"), F.col(mine)).otherwise(0)
    found = marked.join(memory, ["context", "hash"], "left").select("uid", "piece", "train", "mixed", without("n", "own_n").alias("n"), without("total", "own_total").alias("total"))
    found = cut(found.where("total > 0"), marked, memory)
    c = F.coalesce(F.col("n"), F.lit(0)) + 1
    rare = told.where(F.col("kind") == _TOKEN).select("uid", "piece", "token").join(counts, "token", "left")
    rare = rare.groupBy("uid", "piece").agg(
        F.count("n").alias("rare_known"),
        F.sum(F.log10(c / F.lit(float(m.total + m.kinds + 1)))).alias("rare_base"),
        F.sum(F.log10(c / F.lit(float(m.rare_total + m.rare_kinds + 1)))).alias("rare_score"),
    )
    rare = cut(rare)
    gate = F.least("total", F.lit(GATES)).cast("int")
    learnt = found.where("train").groupBy(gate.alias("gate")).agg(F.count("*").alias("n"), F.count_if(F.col("n") > 0).alias("hits")).collect()
    hit = {r.gate: (r.hits + 1) / (r.n + 2) for r in learnt}
    p = F.get(F.lit([hit.get(g, 0.5) for g in range(GATES + 1)]), gate)
    own = found.join(rare.select("uid", "piece", "rare_score"), ["uid", "piece"], "left").withColumn("plain", F.col("mixed") + F.coalesce("rare_score", F.lit(0.0)))
    follow, other = F.log10(p * F.col("n") / F.col("total")), F.log10(1 - p) + F.col("plain")
    high = F.greatest(follow, other)
    score = F.when(F.col("n") <= 0, other).otherwise(high + F.log10(F.pow(F.lit(10.0), follow - high) + F.pow(F.lit(10.0), other - high)))
    gained = own.groupBy("uid").agg(F.sum(score - F.col("plain")).alias("gained"))
    sums = pieces.groupBy("uid").agg(F.sum("mixed").alias("mixed"))
    rest = rare.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("rare_known", "rare_base", "rare_score")])
    sums = sums.join(rest, "uid", "left").join(gained, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = sums.select("uid", (F.col("mixed") + zero("rare_score") + zero("gained")).alias("score"), zero("rare_known").alias("rare_known"), zero("rare_base").alias("rare_base"))
    out = told.where(F.col("kind") == _DOC).select("uid", "doc_id", "train", "n_tokens", "n_bytes", "known", "base").join(sums, "uid", "left")
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
