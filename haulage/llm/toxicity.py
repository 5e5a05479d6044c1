"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration.

Words and word beginnings get log-odds between toxic and clean labelled documents under an informative Dirichlet
prior; those that are significant score their log-likelihood ratio, every other word a small negative drift. A
linear-time scan finds all maximal-scoring segments of a text. Segment scores are normalised by the Karlin-Altschul
extreme-value law of the clean words (decay rate and text length), and a logistic curve fitted on the labelled sample
turns the normalised scores of a text's segments into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import as_bytes, fold, in_batches, pieces
from haulage.llm.decontaminate import words_of

#: Bound of the labelled sample (rows with the smallest hash of their id); the model's tokens are bounded by it.
SAMPLE_ROWS = 20_000
STARTS = range(3, 9)
#: Least z-score, log-odds and number of toxic documents of a token (among a million tokens chance alone gives many
#: of 2.5); weight of the prior in documents of each class.
MIN_Z, MIN_ODDS, MIN_TOXIC, PRIOR_DOCS = 4.0, 2.0, 3, 50.0
#: Entries a worker holds: remembered words, and counted features before they are passed on.
MEMO, KEPT_FEATURES = 50_000, 100_000


def features(word: bytes) -> list[str]:
    """The word itself (with an end sign) and its beginnings."""
    w = word.decode("utf-8", "replace")
    return [w + "$", *{w[:k] for k in STARTS if k <= len(w)}]


@dataclass
class Model:
    score: dict[str, float]
    drift: float = -0.2
    decay: float = 1.0
    curve: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.0, 0.0])
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)

    def of(self, word: bytes) -> float:
        """A word's score: of its significant features the highest, else the drift."""
        s = self.memo.get(word)
        if s is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            s = self.memo[word] = max((self.score[f] for f in features(word) if f in self.score), default=self.drift)
        return s

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (start, end, score), by one scan with merging of neighbours."""
        memo = self.memo
        scores = [memo[w] if w in memo else self.of(w) for w in words]
        stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
        total, last = 0.0, 0
        for i, s in enumerate(scores):
            if s <= 0:
                continue
            before = total + (i - last) * self.drift
            total, last = before + s, i + 1
            start, low, high = i, before, total
            while True:
                k = len(stack) - 1
                while k >= 0 and stack[k][2] >= low:
                    k -= 1
                if k < 0 or stack[k][3] >= high:
                    stack.append((start, i + 1, low, high))
                    break
                start, low = stack[k][0], stack[k][2]
                del stack[k:]
        return [(a, b, high - low) for a, b, low, high in stack]

    def inputs(self, n_words: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        """Best normalised segment score, sum of the normalised scores that stand out, log length."""
        n = math.log(max(n_words, 1))
        best, total = -n, 0.0
        for _, _, s in segments:
            norm = self.decay * s - n
            best = max(best, norm)
            total += max(0.0, self.decay * s - 1.0)
        return best, math.log1p(total), n

    def probability(self, n_words: int, segments: list[tuple[int, int, float]]) -> float:
        c = self.curve
        x = self.inputs(n_words, segments)
        z = c[0] + c[1] * x[0] + c[2] * x[1] + c[3] * x[2]
        return 1 / (1 + math.exp(-min(max(z, -700), 700)))

    def judge(self, text: bytes | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Probability, number of words and segments of a text, by one scan."""
        words = words_of(text)
        found = self.segments(words)
        return self.probability(len(words), found), len(words), found


def _sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows: int) -> DataFrame:
    """Texts and labels of at most `rows` labelled documents outside the held-out fold."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    own = own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    own = own.orderBy("_h", "doc_id").limit(rows).select("doc_id", "toxic")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select("text", "toxic")


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in pieces(batches):
        for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            counts[bool(toxic)].update({f for w in set(words_of(text)) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > KEPT_FEATURES:
                yield _flush(counts)
    yield _flush(counts)


def _flush(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    keys = list({**counts[0], **counts[1]})
    out = pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])
    counts[0].clear()
    counts[1].clear()
    return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled documents outside the held-out fold; only doc_id and toxic of labels are read.

    The sample has a fixed bound, and so have the tokens that at least MIN_TOXIC of its documents hold and that are
    significant; all of them make the model. Without labels of both kinds the model
    has no tokens and calls every text clean.
    """
    sample = _sample(docs, labels, folds, held, sample_rows)
    counts = in_batches(sample, _count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    sizes = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_t, n_c = float(sizes[0]), float(sizes[1] - sizes[0])
    if not n_t or not n_c:
        return Model({})
    share = (F.col("t") + F.col("c")) / (n_t + n_c)
    a = share * PRIOR_DOCS
    odds = lambda y, n: F.log((F.col(y) + a) / (n + PRIOR_DOCS))
    delta = odds("t", n_t) - odds("c", n_c)
    z = delta / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    best = counts.where(F.col("t") >= MIN_TOXIC).select("feature", delta.alias("delta"), z.alias("z")).where((F.col("z") >= MIN_Z) & (F.col("delta") >= MIN_ODDS))
    rows = best.collect()
    model = Model({r.feature: float(r.delta) for r in rows})
    return calibrate(sample, model)


def calibrate(sample: DataFrame, model: Model) -> Model:
    """Decay rate from the clean words' scores, then the logistic curve from the sample's inputs (both bounded)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist: Counter = Counter()
        for batch in pieces(batches):
            for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                if not toxic:
                    hist.update(round(model.of(w), 1) for w in words_of(text))
        yield pa.record_batch([pa.array(list(hist.keys()), pa.float64()), pa.array(list(hist.values()), pa.int64())], names=["score", "n"])

    hist = in_batches(sample, scan, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.decay = _decay(np.array([r.score for r in hist], float), np.array([r.n for r in hist], float))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [model.inputs(len(w), model.segments(w)) for w in map(words_of, as_bytes(batch.column(0)))]
            yield pa.record_batch([pa.array([v[k] for v in x], pa.float64()) for k in range(3)] + [batch.column(1)], names=["a", "b", "c", "toxic"])

    rows = np.array(in_batches(sample, measure, "a double, b double, c double, toxic int").collect(), float).reshape(-1, 4)
    model.curve = _logistic(rows[:, :3], rows[:, 3])
    model.memo = {}
    return model


def _decay(scores: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * score)) = 1; 1 where there is none below 5."""
    if not len(scores) or scores.max() <= 0 or (scores * n).sum() >= 0:
        return 1.0
    p, low, high = n / n.sum(), 1e-3, 5.0
    f = lambda r: float((p * np.exp(r * scores)).sum()) - 1
    if f(high) < 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights (constant first) by damped Newton steps with a small ridge."""
    x = np.c_[np.ones(len(x)), x]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w[1:] ** 2).sum())

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        pull = ridge * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(len(w) - 1, ridge)])
        step, size, now = np.linalg.solve(h, x.T @ (y - p) - pull), 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, segments (word positions and scores).

    Null, empty and wordless texts get the score of a text without segments; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches):
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            p, segs = np.zeros(batch.num_rows), []
            for i, text in enumerate(as_bytes(batch.column(1))):  # the words of one text at a time
                p[i], size, found = m.judge(text)
                n = math.log(max(size, 1))
                segs.append([{"start": a, "end": b, "score": s} for a, b, s in found if m.decay * s > n])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(segs, kind)], names=["doc_id", "held_out", "score", "predicted", "segments"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    return in_batches(src, run, "doc_id long, held_out boolean, score double, predicted int, segments array<struct<start:long,end:long,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs whose score is below the threshold, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches):
            yield batch.filter(pa.array([m.judge(t)[0] < threshold for t in as_bytes(batch.column(place))], pa.bool_()))

    return in_batches(docs, run, docs.schema)
