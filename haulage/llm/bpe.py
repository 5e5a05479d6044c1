"""BPE encoding and decoding with a public tokenizer file, by tree concatenation.

A long text is cut into halves, and these again, wherever that falls; the leaves are encoded in one parallel batch, and
neighbours are joined as a tree: a window of runs around each join is encoded again and grows until its first run
agrees with the left side and its last one with the right side. The tokenizer never merges across ASCII white space,
so runs between white space are encoded once and remembered. A long run without white space is cut into leaves and
joined in the same way by its tokens. Neighbouring tokens of the spliced sequence then all occur side by side in one of
three exact encodings, which makes it the exact encoding.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulage.llm.common import as_bytes, in_batches

#: Bytes of a leaf of a run and of a text, characters of the first window of a run, runs that a worker remembers.
LEAF, TEXT_LEAF, FIRST_WINDOW, KEPT_RUNS = 2048, 8192, 64, 100_000
_SPACES = frozenset(b"\t\n\x0b\x0c\r ")
_SPACE = re.compile(rb"[\t\n\x0b\x0c\r ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _inert(c: str) -> bool:
    """Characters that never compose with the one before them, so a cut before them is safe for NFC."""
    o = ord(c)
    return o < 0x300 or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0x3041 <= o <= 0x3096 or 0x1F300 <= o <= 0x1FAFF


class Coder:
    """Encodes and decodes whole texts exactly as the tokenizer does; remembers short runs within a memory bound."""

    def __init__(self, path: str, leaf: int = LEAF, text_leaf: int = TEXT_LEAF):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.text_leaf = leaf, text_leaf
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.reach = max(map(len, self.specials), default=1)
        self.vocab = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        self.joined = self.tok.decoder is None  # without a decoder, decoding joins the tokens with spaces
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.older: dict[bytes, tuple[bytes, str]] = {}
        self.long: dict[bytes, tuple[bytes, str]] = {}  # of the texts at hand

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        out = []
        for e in self.tok.encode_batch(texts, add_special_tokens=False):
            out.append([(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)])
        return out

    def _cuts(self, run: str) -> list[int]:
        """Places to cut a run: near each multiple of a leaf, before an inert character, away from special tokens."""
        cuts, at = [0], self.leaf
        while at < len(run):
            near = run[max(0, at - self.reach) : at + self.reach]
            if _inert(run[at]) and not any(s in near for s in self.specials):
                cuts.append(at)
                at += self.leaf
            else:
                at += 1
        return [*cuts, len(run)]

    def run_spans(self, run: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of a run's tokens, by tree concatenation."""
        cuts = self._cuts(run)
        parts = [(a, b, [(i, a + s, a + e) for i, s, e in t]) for a, b, t in zip(cuts, cuts[1:], self._spans([run[a:b] for a, b in zip(cuts, cuts[1:])]))]
        while len(parts) > 1:
            joined = [self._join(run, x, y) for x, y in zip(parts[::2], parts[1::2])]
            parts = joined + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0][2] if parts else []

    def _join(self, run: str, x: tuple, y: tuple) -> tuple:
        (a, mid, left), (_, b, right) = x, y
        width = FIRST_WINDOW
        while True:
            lo, hi = max(a, mid - width), min(b, mid + width)
            # the window starts and ends at token ends of the sides, so that they can agree at all
            lo = next((s for _, s, _ in reversed(left) if s <= lo), a)
            hi = next((e for _, _, e in right if e >= hi), b)
            if lo == a and hi == b:
                return a, b, [(i, a + s, a + e) for i, s, e in self._spans([run[a:b]])[0]]
            window = [(i, lo + s, lo + e) for i, s, e in self._spans([run[lo:hi]])[0]]
            before, after = {t: k for k, t in enumerate(left)}, {t: k for k, t in enumerate(right)}
            half = max(1, len(window) // 2)
            i = next((k for k, t in enumerate(window[:half]) if t in before and t[2] <= mid), None) if lo > a else -1
            j = next((k for k in range(len(window) - 1, half - 1, -1) if window[k] in after and window[k][1] >= mid), None) if hi < b else len(window)
            # a token at the very edge has seen no text beyond it: agreement needs a second equal token further in
            if i is not None and j is not None:
                ok_l = lo == a or (i + 1 < len(window) and window[i + 1] in before and before[window[i + 1]] == before[window[i]] + 1)
                ok_r = hi == b or (j > 0 and window[j - 1] in after and after[window[j - 1]] == after[window[j]] - 1)
                if ok_l and ok_r and (lo == a or hi == b or i + 1 <= j - 1):
                    head = left[: before[window[i]]] if lo > a else []
                    tail = right[after[window[j]] + 1 :] if hi < b else []
                    return a, b, head + window[max(i, 0) : j + 1] + tail
            width *= 2

    def encode(self, text: str) -> list[int]:
        """Ids of one text; see ids() for the remembering form."""
        return np.frombuffer(b"".join(p for p, _ in self.pieces([text.encode()])[0]), "<u4").tolist()

    def pieces(self, texts: list[bytes]) -> list[list[tuple[bytes, str]]]:
        """For each text, (ids as little-endian words, decoded text) of its runs in order."""
        if len(self.known) > KEPT_RUNS:  # what is not met again while as many are learnt is forgotten
            self.known, self.older = {}, self.known
        self.long.clear()
        trees = [self._leaves(t) for t in texts]
        split = [[leaf.split() for leaf in tree] for tree in trees]
        self._learn(set().union(*(runs for leaves in split for runs in leaves)))
        out = []
        for tree, leaves in zip(trees, split):
            nodes = [(runs, self._coded(runs)) for runs in leaves]
            glued = [a[-1] not in _SPACES and b[0] not in _SPACES for a, b in zip(tree, tree[1:])]
            while len(nodes) > 1:
                odd = [nodes[-1]] if len(nodes) % 2 else []
                nodes = [self._join_runs(x, y, g) for x, y, g in zip(nodes[::2], nodes[1::2], glued[::2])] + odd
                glued = glued[1::2]
            out.append(nodes[0][1] if nodes else [])
        return out

    def _leaves(self, text: bytes) -> list[bytes]:
        """The text halved again and again; a run longer than a leaf of runs is not cut here."""
        if len(text) <= self.text_leaf:
            return [text] if text else []
        at = len(text) // 2
        while at < len(text) and text[at] & 0xC0 == 0x80:  # between characters
            at += 1
        if not _SPACE.search(text, at, at + self.leaf):
            space = _SPACE.search(text, at)
            at = space.start() if space else len(text)
        return [text] if at >= len(text) else self._leaves(text[:at]) + self._leaves(text[at:])

    def _learn(self, runs: set[bytes]) -> None:
        known, older, new = self.known, self.older, []
        for r in runs.difference(known, self.long):
            if r in older:
                known[r] = older[r]
            else:
                new.append(r)
        plain = [r for r in new if len(r) <= self.leaf]
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            for r, ids in zip(some, self._ids([r.decode() for r in some])):
                known[r] = (np.array(ids, "<u4").tobytes(), self._decode(ids))
        for r in new:
            if len(r) > self.leaf:
                ids = [i for i, _, _ in self.run_spans(r.decode())]
                self.long[r] = (np.array(ids, "<u4").tobytes(), self._decode(ids))

    def _coded(self, runs: list[bytes]) -> list[tuple[bytes, str]]:
        known = self.known
        return [known[r] for r in runs] if not self.long else [known.get(r) or self.long[r] for r in runs]

    def _join_runs(self, left: tuple, right: tuple, glued: bool) -> tuple[list[bytes], list[tuple[bytes, str]]]:
        """Runs and codes of two neighbours; glued: the cut between them has no white space at either side."""
        (a, coded_a), (b, coded_b), width = left, right, 2
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            runs = (b" ".join(a[i:]) + (b"" if glued else b" ") + b" ".join(b[:j])).split()
            self._learn(set(runs))
            window = self._coded(runs)
            ok_a = i == 0 or (runs[0] == a[i] and window[0] == coded_a[i])
            ok_b = j == len(b) or (runs[-1] == b[j - 1] and window[-1] == coded_b[j - 1])
            if ok_a and ok_b:
                return a[:i] + runs + b[j:], coded_a[:i] + window + coded_b[j:]
            width *= 2

    def _decode(self, ids: list[int]) -> str:
        if self.joined:
            vocab = self.vocab
            return " ".join([vocab[i] for i in ids])
        return self.tok.decode(ids, skip_special_tokens=False)

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder for each worker process and file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _groups(texts: list[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
    """Texts in lists of about `most` bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_texts(docs: DataFrame, path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (if asked for), decoded, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and decodes to the empty text. The tokenizer's file must be at `path` on
    every machine (or shipped there). Repeated rows give repeated results; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            ids, at = batch.column(0), 0
            for some in _groups([t or b"" for t in as_bytes(batch.column(1))]):
                n, raw, text = [], [], []
                for runs in own.pieces(some):
                    raw.append(b"".join([p for p, _ in runs]))
                    text.append(" ".join([d for p, d in runs if p]).encode())
                    n.append(len(raw[-1]) // 4)
                cols = [ids.slice(at, len(some)), pa.array(n, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([hashlib.sha256(t).hexdigest() for t in text])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat)), pa.array([t.decode() for t in text])]
                    names += ["ids", "decoded"]
                yield pa.record_batch(cols, names=names)
                at += len(some)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
