import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from haulage.llm import bpe

PATH = bpe.default_tokenizer()
TOK = Tokenizer.from_file(PATH)


def want(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_whole_table_against_the_library(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode_texts(docs, PATH, with_ids=False).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])


def test_tree_concatenation_of_unsplit_text():
    rng = random.Random(5)
    alphabets = ["abcdefghij", "ab'st!?0123", "éàüñabc'", "日本語漢字abc", "éàbc", "...!!!'re'll", "<|endoftext|>ab", " ab c", "ΣσςAΑ", "가각힣ab"]
    for leaf in (16, 64, 257):
        own = bpe.Coder(PATH, leaf=leaf)
        for letters in alphabets:
            for n in (1, 15, 16, 17, 300, 3000):
                text = "".join(rng.choice(letters) for _ in range(n))
                assert own.encode(text) == TOK.encode(text, add_special_tokens=False).ids, (leaf, letters, n)
        for words in (["<|endoftext|>", "don't", "we'll", "x"], ["ing", "tion", "the", "'s", "!"]):
            text = "".join(rng.choice(words) for _ in range(500))
            assert own.encode(text) == TOK.encode(text, add_special_tokens=False).ids
        text = "a" * 5000
        assert own.encode(text) == TOK.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    texts = [None, "", "  \n", "Hello World", "Hello World", "x" * 150_000, "<|endoftext|> a<|startoftext|>b", "a b　c"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.encode_texts(df, PATH).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want(t)
        assert got[i].decoded == TOK.decode(got[i].ids, skip_special_tokens=False)
    assert bpe.encode_texts(df.where("false"), PATH).count() == 0


def test_tree_concatenation_of_long_texts():
    """Texts cut anywhere into small leaves, also within words, special tokens and characters of several bytes."""
    rng = random.Random(9)
    words = ["the", "don't", "<|endoftext|>", "日本語", "é" * 9, "a" * 70, "naïve", "x1y2", ",", "'ll", "Ünïcödé", "été"]
    for leaf, text_leaf in ((16, 24), (64, 100), (2048, 8192)):
        own = bpe.Coder(PATH, leaf=leaf, text_leaf=text_leaf)
        for n in (0, 1, 30, 400, 5000):
            text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n", "  ", "\t "]) for _ in range(n))
            assert own.encode(text) == TOK.encode(text, add_special_tokens=False).ids, (leaf, n)


def test_long_texts_reach_the_tree(spark, sf001, monkeypatch):
    joins = []
    own = bpe.Coder(PATH)
    monkeypatch.setattr(own, "_join_runs", lambda *a, f=own._join_runs: (joins.append(1), f(*a))[1])
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf001}/documents.parquet").where("length(text) > 20000").collect()]
    own.pieces(texts)
    assert texts and len(joins) >= 2 * len(texts)
