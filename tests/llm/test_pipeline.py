"""The pipeline's stages, each against brute force on what the one before it kept."""

import importlib.util

import pytest
from test_ann_mixing_lines import brute_lines
from test_bpe import want
from test_decontaminate import brute as brute_hits
from test_simhash import brute as brute_groups
from test_simhash import plain_fingerprint

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def test_stages(spark, small):
    import corpus_pipeline

    from haulage.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{small}/benchmark.parquet").collect()
    now = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in queries.op7_toxicity(spark, small).collect() if r.predicted}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        got = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            expected = {d: t for d, t in now.items() if d not in bad}
        elif name == "line_dedup":
            gone, _ = brute_lines(now.items())
            expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in now.items()}
        elif name == "simhash":
            group = brute_groups({d: plain_fingerprint(t) for d, t in now.items()})
            expected = {d: t for d, t in now.items() if group[d] == d}
        else:
            hits = brute_hits(now.items(), [(r.item_id, r.text) for r in bench])
            kept = {d for d, n, hit, *_ in hits if 2 * hit <= n}
            assert got.keys() == kept and all(got[d] == now[d] for d, _, hit, *_ in hits if not hit)
            expected = got
        assert got == expected, name
        now = got
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == {d: want(t) for d, t in now.items()}


def test_stages_on_odd_rows(spark, small):
    """Null, empty, repeated and long texts, null and clashing ids, and no rows at all, through every stage."""
    import corpus_pipeline

    long = "\n".join(f"line {k} of a long text that nobody else has written before, number {k * k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, long), (4, "twice the same row\nand a second line"), (4, "twice the same row\nand a second line"), (5, "one id"), (5, "with two different texts"), (None, "no id at all"), (6, "ONE ID"), (7, "  \t ")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in rows], kind)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        got = out.collect()
        assert out.columns == docs.columns and stage(spark, empty, small).count() == 0
        docs = spark.createDataFrame(got, docs.schema)
        ids = sorted(str(r.doc_id) for r in got)
        if name == "simhash":  # of the texts without words the first stays, which is the null text of id 1
            assert ids == ["1", "3", "4", "4", "5", "5", "None"]
        elif name != "decontamination":
            assert ids == sorted(str(d) for d, _ in rows)
            if name == "line_dedup":
                assert [r.text for r in got if r.doc_id == 6] == [""] and [r.text for r in got if r.doc_id == 1] == [None]
                assert [r.text for r in got if r.doc_id == 4] == [rows[3][1]] * 2
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sorted(str(r.doc_id) for r in coded) == ["1", "3", "4", "4", "5", "5", "None"]
    assert [r.decoded for r in coded if r.doc_id == 5] != [] and [r.n_tokens for r in coded if r.doc_id == 1] == [0]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, small).count() == 0
