"""Each stage of the pipeline against a plain version on the stage's own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigauge.llm import toxicity
from lexigauge.session import materialize

from .test_decontaminate import plain as plain_contained
from .test_line_dedup import plain as plain_lines
from .test_simhash import plain_components


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "Only short.", "en", "s", 11), (9003, "Only short.", "en", "s", 11)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns

    def step(name, df):
        out = materialize(stages[name](spark, df, sf_dir), "step")
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], out

    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).filter("score < 0.5").collect()}
    rows, out = step("toxicity", docs)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows if i in clean) and out.columns == columns

    rows, out2 = step("line dedup", out)
    got = out2.collect()
    # rows that repeat are one document
    assert {(r.doc_id, r.text) for r in got} == {(i, t) for i, t, *_ in plain_lines(set(rows))} and len(got) == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and out2.columns == columns

    rows, out3 = step("SimHash near-dedup", out2)
    assert sorted(r.doc_id for r in out3.collect()) == sorted({c for _, _, c in plain_components(rows)}) and out3.columns == columns

    rows, out4 = step("benchmark decontamination", out3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, *_ in plain_contained(rows, items)}
    assert sorted(r.doc_id for r in out4.collect()) == sorted(i for i, _ in rows if i not in bad) and out4.columns == columns

    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, out5 = step("BPE encoding and decoding", out4)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.ids for r in out5.collect()} == want
    assert out5.agg(F.sum("n_tokens")).first()[0] == sum(map(len, want.values()))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
