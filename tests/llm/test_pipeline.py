"""The pipeline against plain versions of its stages."""

import re

import sentencepiece
from test_operators import lowered, plain_components

import corpus_pipeline
from tallyboard.llm import pieces, pii, subword

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = subword.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in subword.score(docs, model).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    kept = {c for _, _, c in plain_components(rows)}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = ALNUM.findall(lowered(r.text))
        n = min(10, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def leaks(text):
        words = ALNUM.findall(lowered(text))
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    rows = [(i, t) for i, t in rows if i in kept and not leaks(t)]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    masks = pii.train(left)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    want = {
        i: library.encode(pii.masked(t, spans)) for (i, t), (_, spans) in zip(rows, pii.all_spans([t for _, t in rows], masks))
    }
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
