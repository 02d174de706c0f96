"""The pipeline against the same steps done plainly, one stage at a time."""

import importlib

import numpy as np

import corpus_pipeline
from refsieve.llm import decontam, langid, pii
from refsieve.llm.queries import QUERIES

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    brute = importlib.import_module("test_operators").brute_components
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "redact_pii", "mix_sources"]
    rows = [r.asDict() for r in docs.collect()]
    model = langid.fit(docs)
    rows = [r for r in rows if not model.predict(r["text"])[2]]
    assert len(rows) >= 0.97 * docs.count()
    roots = brute([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if roots[r["doc_id"]][1] == r["doc_id"]]
    index = decontam.Index([(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [r | {"text": pii.redacted(r["text"])} for r in rows if index.scan(r["text"])[1] is None]
    want = stages["mix_sources"](spark, spark.createDataFrame(rows, docs.schema), sf)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*DOCS, "mix_topic", "mix_weight"]
    key = lambda r: (r["doc_id"], r["text"], round(r["mix_weight"], 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(np.arange(1, 11))


def test_stages_on_odd_rows_with_clashing_columns(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the words of a text without an id", "en", "a", 3), (5, "the same text " * 30, "en", "a", 1), (5, "the same text " * 30, "en", "a", 1), (6, "mail a@b.co or call +1 (366) 555-9807 " + "word " * 30, "en", "c", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({n: frame["n_chars"] for n in ("cid", "rid", "n", "tokens", "grp", "spans", "names", "held", "kept", "gone", "mix_topic", "mix_weight")})
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, frame, sf)
        assert out.columns == frame.columns, name
        assert out.count() == {"near_duplicates": 5, "decontaminate": 6, "redact_pii": 6}[name]
        assert stage(spark, frame.limit(0), sf).count() == 0
    assert "<EMAIL>" in corpus_pipeline.redact_pii(spark, frame, sf).where("doc_id = 6").first()["text"]
    mixed = corpus_pipeline.mix_sources(spark, frame, sf)
    assert mixed.columns == [*frame.columns, "mix_topic_2", "mix_weight_2"] and mixed.count() <= 6
