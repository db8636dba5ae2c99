"""The pipeline against the plain versions of its stages."""

from . import brute
import corpus_pipeline
from convq.llm import pii, toxicity
from .test_decontaminate import plain

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "mixing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    harmless = {d: t for d, t in texts.items() if model.score(*toxicity.hits(t, model.machine)) < 0.5}
    assert len(harmless) < len(texts)
    prints = [(d, brute.fingerprint(t)) for d, t in harmless.items()]
    kept = {c for c in brute.components(prints)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {d for d, *_, bad in plain([(d, harmless[d]) for d in kept], items) if not bad}

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF_DIR)
        assert out.columns == columns, name
    assert {r["doc_id"] for r in out.collect()} == clean

    result = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(clean)
    for r in result:
        assert r["text"] is not None and not [x for x in brute.base_pii(r["text"]) if not x.startswith("card")]
        if not brute.base_pii(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]] or pii.candidates(texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
