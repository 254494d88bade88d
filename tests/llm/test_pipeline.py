"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import corpus_pipeline
from paneloom.llm import quality

from .test_operators import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, SF).cache()
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)
    rows = [tuple(r) for r in kept.collect()]
    single = stages[1](spark, kept, SF).cache()
    assert single.columns == columns
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in brute_components(rows, 5, 80, 100).values()}
    rows = [tuple(r) for r in single.collect()]
    clean = stages[2](spark, single, SF).cache()
    assert clean.columns == columns
    want = {i: n - gone for i, (n, gone, _) in brute_repeats(rows, 50).items() if not gone or n > gone}
    assert {r["doc_id"]: len(r["text"].split()) for r in clean.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = stages[3](spark, clean, SF)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} <= set(want)
    packed = stages[4](spark, mixed, SF)
    assert packed.count() >= mixed.count() and quality.THRESHOLD == 0.5
