"""What the pipeline's stages leave in Python workers, and how much they send them at once."""

import corpus_pipeline
import pyarrow as pa

from tesserae.llm import op7_pieces, spm


def test_last_stage_leaves_no_caches_in_workers(spark):
    docs = spark.createDataFrame([(i, "s", f"some words {i} and others") for i in range(64)], "doc_id long, source string, text string").repartition(4)
    rows = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    raw = op7_pieces.model_bytes()
    assert {r.doc_id: r.ids for r in rows} == {i: op7_pieces.encode_text(f"some words {i} and others", raw) for i in range(64)}

    def left(batches):
        for _ in batches:
            model, cache = spm.load(raw)
            yield pa.RecordBatch.from_pydict({"n": [len(cache) + len(model._pairs)]})

    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n long").collect()} == {0}


def test_stages_bound_batches_of_rows_that_are_computed_later(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, "s", "x" * 1_000_000, 1_000_000) for i in range(40)], "doc_id long, source string, text string, n_chars long").repartition(1)
    try:
        for most, bound in (("64m", 8 << 20), ("4m", 4 << 20)):
            spark.conf.set(key, most)
            corpus_pipeline.redact_secrets(spark, docs, "")
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
            assert sum(r.n for r in sizes) >= 40_000_000
            assert max(r.n for r in sizes) <= bound + 2_000_000
    finally:
        spark.conf.set(key, before)
