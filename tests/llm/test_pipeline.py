"""The pipeline against plain Python, and its stages on awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import op4_secrets, op5_toxicity, op7_pieces, op10_jaccard
from tests.llm.test_jaccard import plain_components
from tests.llm.test_mix import plain_targets


def plain_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_run_against_plain_python(spark):
    """Toxic rows by the scores, one row of each group, no base secret left, targets met, ids as the library gives them."""
    import public_tokenizers
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in op5_toxicity.op5_toxicity(spark, sf).collect()}
    clean = sorted(i for i in rows if scores[i] < op5_toxicity.THRESHOLD)
    _, label = plain_components([rows[i].text for i in clean])
    first = [i for k, i in enumerate(clean) if label[k] == k]
    texts = {i: op4_secrets.redact(rows[i].text, s) for i, s in zip(first, op4_secrets.find([rows[i].text for i in first]), strict=True)}
    got = {}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.run(spark, sf).collect():
        assert r.source == rows[r.doc_id].source and r.n_tokens == len(r.ids)
        assert list(r.ids) == model.encode(texts[r.doc_id] or "")
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert set(got) <= set(first)
    sizes, target = {}, {}
    for i in first:
        sizes.setdefault(rows[i].source, []).append(plain_words(texts[i]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    totals = [sum(sizes[s]) for s in names]
    goal = plain_targets(totals, [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))], sum(totals))
    target = dict(zip(names, goal, strict=True))
    for s in names:
        taken = sum(n * plain_words(texts[i]) for i, n in got.items() if rows[i].source == s)
        assert abs(taken - target[s]) <= max(sizes[s]), (s, taken, target[s])


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, _score double, _k int, word_ string, k1 long, row string, kept int, size int, component_key int, mentions map<string,int>"


@pytest.fixture
def awkward(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(999)}" for _ in range(50)]
    texts = [" ".join(base), " ".join(base), " ".join([*base, "more"]), " ".join(reversed(base)), "", None, "a", "key password=abcdef1234 end"]
    rows = [(i, x, "en", "s", len(x or ""), 0.5, 1, "w", 2, "r", 3, 4, 5, {"a": i}) for i, x in enumerate(texts)]
    rows += [(3, texts[0], None, None, None, None, None, None, None, None, None, None, None, None), (3, "only here " + " ".join(base[:20]), *[None] * 12), (3, "ONLY here " + " ".join(base[:20]), *[None] * 12), (None, texts[0], *[None] * 12), (None, None, *[None] * 12), (9, "b " * 200_000, *[None] * 12)]
    return spark.createDataFrame(rows, AWKWARD)


def test_rows_of_one_id_are_told_apart(spark, awkward):
    kept = op10_jaccard.first_of_groups(awkward)
    assert kept.schema == awkward.schema
    got = sorted(((r.doc_id, (r.text or "")[:9].lower()) for r in kept.collect()), key=str)
    base = awkward.where("doc_id = 0").first().text[:9]
    last = awkward.where("doc_id = 3 and _k = 1").first().text[:9]
    want = [(0, base), (3, last), (3, "only here"), (4, ""), (5, ""), (6, "a"), (7, "key passw"), (None, base), (None, ""), (9, "b b b b b")]
    assert got == sorted(want, key=str)


def test_stages_take_awkward_rows(spark, awkward, tmp_path):
    spark.createDataFrame([(0, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.redact_secrets(spark, docs, "").where("text LIKE '%abcdef1234%'").isEmpty()
    found = corpus_pipeline.encode_pieces(spark, docs, "")
    assert found.count() == docs.count() and found.where("n_tokens = 0").count() == 3
    assert found.where(F.size("ids") != F.col("n_tokens")).isEmpty()
    assert op7_pieces.encode_text(None, op7_pieces.model_bytes()) == []
