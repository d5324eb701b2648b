"""The Jaccard join against plain Python sets of plain strings."""

import random
import re

import pytest

from tesserae.llm import common, op10_jaccard


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    """For each index the least index reachable by links."""
    found = [plain_set(x) for x in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted((i for i, s in enumerate(found) if s), key=lambda i: len(found[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if 4 * len(found[j]) > 5 * len(found[i]):
                break
            if top(i) != top(j):
                both = len(found[i] & found[j])
                if 100 * both >= 80 * (len(found[i]) + len(found[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    label[b] = a
    return [len(s) for s in found], [top(i) for i in range(len(texts))]


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(900)) if rng.random() < share else w for w in words]


def hard_texts():
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base, passage, texts = fresh(160), fresh(60), []
    texts += [" ".join(base)] * 60  # exact copies
    texts += [" ".join(edited(rng, base, rng.choice([0.004, 0.01, 0.02, 0.04]))) for _ in range(260)]  # near copies, some too far
    texts += [" ".join(base[: rng.randrange(100, 160)]) for _ in range(60)]
    texts += [" ".join(fresh(rng.randrange(5, 120)) + passage + fresh(rng.randrange(5, 120))) for _ in range(120)]
    texts += [" ".join(passage[rng.randrange(8) :] + fresh(rng.randrange(0, 12))) for _ in range(120)]
    small = fresh(24)
    texts += [" ".join(small[a:b]) for a in range(4) for b in range(a + 1, 25)]
    texts += [" ".join(edited(rng, small, 0.03)) for _ in range(80)]
    texts += ["  \n", "", None, "x " * 700, "x " * 900, "A b C", "a B  c", "é Ａ b"]
    chain = fresh(90)
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 30, 2)]  # each links with the next, not with all
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [None, 0, 12])
def test_hard_groups(spark, small, tmp_path):
    texts = hard_texts()
    sizes, want = plain_components(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs")).repartition(9)
    got = {r.doc_id: r for r in op10_jaccard.classes(df, small).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sizes, want = plain_components([r.text for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_jaccard.op10_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: (n, rows[c].doc_id) for r, n, c in zip(rows, sizes, want, strict=True)}


def test_one_id_with_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b + " more"), (None, a), (9, c), (9, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op10_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 56, 1), (5, 56, 1), (5, 56, 5), (5, 56, 5), (7, 57, 5), (None, 56, None), (9, 56, 9), (9, 0, 9), (None, 0, None)], key=str)


def test_ids_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "IDS_MOST", 3)
    monkeypatch.setattr(common, "BITMAP", 8)
    df = spark.range(3000).selectExpr("id AS doc_id", "id AS word_", "id AS place_")
    ids = spark.range(0, 3000, 7).selectExpr("id AS doc_id")
    assert sorted(r.doc_id for r in common.picked(df, ids).collect()) == list(range(0, 3000, 7))
    rest = common.without(df, ids)
    assert rest.columns == df.columns and sorted(r.place_ for r in rest.collect()) == [i for i in range(3000) if i % 7]
