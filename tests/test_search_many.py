"""Search for many queries against a plain loop, and what it writes on the way."""

import itertools
import math
import os
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lexical
from tesserae.plans import registry
from tesserae.sources import shared


def plain(docs, queries, limit):
    terms = {i: ["memories", "", str(i), "", kind.lower(), "", *re.findall(r"\w+", text.lower())] for i, kind, text, _ in docs}
    mean = sum(len(t) - 3 for t in terms.values()) / len(terms)
    out = set()
    for qid, query in queries:
        phrases = dict.fromkeys(p for c in query.lower().split()[:8] if (p := tuple(re.findall(r"\w+", c))))
        tf = {p: Counter({i: n for i, t in terms.items() if (n := sum(tuple(t[k : k + len(p)]) == p for k in range(len(t))))}) for p in phrases}
        score = Counter()
        for found in tf.values():
            idf = math.log((len(docs) - len(found) + 0.5) / (len(found) + 0.5))
            for i, n in found.items():
                score[i] += (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(terms[i]) - 3) / mean))
        best = sorted((-round(score[i], 6), i) for i, _, _, seen in docs if seen and i in score)[:limit]
        out |= {(qid, i, -s, k) for k, (s, i) in enumerate(best, 1)}
    return out


def made(seed, rows, asked):
    rng = random.Random(seed)
    words = ["ant", "bee", "cow", "dog", "eel", "fox", "gnu", "hen"]
    texts = [" ".join(rng.choices(words, range(1, 9), k=rng.randrange(40))) for _ in range(rows // 3)]
    docs = [(i * 7, rng.choice(["FACT", "GOAL"]), rng.choice(texts), rng.random() < 0.7) for i in range(rows)]
    forms = [*words, "ant-bee", "cow-dog-eel", "hen-hen", "memories", "goal", "21", "none", "fact-ant", "..."]
    return docs, [(q, " ".join(rng.choices(forms, k=rng.randrange(12)))) for q in range(asked)]


@pytest.mark.parametrize(("part", "shares", "apart"), [(8192, None, False), (7, 3, True)])
def test_equals_a_plain_loop(spark, part, shares, apart):
    docs, queries = made(part, 1500, 40)
    df = spark.createDataFrame(docs, "id long, type string, content string, ok boolean").repartition(5)
    asked = spark.createDataFrame(queries, "qid long, query string")
    texts = df.select("id", "type", "content") if apart else None
    got = lexical.search_many(df, asked, 20, visible=F.col("ok"), texts=texts, part=part, shares=shares).collect()
    assert {(r.qid, r.id, r.score, r["rank"]) for r in got} == plain(docs, queries, 20)
    assert len(got) == len(set(got))


def test_no_query_asks_anything(spark):
    df = spark.createDataFrame([(1, "FACT", "ant")], "id long, type string, content string")
    for queries in ([], [(1, " ... ")], [(1, None)]):
        assert lexical.search_many(df, spark.createDataFrame(queries, "qid long, query string")).collect() == []


def test_writes_no_whole_texts_and_no_row_for_each_query_and_document(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    docs = [(i, "FACT", "ant " + " ".join(uuid.UUID(int=rng.getrandbits(128)).hex for _ in range(200))) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, type string, content string")
    asked = spark.createDataFrame([(q, "ant bee") for q in range(300)], "qid long, query string")
    monkeypatch.setattr(shared, "durable", lambda _: f"file://{tmp_path}")
    assert lexical.search_many(df, asked, 2).count() == 600
    files = [os.path.join(at, f) for at, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert files
    assert sum(map(os.path.getsize, files)) < 100_000  # the texts have 2.6 MB; 120,000 pairs match


def test_retrieving_many_joins_no_texts(spark, monkeypatch):
    plans = []

    def seen(df, name, **more):
        plans.extend([df._jdf.queryExecution().optimizedPlan().toString().split("\n")] if name == "found" else [])
        return shared.written(df, name, **more)

    monkeypatch.setattr(lexical, "written", seen)
    registry.queries()["q03_retrieve_many"](spark, "/root/testdata/sf0.001")
    depth = lambda line: re.search("[A-Za-z]", line).start()
    lines = [x for x in plans[0] if re.search("[A-Za-z]", x)]
    at = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    below = list(itertools.takewhile(lambda x: depth(x) > depth(lines[at]), lines[at + 1 :]))
    assert any("text" in x for x in below)
    assert not any("Join" in x for x in below)
