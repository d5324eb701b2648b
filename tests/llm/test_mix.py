"""The mix against plain Python: targets by reshared excess, Pareto order, inclusion rates."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import op2_mix


def plain_targets(sizes, weights, budget, most=3.0):
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(budget)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def plain_mix(rows, weights=(5.0, 2.0, 1.0)):
    """{doc_id: (target, copies)} of rows (doc_id, text, source)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i, _, s in rows if s == n) for n in names]
    out = {}
    for n, s, t in zip(names, total, plain_targets(total, [weights[k % 3] for k in range(len(names))], sum(total)), strict=True):
        own = [i for i, _, x in rows if x == n]
        whole = int(t / s + 1e-9) if s else 0
        rest, w = t - whole * s, {i: math.log2(2 + size[i]) for i in own}
        factor = 0.0
        while rest > 0:
            sure = [i for i in own if w[i] * factor >= 1]
            free = sum(w[i] * size[i] for i in own if i not in sure)
            new = max(factor, (rest - sum(size[i] for i in sure)) / free) if free else factor
            if new <= factor * (1 + 1e-9):
                break
            factor = new

        def rank(i):
            u = (int(hashlib.md5(f"{op2_mix.SEED}|{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(1.0, w[i] * factor)
            return 0.0 if p >= 1 else math.inf if p <= 0 else u / (1 - u) / (p / (1 - p))

        taken, copies = 0, dict.fromkeys(own, whole)
        if rest > 0.5:
            for i in sorted(own, key=lambda i: (rank(i), i)):
                if taken >= rest or taken + size[i] - size[i] / 2 > rest:
                    break
                copies[i] += 1
                taken += size[i]
        out |= {i: (t, c) for i, c in copies.items()}
    return size, out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_mix(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    size, want = plain_mix(rows)
    got = {r.doc_id: r for r in op2_mix.op2_mix(spark, f"/root/testdata/{sf}").collect()}
    assert set(got) == set(want)
    for i, (target, copies) in want.items():
        assert got[i].target == pytest.approx(target) and got[i].size == size[i]
        assert got[i].taken <= 3 * size[i]
    off = [i for i in want if got[i].copies != want[i][1]]
    assert not off, (len(off), off[:5])


def test_many_sources_and_ties(spark):
    df = spark.range(900).selectExpr("id % 450 AS doc_id", "concat('http://x/', id % 300) AS source", "repeat('w ', cast(id % 7 as int)) AS text")
    got = op2_mix.mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("source_size").alias("n")).collect()
    rows = {r.source: r for r in got}
    names = sorted(rows)
    want = plain_targets([rows[n].n for n in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))], sum(r.n for r in got))
    for n, t in zip(names, want, strict=True):
        assert rows[n].target == pytest.approx(t) and abs(rows[n].taken - t) <= max(1, rows[n].most)


def test_inclusion_rates_follow_the_weights(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source", "'one two' AS text", "CASE WHEN id % 8 < 2 THEN 3.0D ELSE 1.0D END AS weight")
    got = op2_mix.mix(df, weights=(1.0, 3.0), share=0.6, weight=F.col("weight"), keep=("weight",)).groupBy("source", "kept.weight").agg(F.avg("copies").alias("rate")).collect()
    rate = {(r.source, r.weight): r.rate for r in got}
    # a: 0.3 of its words, p = 0.2 w; b: 0.9 of them, so weight 3 is certain and 1 has (0.9 - 0.25) / 0.75
    assert rate["a", 3.0] == pytest.approx(0.6, abs=0.02) and rate["a", 1.0] == pytest.approx(0.2, abs=0.02)
    assert rate["b", 3.0] == 1.0 and rate["b", 1.0] == pytest.approx(0.65 / 0.75, abs=0.02)
