"""Long chains and components against plain walks."""

import random

from tesserae.operators import graph


def test_long_supersession_chain(spark):
    ids = random.Random(6).sample(range(10_000), 200)
    rows = [(ids[0], None), *[(b, a) for a, b in zip(ids, ids[1:])], (20_001, 20_000)]
    df = spark.createDataFrame(rows, "id long, supersedes_id long")
    got = {r.position: r.id for r in graph.chain(df, ids[70]).collect()}
    assert got == dict(enumerate(ids, 1))


def test_chain_ends_where_it_repeats(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, supersedes_id long")
    assert sorted(r.id for r in graph.chain(df, 1).collect()) == [1, 2, 3]
    assert [(r.id, r.position) for r in graph.chain(df, 9).collect()] == [(9, 1)]


def test_long_components(spark):
    ids = list(range(200))
    shuffled = random.Random(7).sample(range(1000, 2000), 200)
    links = [*zip(ids, ids[1:]), *zip(shuffled, shuffled[1:])]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in ids}, **{i: min(shuffled) for i in shuffled}}
