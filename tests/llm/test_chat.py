"""Quotation linking on the given conversations, with nested quotations of their own turns put in."""

import duckdb
import pytest

from tesserae.llm import op6_chat


def quoting(rows):
    """Each turn also quotes the one before it, which quotes the one before that, and some add a line to a quotation."""
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    out = []
    for conv, turns in by.items():
        said = []
        for k, r in enumerate(sorted(turns, key=lambda r: (r.turn is None, r.turn))):
            text = r.text or ""
            if k and k % 4 != 3:
                before = said[-1].split("\n")
                marked = [f"{'>' if k % 2 else '> '}{x}" for x in before]
                lead = ["On Monday Ann wrote:"] if k % 3 == 0 else []
                more = ["> not said before"] if k % 5 == 0 else []
                text = "\n".join([*lead, *marked, *more, text])
            said.append(text)
            out.append((conv, r.turn, r.role, text))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_nested_quotations_of_real_turns(spark, sf):
    rows = quoting(spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.execute(op6_chat.ORACLE)
    columns = [c[0] for c in want.description]
    got = op6_chat.format_chat(df).collect()
    assert sum(r.n_linked > 0 for r in got) > len(rows) / 3 and max(r.depth for r in got) > 2
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(map(str, want.fetchall()))


def test_many_short_passages_in_one_message(spark):
    text = "\n".join(f"{'> ' * (i % 3)}line {i}" for i in range(30_000))
    df = spark.createDataFrame([(1, 0, "user", "line 1"), (1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    rows = {r.turn: r for r in op6_chat.format_chat(df).collect()}
    assert rows[1].n_quotes == 20_000 and rows[1].parent_turn == 0
