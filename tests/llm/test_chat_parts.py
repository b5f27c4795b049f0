"""Chunks of long conversations are one dialogue."""

import duckdb
import pytest

from graphloom.llm import chat, sql

from . import corpus


@pytest.mark.parametrize("part_turns", [1, 3, 4])
def test_chunks_join_to_the_whole_dialogue(spark, part_turns):
    rows = [(c, k, "system" if k == 0 else "abc"[k % 3], f"said {k} \u00e9" * (k % 3)) for c in ("x", None) for k in range(11)]
    rows += [("x", 3, "a", "tie"), ("y", 0, "a", "x"), ("y", 1, "system", "late")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    parts = chat.rotate_perspectives(turns, part_turns).collect()
    whole = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(turns).collect()}
    assert len(whole) == 7 and all(r.offset == 0 and r.first_turn == 1 for r in whole.values())
    seen = {k: ["", "", []] for k in whole}
    for r in sorted(parts, key=lambda r: r.part):
        found = seen[r.conv_id, r.perspective]
        assert (r.offset, r.first_turn - 1) == (len(found[0]), len(found[1])) and r.n_turns <= part_turns
        found[0] += r.rendered
        found[1] += r.mask
        found[2] += [s for s in r.spans.split(",") if s]
    assert all((w.rendered, w.mask, w.spans) == (a, b, ",".join(c)) for k, w in whole.items() for a, b, c in [seen[k]])


def test_a_conversation_of_over_4096_turns_equals_sql(spark):
    rows = [(1, k, "system" if k == 0 else "abc"[k % 3], f"said {k}") for k in range(9000)] + [(2, None, "a", f"t{k}") for k in range(50)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", talks.toArrow())
    found = chat.rotate_perspectives(talks).collect()
    assert {r.part for r in found} == {0, 1, 2} and corpus.same(found, con.execute(sql.OP8).fetchall())
