"""Quotation links and reply order against plain Python, on planted conversations."""

import random

import pytest

from sievelake.llm import quotations

SCHEMA = "conv_id bigint, turn {}, role string, text string, position string, `run` int"


def plain_order(rows):
    """rows: {(conv, position): (parent_conv, parent_position, linked)} -> {(conv, position): (level, order)}."""
    level, out = {}, {}
    for conv in {c for c, _ in rows}:
        last = 0
        for pos in sorted(p for c, p in rows if c == conv):
            pc, pp, linked = rows[conv, pos]
            if linked and pc == conv:
                last = level[conv, pp] + 1
            level[conv, pos] = last
        for n, pos in enumerate(sorted((p for c, p in rows if c == conv), key=lambda p: (level[conv, p], p))):
            out[conv, pos] = (level[conv, pos], n)
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_planted_threads(spark, kind):
    """A hot conversation of 120 turns and three short ones; replies quote a whole message, a line of it or something unknown."""
    rng = random.Random(6)
    rows, said, parents = [], {}, {}
    for conv, size in ((1, 120), (2, 9), (3, 1), (None, 5)):
        for turn in range(size):
            line = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(5)) + f" {conv} {turn}"
            lines = [f"First of {line}", f"Second of {line}"]
            quote, parent = "", None
            if turn and rng.random() < 0.6:
                at = rng.randrange(turn)
                what = rng.choice(("whole", "line", "unknown"))
                quoted = said[conv, at] if what == "whole" else said[conv, at][rng.randrange(2) :][:1] if what == "line" else ["nobody ever said this thing"]
                quote = "X wrote:\n" + "".join(f"{rng.choice(['> ', '>'])}{q.upper()}\n" for q in quoted) + "\n"
                parent = (conv, at) if what != "unknown" else None
            said[conv, turn] = lines
            parents[conv, turn] = (*parent, True) if parent else (conv, turn - 1, False) if turn else (None, None, False)
            rows.append((conv, turn if kind == "bigint" else str(turn), "u", quote + "\n".join(lines), "x", 1))
    rng.shuffle(rows)
    got = {(r.conv_id, r.position): r for r in quotations.link_quotations(spark.createDataFrame(rows, SCHEMA.format(kind))).collect()}
    assert {k: (r.parent_conv, r.parent_position) for k, r in got.items()} == {k: v[:2] for k, v in parents.items()}
    assert {k: r.text for k, r in got.items()} == {k: "\n".join(v) for k, v in said.items()}
    want = plain_order(parents)
    assert {k: (r.reply_level, r.reply_order) for k, r in got.items()} == want and max(v[0] for v in want.values()) > 3


def test_odd_rows(spark):
    rows = [(1, "10", "b", "tie", "x", 1), (1, "9", "a", "nine", "x", 1), (1, "10", "a", "tie", "x", 1), (1, "x", "a", "no number", "x", 1), (1, None, "a", None, "x", 1), (1, "9", "a", "nine", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA.format("string"))
    got = sorted(quotations.link_quotations(df).collect(), key=lambda r: r.position)
    assert [(r.turn, r.role, r.text, r.reply_order, r.reply_level) for r in got] == [("9", "a", "nine", 0, 0), ("9", "a", "nine", 1, 0), ("10", "a", "tie", 2, 0), ("10", "b", "tie", 3, 0), ("x", "a", "no number", 4, 0), (None, "a", "", 5, 0)]
    assert quotations.link_quotations(spark.createDataFrame([], SCHEMA.format("bigint"))).collect() == []


def test_nested_levels_and_long_attributions():
    own, passages = quotations.split_quotes("On Monday, " + "a very long name " * 40 + "wrote:\n> one\n> > two\n>>> three\n> four\n\nmine")
    assert own.strip() == "mine" and passages == [(1, "one"), (2, "two"), (3, "three"), (1, "four"), (0, "mine")]
    assert quotations.split_quotes("He said:\nnothing quoted") == ("He said:\nnothing quoted", [(0, "He said: nothing quoted")])
