import random

import brute
import pytest
from pyspark.sql import functions as F

from kinetext.llm import common, prefix_trie, queries
from kinetext.operators import joins

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df, **how):
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(df), **how)
    return prefix_trie.prefix_trie(turns, convs).collect()


def compare(spark, data, **how):
    got = nodes(spark.createDataFrame(data, TURNS).repartition(3), **how)
    want = sorted(brute.prefix_trie(data, **how).values(), key=repr)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == want
    intervals(got)
    return got


def intervals(got):
    """Preorder numbers are a permutation; a parent's interval holds its children's, side by side and after itself."""
    assert sorted(r["preorder"] for r in got) == list(range(len(got)))
    at = {(r["conv_id"], r["depth"]): r for r in got}
    kids = {}
    for r in got:
        if r["depth"]:
            kids.setdefault((r["parent_conv_id"], r["depth"] - 1), []).append((r["preorder"], r["subtree_end"]))
    for key, r in at.items():
        spot = r["preorder"] + 1
        for a, b in sorted(kids.get(key, ())):
            assert a == spot
            spot = b + 1
        assert spot == r["subtree_end"] + 1


@pytest.mark.parametrize("rows_a_range", [20, 100_000])
def test_random_conversations(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(joins, "RANGE_ROWS", rows_a_range)
    rng = random.Random(3)
    data = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ä€𝄞", ""])) for c in [*range(-5, 25), *range(100, 118), 250] for t in range(rng.randint(1, 7))]
    compare(spark, data)


def test_odd_rows(spark):
    data = [
        (None, 1, "user", "no conversation"), (0, None, None, None), (0, None, "user", "first"), (0, 2, "user", "b"), (0, 2, "user", "b"), (0, 2, "assistant", "z"), (0, 1, None, "x"), (7, 1, "user", "only"),
        (8, 1, "user", "only"), (101, 1, "user", ""), (102, 5, "", None), (-3, 1, "user", "negative"), (-150, 1, "user", "far"), (9, 1, "user", "y" * 100_000), (9, 2, "user", "y" * 99_999 + "z"),
    ]
    compare(spark, data)
    clashing = spark.createDataFrame(data, TURNS).withColumns({c: F.lit(1) for c in ("conv", "place", "x", "y", "depth", "path", "before", "token", "chars")})
    assert len(nodes(clashing)) == len(brute.prefix_trie(data))
    assert nodes(spark.createDataFrame([], TURNS)) == []
    assert nodes(spark.createDataFrame([(None, None, None, None)] * 3, TURNS)) == []


def test_a_long_conversation_and_its_branches(spark):
    """A caterpillar: keys stay short, though half of the nodes branch."""
    data = [(0, t, "user", f"t{t}") for t in range(300)]
    data += [(c, t, "user", f"t{t}") for c in range(1, 60) for t in range(5 * c)] + [(c, 5 * c, "user", "turned off") for c in range(1, 60)]
    own = spark.createDataFrame(data, TURNS)
    turns = prefix_trie.ordered_turns(own)
    got = prefix_trie.prefix_trie(turns, turns.select("conv").distinct()).collect()
    want = brute.prefix_trie(data, shared=1)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(want.values(), key=repr)
    intervals(got)


def test_many_conversations_end_together(spark, monkeypatch):
    """The list of a hot node comes in several rows."""
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    compare(spark, [(c, t, "user", "same") for c in range(-40, 90) for t in range(2)])


def test_results_without_broadcasts(spark, sf, monkeypatch):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    monkeypatch.setattr(common, "BROADCAST_LIMIT", -1)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op11_prefix_trie(spark, sf).collect()), key=repr)
    assert got == sorted(brute.prefix_trie(data).values(), key=repr)
    kinds = dict(queries.op11_prefix_trie(spark, sf).dtypes)
    assert kinds == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}
