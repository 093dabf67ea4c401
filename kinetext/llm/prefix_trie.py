"""A trie of conversations that share their first turns.

A node is told by the xor of the digests of its turns with their places, so a
row a turn is all that moves, however long a conversation is. Nodes are ranked
in preorder by a key that is short for any trie: a node's heavy child is the one
with the most conversations, and the key names only the light children on the
way, of which there are at most as many as the number of conversations can be
halved. Light children come first and the heavy child last, so a subtree ends
where its top's heavy path ends, and what is in it is the difference of two
prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import running_all
from . import common as C

#: Ids that one row of a list of conversations spans; no more than so many are collected.
ID_BITS = 14
#: The columns that tell a node.
LANES = ["x", "y"]
HEAVY = "~"  # after every digit and letter


def ordered_turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns conv, place (from 1), token (the digest of role and text) and chars (code points of the text).

    Turns stand in the order of their number, null first; equal numbers in the
    order of role and text. Null role or text is empty. Rows whose conversation
    is null, or no whole number, take no part; repeated rows are turns of their own.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.expr(f"try_cast(`{turn_col}` AS BIGINT)")
    rows = table.select(F.expr(f"try_cast(`{conv_col}` AS BIGINT)").alias("conv"), turn.isNotNull().alias("has"), F.coalesce(turn, F.lit(0).cast("long")).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = rows.where("conv is not null").select("conv", "has", "turn", "role", "text", F.length("text").cast("long").alias("chars"))
    # Ties are ranked by role and the start of the text, and by digest where those are equal too; whole texts don't move.
    rows = rows.select("conv", "has", "turn", "role", F.substring("text", 1, 64).alias("start"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("token"), "chars")
    numbered = running_all(rows, {"before": (F.lit(1), F.sum)}, ["has", "turn", "role", "start", "token"], ["conv"])
    return numbered.select("conv", (F.col("before") + 1).alias("place"), "token", "chars")


def rebuilt(turns: DataFrame, block: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first one of their block.

    Conversation c gets the first h turns of conversation c - c % ``block``,
    where h is the CRC-32 of c in decimals modulo ``shared``, and then its own
    turns after its first h. Returns the turns and all conversations, those
    that are left without turns too.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv") - F.col("conv") % block
    convs = sizes.select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).alias("h"), base.alias("base"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), "n"), "base", "left").withColumn("p", F.least("h", F.coalesce("n", F.lit(0))).cast("long"))
    convs = C.materialize(convs.select("conv", "h", "p", "base"), "convs")
    heads = turns.where((F.col("place") < shared) & (F.col("conv") % block == 0)).select(F.col("conv").alias("base"), "place", "token", "chars")
    first = convs.join(heads, "base").where("place <= p").select("conv", "place", "token", "chars")
    own = turns.join(convs.select("conv", "h", "p"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("p")).alias("place"), "token", "chars")
    return first.unionByName(own), convs.select("conv")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node, of lists that come in the node's order; a list of any length takes the memory of one row."""
    now, sha = None, None
    for batch in batches:
        found = []
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in LANES), strict=True), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    found.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _digests(found)
    if now is not None:
        yield _digests([(*now, sha.hexdigest())])


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    x, y, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sha, pa.string())], names=[*LANES, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """Columns x, y and ends_sha256: the SHA-256 of a node's conversations, ascending and joined by commas.

    The digest of a list has to be computed from its start to its end, so one
    task reads all of a node's list, but as rows of up to 2^ID_BITS ids.
    """
    block = F.shiftright("conv", ID_BITS)
    lists = ends.groupBy(*LANES, block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return lists.repartition(*LANES).sortWithinPartitions(*LANES, "block").select(*LANES, "ids").mapInArrow(_ends, "x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, place from 1 without gaps, token, chars); ``convs`` (conv) are all conversations, each once.

    A row for each distinct sequence of first turns, the empty one included:
    conv_id (the smallest conversation that starts with it), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, the code points of a node's last turn times
    its conversations but one), ends_sha256, and the encoding: preorder (from 0)
    and subtree_end (the last preorder number in the subtree).

    Tokens are equal if and only if turns are. Nodes are told by 128 bits.
    Without conversations there is no node.
    """
    lane = lambda i: F.xxhash64(F.lit(i), "place", "token", F.lit(i))
    own = turns.select("conv", "place", "chars", lane(1).alias("a"), lane(2).alias("b"))
    before = running_all(own, {"px": (F.col("a"), F.bit_xor), "py": (F.col("b"), F.bit_xor)}, ["place"], ["conv"])
    paths = before.select("conv", F.col("place").alias("depth"), "chars", "px", "py", F.col("px").bitwiseXOR(F.col("a")).alias("x"), F.col("py").bitwiseXOR(F.col("b")).alias("y"))
    root = convs.select("conv", *(F.lit(v).cast("long").alias(c) for c, v in (("depth", 0), ("chars", 0))), *(F.lit(None).cast("long").alias(c) for c in ("px", "py")), *(F.lit(0).cast("long").alias(c) for c in LANES))
    paths = C.materialize(paths.unionByName(root), "paths")
    key = ["depth", *LANES]  # depth apart, so that a hash of no turn at all can't be another node's
    nodes = paths.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.first(c).alias(c) for c in ("chars", "px", "py")))
    nodes = C.materialize(nodes, "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    kids = kids.agg(F.count(F.lit(1)).alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    parents = C.materialize(nodes.join(kids, key, "left"), "parents")
    # A node is known among its parent's children by its smallest conversation.
    above = parents.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("sibling"))
    full = parents.join(above, ["depth", "px", "py"], "left").withColumn("light", F.coalesce(F.col("conv_id") != F.col("sibling"), F.lit(False)))
    full = C.materialize(full.select(*key, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "light", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "full")
    # The light nodes on the way to each conversation's end; a conversation has few of them.
    turn_offs = paths.join(full.where("light").select(*key, F.col("conv_id").alias("child")), key).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "child"))).alias("offs"))
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    step: Column = F.array_join(F.transform(F.filter("offs", lambda o: o["depth"] <= F.col("depth")), lambda o: F.concat(hexed(o["depth"], 12), hexed(o["child"], 16))), "")
    ranked = full.join(turn_offs.withColumnRenamed("conv", "conv_id"), "conv_id", "left").withColumn("path", F.coalesce(step, F.lit("")))
    ranked = ranked.withColumns({"spot": F.concat("path", hexed(F.col("depth"), 12), F.lit(HEAVY)), "leaf": (F.col("n_children") == 0).cast("long")}).drop("offs", "light")
    sums = {"preorder": (F.lit(1), F.sum), "leaves": (F.col("leaf"), F.sum), "sum": (F.col("saved"), F.sum)}
    summed = C.materialize(running_all(ranked, sums, ["spot"]), "ranked")
    # A heavy path's last node is the last one of the subtree of each of its nodes.
    ends = summed.groupBy("path").agg(F.max("preorder").alias("subtree_end"), F.max(F.col("leaves") + F.col("leaf")).alias("to_leaves"), F.max(F.col("sum") + F.col("saved")).alias("to_sum"))
    found = summed.join(ends, "path").withColumns({"n_leaves": F.col("to_leaves") - F.col("leaves"), "saved_tokens": F.col("to_sum") - F.col("sum")})
    last = paths.groupBy("conv").agg(F.max_by(F.struct(*LANES), "depth").alias("end")).select("conv", "end.x", "end.y")
    found = found.join(end_digests(last), LANES, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "preorder", "subtree_end")
