"""SimHash near-duplicates with covering locality-sensitive hashing.

Each bit of a fingerprint gets a nonzero vector of r+1 bits; for each nonzero
vector v, a mask keeps the bits whose vector has an odd product with v. The r
bits that two fingerprints may differ in are r equations in r+1 unknowns, so
some v has even products with them all: under that mask the two agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import connected_components

RADIUS, WORDS, SEED = 3, 3, 42
#: Fingerprints of a bucket that are compared in one task; larger buckets are split by the next cover.
BUCKET = 4096
#: One in so many fingerprints is looked at to see which buckets are large.
SAMPLE = 16


def cover(step: int, turn: int, radius: int = RADIUS) -> list[int]:
    """The masks; ``step`` and ``turn`` say which bit has which vector."""
    n = (1 << (radius + 1)) - 1
    vectors = [(b * step + b // n * turn) % n + 1 for b in range(64)]
    return [sum(1 << b for b in range(64) if (vectors[b] & v).bit_count() % 2 == 1) for v in range(1, n + 1)]


#: Fingerprints that agree under a mask of each of the three covers differ in at most 12 bits: no more than 4096 do.
COVERS = [cover(1, 0), cover(5, 6), cover(2, 11)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_rows(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprint of each text: bit set if over half of the shingles' hashes have it."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        if not words:
            counts.append(0)
            continue
        flat = b" ".join(words)
        if len(words) <= WORDS:
            hashes.append(digest(flat, SEED))
            counts.append(1)
            continue
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: -WORDS]]
        hashes += [digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=True)]
        counts.append(len(starts))
    out = np.zeros(len(texts), np.uint64)
    n = np.array(counts)
    bits = np.array(hashes, "<u8")
    full = np.flatnonzero(n)
    if len(full):
        at = np.concatenate([[0], np.cumsum(n[full])])
        for lo in range(0, len(full), 4096):  # blocks of documents; a block's bits are counted byte by byte
            hi = min(lo + 4096, len(full))
            part = bits[at[lo] : at[hi]]
            begin = at[lo:hi] - at[lo]
            value = np.zeros(hi - lo, np.uint64)
            for b in range(64):
                ones = np.add.reduceat(((part >> np.uint64(b)) & np.uint64(1)).astype(np.int32), begin)
                value |= (2 * ones > n[full[lo:hi]]).astype(np.uint64) << np.uint64(b)
            out[full[lo:hi]] = value
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``simhash``, the 64-bit fingerprint of the words' 3-shingles as a signed long.

    Null and empty texts have fingerprint 0; texts of fewer than three words
    have one shingle.
    """

    def run(part: pa.RecordBatch) -> dict:
        return {"simhash": pa.array(fingerprint_rows(C.texts(part.column(text_col))).view(np.int64), pa.int64())}

    return C.add_columns(C.as_text(docs, text_col), run, [T.StructField("simhash", T.LongType())], text_col, drop=(text_col,) * drop_text)


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius among distinct fingerprints: breadth-first, unvisited ones only."""
    left = np.arange(len(values))
    edges = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(values[left] ^ values[a]) <= radius
            if near.any():
                edges += [(a, int(b)) for b in left[near]]
                queue += left[near].tolist()
                left = left[~near]
    return edges


def _bucket_links(radius: int, limit: int | None):
    """Links within runs of equal keys in sorted rows (key, fp); a run over ``limit`` is handed on instead.

    Out: kind 0, fingerprints a and b are linked; kind 1, fingerprint a of a large bucket.
    """

    def out(large: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        rest, linked = (np.concatenate([np.zeros((0, 2), np.int64), *x]) for x in (large, pairs))
        kind = np.repeat(np.array([1, 0], np.int32), [len(rest), len(linked)])
        none = np.zeros(len(linked), np.int64)
        columns = [kind, np.concatenate([rest[:, 0], none]), np.concatenate([rest[:, 1], linked[:, 0]]), np.concatenate([np.zeros(len(rest), np.int64), linked[:, 1]])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 2), np.int64)  # rows of the run that the last batch ended in
        large: int | None = None  # the key of that run, if it has been found too large

        def close(own: np.ndarray) -> np.ndarray:
            edges = _forest(own[:, 1].view(np.uint64), radius) if len(own) > 1 else []
            return own[np.array(edges, np.int64).reshape(-1, 2), 1]

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)) for c in ("key", "fp")], 1)
            handed, pairs = [], []
            if large is not None:
                stop = int(np.searchsorted(rows[:, 0] != large, True))
                handed.append(rows[:stop])
                rows = rows[stop:]
                large = None if len(rows) else large
            rows = np.concatenate([rest, rows])
            rest = rows[:0]
            if len(rows):
                starts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1])
                sizes = np.diff(np.concatenate([starts, [len(rows)]]))
                two = starts[:-1][sizes[:-1] == 2]
                near = two[np.bitwise_count((rows[two, 1] ^ rows[two + 1, 1]).view(np.uint64)) <= radius]
                pairs.append(np.stack([rows[near, 1], rows[near + 1, 1]], 1))
                for i in np.flatnonzero(sizes > 2):
                    own = rows[starts[i] : starts[i] + sizes[i]]
                    if limit and sizes[i] > limit:
                        handed.append(own)
                        if i == len(sizes) - 1:
                            large = int(own[0, 0])
                    elif i < len(sizes) - 1:
                        pairs.append(close(own))
                if large is None:
                    rest = rows[starts[-1] :]
            yield out(handed, pairs)
        yield out([], [close(rest)])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """A spanning set of the links among distinct fingerprints ``fp``: columns a, b (fingerprints).

    Every pair within the radius ends up connected. Buckets of more than about
    ``bucket`` fingerprints are split by the next cover, and once more by the
    last one, after which a bucket has 4096 at most. Buckets that a sample
    shows to be large skip their own task; others that turn out large are
    handed on as they stream by.
    """
    rows, found = distinct.select(F.lit(0).cast("long").alias("path"), "fp"), []
    for level, masks in enumerate(COVERS):
        last = level == len(COVERS) - 1
        # A bucket's key hashes the way to it; should two keys meet, their rows are compared for nothing.
        keys = F.array(*(F.xxhash64("path", F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)))
        keyed = rows.select("fp", F.explode(keys).alias("key"))
        crowded = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(SAMPLE, bucket // (2 * SAMPLE))).select("key")
        crowded = None if last else C.materialize(crowded, "crowded")
        if crowded is not None and crowded.isEmpty():
            crowded = None
        small = keyed if crowded is None else keyed.join(C.sized_broadcast(crowded, F.lit(8)), "key", "left_anti")
        linked = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(radius, None if last else bucket), "kind int, key long, a long, b long")
        linked = C.materialize(linked, "links")
        found.append(linked.where("kind = 0").select("a", "b"))
        rows = linked.where("kind = 1").select(F.col("key").alias("path"), F.col("a").alias("fp"))
        if crowded is not None:
            rows = rows.unionByName(keyed.join(C.sized_broadcast(crowded, F.lit(8)), "key", "left_semi").select(F.col("key").alias("path"), "fp"))
        if rows.isEmpty():
            break
        rows = C.materialize(rows, "crowd")
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Columns ``doc_id``, ``simhash`` and ``component_id``, one row per row of ``docs``.

    The component is the smallest id reachable over fingerprints that differ
    in at most ``radius`` bits (at most 3). Rows with equal fingerprints are
    one node, so large groups of copies never meet as pairs. Rows with a null
    id link like any other, keep their fingerprint and get the smallest
    non-null id of their component, or null where there is none. Ids are whole
    numbers; others that can't be read as such raise an error. An empty table
    gives an empty table.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the masks cover radii up to {RADIUS}")
    return components_of(C.materialize(C.gathered(prints_of(docs, id_col, text_col)), "prints"), radius)


def prints_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", drop_text=True)


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``near_duplicates`` of fingerprints (doc_id, simhash)."""
    nodes = C.materialize(prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("rep")), "nodes")
    # Only fingerprints that have a link, a part of all, are labelled anew.
    parts = connected_components(links(nodes.select("fp"), radius))
    linked = C.materialize(nodes.join(C.sized_broadcast(parts, F.lit(16)), F.col("fp") == F.col("node")).select("fp", "rep", "component"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    least = linked.join(C.sized_broadcast(least, F.lit(16)), "component").select(F.col("fp").alias("linked_fp"), "least")
    label = nodes.join(C.sized_broadcast(least, F.lit(16)), F.col("fp") == F.col("linked_fp"), "left").select(F.col("fp").alias("simhash"), F.coalesce("least", "rep").alias("component_id"))
    label = C.sized_broadcast(C.materialize(label, "labels"), F.lit(24))
    return prints.join(label, "simhash").select("doc_id", "simhash", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Rows with a null id stay; of rows that repeat an id all stay or none.

    ``before`` has earlier texts of the same documents (and of others, which
    don't count). Documents are then linked by what they were too, so that
    copies are found although their common lines have been taken out since.
    """
    key = C.free_name(docs, "__gone")
    found = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id")
    if before is not None:
        ids = C.materialize(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
        old = prints_of(before, id_col, text_col).join(C.sized_broadcast(ids, F.lit(8)), "doc_id", "left_semi")
        edges = found.unionByName(components_of(C.materialize(C.gathered(old), "prints")).where("doc_id <> component_id"))
        found = connected_components(edges.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")).where("doc_id <> component_id")
    found = found.select(F.col("doc_id").alias(key))
    gone = C.sized_broadcast(C.materialize(found.distinct(), "gone"), F.lit(8))
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_anti")
