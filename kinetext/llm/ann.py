"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample, split until lists are short. Every vector
goes to its nearest list; a vector near a border goes to several. A query finds
its centroids by walking an in-memory neighbour graph, and searches the lists
whose distance is within a ratio of the nearest. Neighbouring lists form a cell,
to which a vector or a query goes once, whatever number of its lists is there.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Vectors that a list should hold; vectors of the sample for each list, at least (centroids are fitted on the sample), and in all.
LIST, SAMPLE_A_LIST, SAMPLE = 100, 16, 20_000
#: Bytes of the sample at most. They bound the lists too: of 64 dimensions 16,384, whose centroids are broadcast (8 MB).
SAMPLE_BYTES = 128 << 20
#: A vector is in every list within this ratio of its nearest one, up to COPIES.
BORDER, COPIES = 1.10, 4
#: A query searches LEAST_LISTS at least, and else lists within a ratio of its nearest one, up to a number. Both follow from the data: TESTS
#: sampled vectors are compared with all rows, and so many of their nearest ones (RECALL) must be in lists that are searched.
LEAST_LISTS, TESTS, RECALL = 8, 128, 0.97
#: Graph: neighbours of a centroid, and candidates kept on a walk beyond the lists asked for.
DEGREE, SLACK = 24, 16
#: Bytes of vectors of either side that one task compares, and queries that it compares with a list at a time.
PIECE, BLOCK = 8 << 20, 256


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Balanced centroids: two-means splits of the largest part until there are ``lists``. They stand in the order of the splits: neighbours are near."""
    rng = np.random.default_rng(seed)
    parts = [(-len(sample), "", np.arange(len(sample)))]
    while len(parts) < lists and -parts[0][0] > 1:
        _, way, rows = heapq.heappop(parts)
        x = sample[rows]
        a, b = x[rng.choice(len(rows), 2, replace=False)]
        for _ in range(rounds):
            side = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
            order = np.argsort(side, kind="stable")
            half = len(rows) // 2  # equal halves keep the lists balanced
            a, b = x[order[:half]].mean(0), x[order[half:]].mean(0)
        for bit, own in (("0", rows[order[:half]]), ("1", rows[order[half:]])):
            heapq.heappush(parts, (-len(own), way + bit, own))
    return np.stack([sample[rows].mean(0) for _, _, rows in sorted(parts, key=lambda x: x[1])]) if len(sample) else np.zeros((1, sample.shape[1]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass
class Graph:
    """Centroids with links to their nearest neighbours and to a few random others, walked best first."""

    centroids: np.ndarray
    links: np.ndarray = field(init=False)
    entry: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.centroids)
        rng = np.random.default_rng(3)
        near = [np.argpartition(distances(self.centroids[i : i + 512], self.centroids), min(DEGREE, n - 1), axis=1)[:, : DEGREE + 1] for i in range(0, n, 512)]
        self.links = np.concatenate([np.concatenate(near), rng.integers(0, n, (n, 4))], 1)
        self.entry = np.unique(rng.integers(0, n, 8))

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """About the k nearest centroids and their squared distances, nearest first."""
        seen = np.zeros(len(self.centroids), bool)
        keep = k + SLACK
        todo: list[tuple[float, int]] = []
        best: list[tuple[float, int]] = []  # negative distances: the farthest kept is on top

        def visit(new: np.ndarray) -> None:
            new = np.unique(new[~seen[new]])
            seen[new] = True
            far = ((self.centroids[new] - q) ** 2).sum(1)
            for d, i in zip(far.tolist(), new.tolist(), strict=True):
                if len(best) < keep or d < -best[0][0]:
                    heapq.heappush(todo, (d, i))
                    heapq.heappush(best, (-d, i))
                    if len(best) > keep:
                        heapq.heappop(best)

        visit(self.entry)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= keep and d > -best[0][0]:
                break
            visit(self.links[i])
        found = sorted((-d, i) for d, i in best)[:k]
        return np.array([i for _, i in found], np.int64), np.array([d for d, _ in found])


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns vec_id and v (doubles) of rows that take part: with an id, no null or non-finite component, not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


_GRAPHS: dict[str, Graph] = {}


def _graph(key: str, shared) -> Graph:
    if key not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[key] = Graph(shared.value)
    return _GRAPHS[key]


def by_cell(batch: pa.RecordBatch, row: np.ndarray, lists: np.ndarray, group: int, key: str) -> pa.RecordBatch:
    """Columns cell, key, v, lists: each row once for every cell (``group`` neighbouring lists) that any of its lists is in."""
    cell = lists // group
    order = np.lexsort((lists, cell, row))
    row, cell, lists = row[order], cell[order], lists[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]))[: len(row)]
    at = pa.array(np.concatenate([first, [len(row)]]).astype(np.int32))
    taken = pa.array(row[first])
    return pa.RecordBatch.from_arrays([pa.array(cell[first].astype(np.int32)), batch.column(key).take(taken), batch.column("v").take(taken), pa.ListArray.from_arrays(at, pa.array(lists.astype(np.int32)))], names=["cell", key, "v", "lists"])


def _assign(shared, group: int):
    """Each vector under its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield by_cell(part, *lists_of(matrix(part.column("v")), shared.value), group, "vec_id")

    return run


def lists_of(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of vectors: all lists within BORDER of the nearest, of the COPIES nearest."""
    d = distances(x, centroids)
    k = min(COPIES, len(centroids))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    far = np.take_along_axis(d, near, 1)
    row, col = np.nonzero(far <= far.min(1, keepdims=True) * BORDER**2)
    return row, near[row, col]


def _tested(tests: np.ndarray, k: int):
    """The ``k`` rows of each task that are nearest to each test, with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_v = np.full((len(tests), k), np.inf), np.zeros((len(tests), k, tests.shape[1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                x = matrix(batch.column("v").slice(lo, 1024))
                d = distances(tests, x)
                d = np.concatenate([best_d, d], 1)
                own = np.argpartition(d, k - 1, axis=1)[:, :k]
                held = np.minimum(own, k - 1)
                best_v = np.where((own < k)[:, :, None], np.take_along_axis(best_v, held[:, :, None], 1), x[np.maximum(own - k, 0)])
                best_d = np.take_along_axis(d, own, 1)
        test, spot = np.nonzero(np.isfinite(best_d))
        flat = best_v[test, spot]
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * tests.shape[1]), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(test.astype(np.int32)), pa.array(best_d[test, spot]), v], names=["test", "d", "v"])

    return run


def search_width(main: DataFrame, tests: np.ndarray, centroids: np.ndarray, k: int) -> tuple[int, float]:
    """(lists at most, squared ratio to the nearest list) that a query has to search for RECALL of its ``k`` nearest rows: measured on ``tests`` against all rows."""
    if len(centroids) <= LEAST_LISTS:
        return len(centroids), np.inf
    found = main.select("v").mapInArrow(_tested(tests, k + 1), "test int, d double, v array<double>")
    first = Window.partitionBy("test").orderBy("d")
    near = found.withColumn("n", F.row_number().over(first)).where((F.col("n") <= k + 1) & (F.col("n") > 1)).select("test", "v").toArrow()  # TESTS * k; the nearest is the test itself
    if near.num_rows == 0:
        return len(centroids), np.inf
    test, x = np.asarray(near.column("test")), matrix(near.column("v").combine_chunks())
    d = distances(tests, centroids)
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
    row, own = lists_of(x, centroids)
    order = np.lexsort((rank[test[row], own], row))  # of a neighbour's lists, the one that is searched first
    first_of = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
    q, best = test[row[first_of]], own[first_of]
    share = 1 - (1 - RECALL) / 2  # half of what may be missed is missed by the one bound, half by the other
    most = int(np.quantile(rank[q, best], share, method="higher")) + 1
    ratio = float(np.quantile(d[q, best] / np.maximum(d[q].min(1), 1e-12), share, method="higher"))
    return max(LEAST_LISTS, most), ratio


def _choose(shared, group: int, most: int, ratio: float):
    """The lists that each query searches."""
    key = uuid.uuid4().hex  # a worker builds the graph once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _graph(key, shared)
        for batch in batches:
            rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, q in enumerate(matrix(batch.column("v"))):
                near, far = graph.nearest(q, most)
                near = near[(far <= max(far[0], 1e-12) * ratio) | (np.arange(len(far)) < LEAST_LISTS)]
                rows.append(np.full(len(near), i))
                lists.append(near)
            yield by_cell(batch, np.concatenate(rows), np.concatenate(lists), group, "q")

    return run


def members(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Rows of each list."""
    lists = column.combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    flat = np.asarray(lists.flatten())
    order = np.argsort(flat, kind="stable")
    names, at = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(row[order], at[1:]), strict=True))


def _nearest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, each once."""
    q, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, score, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])[: len(q)]  # a row's copies have the same score
    q, ids, score = q[new], ids[new], score[new]
    ok = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[ok], ids[ok], score[ok]


def _compare(k: int):
    """The k nearest of a cell's rows, or a part of them, to each query, or a part of them, in the lists that the query searches."""

    def run(rows: pa.Table, wants: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if rows.num_rows and wants.num_rows:
            x, ids = matrix(rows.column("v").combine_chunks()), np.asarray(rows.column("vec_id"))
            asked, qs = matrix(wants.column("v").combine_chunks()), np.asarray(wants.column("q"))
            held = members(rows.column("lists"))
            for name, who in members(wants.column("lists")).items():
                own = held.get(name)
                if own is None:
                    continue
                x_own, ids_own = x[own], ids[own]
                for lo in range(0, len(who), BLOCK):
                    some = who[lo : lo + BLOCK]
                    q = asked[some]
                    d = distances(q, x_own)
                    kept = min(k, len(own))
                    edge = np.partition(d, kept - 1, axis=1)[:, kept - 1 : kept]
                    row, col = np.nonzero(d <= edge + 1e-9 * (1 + edge))  # ties and rounding: decided below, exactly
                    exact = np.sqrt(np.cumsum((q[row] - x_own[col]) ** 2, axis=1)[:, -1])  # summed from the first component on, as SQL does
                    found.append(_nearest([(qs[some][row], ids_own[col], exact)], k))
            found = [_nearest(found, k)]
        return pa.table(dict(zip(("q", "vec_id", "score"), found[0], strict=True)))

    return run


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows (Euclidean, not itself) of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Every valid row is indexed. Rows with a null id, or a vector that is null,
    empty, zero or has null or non-finite components, take no part; vectors of
    another length than the most common one are only compared with their like.
    Of equal vectors only the k+1 smallest ids can be among any query's
    nearest, so no more are kept. Rows that repeat an id and vector count once.
    Ties go to the smaller id. An empty table gives an empty result.
    """
    spark = table.sparkSession
    valid = valid_vectors(table, id_col, vector_col)
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = C.materialize(valid.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    total = kept.count()
    width = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The sample: rows with the smallest hashes of their ids.
    dims = max(1, width["n"])
    lists = min(max(1, total // LIST), max(1, SAMPLE_BYTES // (8 * dims * SAMPLE_A_LIST)))
    size = min(max(SAMPLE, lists * SAMPLE_A_LIST), SAMPLE_BYTES // (8 * dims))
    main, other = kept.where(F.size("v") == width["n"]), kept.where(F.size("v") != width["n"])
    sample = matrix(main.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, size)).select("v").toArrow().column("v").combine_chunks())
    tests = sample[: min(TESTS, len(sample) // 5)]
    centroids = fit_centroids(sample[len(tests) :], lists)  # without the tests, which stand for queries that no centroid knows
    most, ratio = search_width(main, tests, centroids, k)
    shared = spark.sparkContext.broadcast(centroids)  # SAMPLE_BYTES / SAMPLE_A_LIST at most
    # A cell is as many neighbouring lists as one task compares.
    piece = max(1, PIECE // (8 * dims))
    group = max(1, piece * len(centroids) // (total * COPIES))
    own = lambda key: [(-F.size("v")).alias("cell"), key, "v", F.array(-F.size("v")).alias("lists")]
    posted = main.mapInArrow(_assign(shared, group), "cell int, vec_id long, v array<double>, lists array<int>").unionByName(other.select(*own("vec_id")))
    # Equal vectors that are queries are searched for once.
    asked = valid.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.min("vec_id").alias("q"))
    asked = C.materialize(asked, "asked")
    wanted = asked.where(F.size("v") == width["n"]).mapInArrow(_choose(shared, group, most, ratio), "cell int, q long, v array<double>, lists array<int>").unionByName(asked.where(F.size("v") != width["n"]).select(*own("q")))
    # Large cells, and cells that many queries search, go to several tasks: each part of the one meets each part of the other.
    posted, wanted = C.materialize(posted, "posted"), C.materialize(wanted, "wanted")
    pieces = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias(name))
    parts = C.materialize(pieces(posted, "parts").join(pieces(wanted, "asks"), "cell"), "parts")
    parts = C.sized_broadcast(parts, F.lit(12))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    rows = posted.join(parts, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), spread("asks").alias("ask"), "vec_id", "v", "lists")
    wants = wanted.join(parts, "cell").select("cell", spread("parts").alias("part"), F.pmod(F.xxhash64("q"), "asks").alias("ask"), "q", "v", "lists")
    cell = ["cell", "part", "ask"]
    near = rows.groupBy(*cell).cogroup(wants.groupBy(*cell)).applyInArrow(_compare(k + 1), "q long, vec_id long, score double")
    by = Window.partitionBy("q").orderBy("score", "vec_id")
    best = near.distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 each
    # Each query with the nearest of its vector, without itself.
    same_v = asked.select(F.col("v").alias("__v"), "q").join(best, "q", "left")
    queries = valid.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("__v"))
    found = queries.join(same_v, "__v").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    found = found.select("query_id", F.posexplode("near").alias("pos", "x"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
