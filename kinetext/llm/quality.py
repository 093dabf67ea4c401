"""Quality classification by co-training.

Two classifiers see different views of a document, its text and its metadata.
In each round either labels the unlabelled documents that it is sure of, for the
other to learn from. Their calibrated scores are then combined. Unlabelled
documents stay on the workers, which sum the gradients over them.
"""

from __future__ import annotations

import uuid
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import features as X

#: Labelled documents that the classifiers are fitted on, at most: those with the smallest hashes of their ids. All unlabelled ones take part.
LABELLED = 4000
#: Hashed words, hashed metadata values, and styles of writing.
WORD_BITS, META_BITS = 14, 10
ROUNDS, SURE = 4, 0.95
#: Weight of a pseudo-label beside a label; where there are more pseudo-labels than labels, all of them together count as this share of the labels.
TRUST = 0.3
#: Steps of the first fit of a view, and of the later ones, which start from the one before.
STEPS, MORE_STEPS = 60, 15
#: Sums of tasks that the driver adds up itself; more are added on the executors first.
FEW_SUMS = 32
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
LETTERS = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Byte classes whose shares are features of style.
STYLE = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "beyond": range(128, 256), "stop": b".,;:", "loud": b"!?", "sign": b"#$%&*@^~|<>=+_{}[]\\/"}
STYLES = len(STYLE) + 1


def text_view(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of each distinct hashed word, by row, and the styles of each row."""
    words, row = X.hashed_words(data, at, WORD_BITS, LOWER, LETTERS)
    pairs = np.unique(row << WORD_BITS | words)
    n = np.diff(at)
    style = np.zeros((len(n), STYLES))
    owner = np.repeat(np.arange(len(n)), n)
    for j, (_, chars) in enumerate(STYLE.items()):
        has = np.zeros(256, bool)
        has[list(chars)] = True
        style[:, j] = np.bincount(owner[has[data]], minlength=len(n)) / np.maximum(n, 1)
    style[:, -1] = np.log1p(n) / 10
    return pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1), style


@dataclass
class Sparse:
    """Rows of features of equal weight in a row, and dense columns after them."""

    row: np.ndarray
    col: np.ndarray
    dense: np.ndarray
    width: int

    def __post_init__(self) -> None:
        self.n = len(self.dense)
        self.weight = 1 / np.sqrt(np.maximum(np.bincount(self.row, minlength=self.n), 1))
        self.value = self.weight[self.row]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.value, self.n) + self.dense @ w[self.width : -1] + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, g[self.row] * self.value, self.width), self.dense.T @ g, [g.sum()]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(x: Sparse, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each class the summed gradient of the log loss over its rows, and their number at the end; rows of -1 don't count."""
    g = np.where(y >= 0, sigmoid(x.dot(w)) - y, 0)
    words = np.bincount(x.col + x.width * (y == 1)[x.row], g[x.row] * x.value, 2 * x.width).reshape(2, -1)
    return np.stack([np.concatenate([words[c], x.dense.T @ (g * (y == c)), [(g * (y == c)).sum(), (y == c).sum()]]) for c in (0, 1)])


def fit(x: Sparse, y: np.ndarray, start: np.ndarray | None = None) -> Generator[np.ndarray, np.ndarray | None, np.ndarray]:
    """Logistic regression with balanced classes, by Adam. Yields its weights, is sent ``slopes`` over pseudo-labels (or None) and returns the weights."""
    w = np.zeros(x.width + x.dense.shape[1] + 1) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, (STEPS if start is None else MORE_STEPS) + 1):
        own, crowd = slopes(x, w, y), (yield w)
        if crowd is not None:
            own = own + TRUST * min(1.0, len(y) / max(crowd[:, -1].sum(), 1)) * crowd
        g = (own[:, :-1] * (0.5 / np.maximum(own[:, -1:], 1e-9))).sum(0) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression on few columns, drawn towards ``start``: Newton steps, halved until the loss falls."""

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((a - start) ** 2).sum())

    a = start
    for _ in range(50):
        p = sigmoid(x @ a)
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(a))
        step, now = np.linalg.solve(h, x.T @ (p - y) + ridge * (a - start)), loss(a)
        while np.abs(step).max() > 1e-9 and loss(a - step) > now:
            step = step / 2
        a = a - step
        if np.abs(step).max() <= 1e-9:
            break
    return a


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into log odds (Platt)."""
    a = logistic(np.stack([score, np.ones(len(score))], 1), y, np.array([0.5, 0.0]), 1e-2)
    return max(float(a[0]), 0.0), float(a[1])


@dataclass
class Model:
    """Weights of both views, their calibration, and how much each counts in the sum of log odds."""

    text: np.ndarray
    meta: np.ndarray
    scales: list[tuple[float, float]]
    mix: np.ndarray

    def odds(self, text: Sparse, meta: Sparse) -> np.ndarray:
        views = [a * x.dot(w) + b for (a, b), x, w in zip(self.scales, (text, meta), (self.text, self.meta), strict=True)]
        return self.mix[0] * views[0] + self.mix[1] * views[1] + self.mix[2]


#: For each target its views' weights and scales (None: no co-training).
Judges = list[list[tuple[np.ndarray, float, float]] | None]


def judge(views: tuple[Sparse, Sparse], judges: Judges, labels: np.ndarray, free: np.ndarray) -> np.ndarray:
    """``labels`` (row, target, view; -1 none) with those that the other view is sure of, where ``free`` (row, target) and none stands."""
    labels = labels.copy()
    for t, own in enumerate(judges):
        for i, (w, a, b) in enumerate(own or ()):
            p = sigmoid(a * views[i].dot(w) + b)
            new = np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))
            open_ = free[:, t] & (labels[:, t, 1 - i] < 0)
            labels[open_, t, 1 - i] = new[open_]
    return labels


class Crowd:
    """Unlabelled rows in memory."""

    def __init__(self, views: tuple[Sparse, Sparse], free: np.ndarray) -> None:
        self.views, self.free = views, free
        self.labels = np.full((*free.shape, 2), -1)

    def empty(self) -> bool:
        return not self.free.any()

    def label(self, judges: Judges) -> None:
        self.labels = judge(self.views, judges, self.labels, self.free)

    def slopes(self, weights: list[list[np.ndarray] | None]) -> list[list[np.ndarray] | None]:
        return [own and [slopes(x, w, self.labels[:, t, i]) for i, (x, w) in enumerate(zip(self.views, own, strict=True))] for t, own in enumerate(weights)]


def take(x: Sparse, keep: np.ndarray) -> Sparse:
    new = np.full(x.n, -1)
    new[keep] = np.arange(len(keep))
    ok = new[x.row] >= 0
    return Sparse(new[x.row[ok]], x.col[ok], x.dense[keep], x.width)


def co_train(text: Sparse, meta: Sparse, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y``: 1, 0, or -1 for unlabelled rows."""
    return co_train_all(text, meta, [y], Crowd((text, meta), (y < 0)[:, None]), rounds)[0]


def co_train_all(text: Sparse, meta: Sparse, ys: list[np.ndarray], crowd, rounds: int = ROUNDS) -> list[Model]:
    """A model for each target from its labels (1, 0, or -1: none) and the unlabelled rows of ``crowd``, which all targets pass together. A quarter of the labelled rows is kept for calibration."""
    views, models, fits, parts = (text, meta), [], [], []
    for y in ys:
        known = np.flatnonzero(y >= 0)
        if len(known) < 8 or len(np.unique(y[known])) < 2:
            base = float(np.clip(y[known].mean() if len(known) else 0.5, 0.01, 0.99))
            zero = [np.zeros(x.width + x.dense.shape[1] + 1) for x in views]
            models.append(Model(*zero, [(0.0, 0.0)] * 2, np.array([0.0, 0.0, np.log(base / (1 - base))])))
            fits.append(None)
            parts.append(None)
            continue
        held, learn = known[::4], np.setdiff1d(known, known[::4])
        models.append(None)
        parts.append(([take(x, learn) for x in views], y[learn], [take(x, held) for x in views], y[held]))
        fits.append([None, None])
    active = [t for t, own in enumerate(fits) if own is not None]
    lonely = not active or rounds == 0 or crowd.empty()
    for r in range(1 if lonely else rounds + 1):
        if r:
            scales = lambda t: [calibrate(x.dot(w), parts[t][3]) for x, w in zip(parts[t][2], fits[t], strict=True)]
            crowd.label([own and [(w, *s) for w, s in zip(own, scales(t), strict=True)] for t, own in enumerate(fits)])
        running = {(t, i): fit(parts[t][0][i], parts[t][1], fits[t][i]) for t in active for i in range(2)}
        at = {k: next(f) for k, f in running.items()}
        while at:  # all fits of a round take their steps together
            sums = crowd.slopes([own and [at[t, i] for i in range(2)] for t, own in enumerate(fits)]) if r else None
            for t, i in list(at):
                try:
                    at[t, i] = running[t, i].send(sums[t][i] if sums else None)
                except StopIteration as done:
                    fits[t][i] = done.value
                    del at[t, i]
    for t in active:
        _, _, x_held, y_held = parts[t]
        scales = [calibrate(x.dot(w), y_held) for x, w in zip(x_held, fits[t], strict=True)]
        odds = np.stack([a * x.dot(w) + b for (a, b), x, w in zip(scales, x_held, fits[t], strict=True)] + [np.ones(len(y_held))], 1)
        models[t] = Model(*fits[t], scales, logistic(odds, y_held, np.array([1.0, 0.3, 0.0]), 0.1))
    return models


def meta_view(values: list[list], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of each metadata value, hashed with its column, and the log size."""
    import xxhash

    rows = [i for own in values for i in range(len(own))]
    cols = [xxhash.xxh3_64_intdigest(f"{j}:{v}") & ((1 << META_BITS) - 1) for j, own in enumerate(values) for v in own]
    return np.array(rows, np.int64), np.array(cols, np.int64), (np.log1p(np.maximum(sizes, 0)) / 10)[:, None]


class SparkCrowd:
    """Unlabelled rows of a table of features (columns t, style, m, size, free), with their pseudo-labels."""

    def __init__(self, table: DataFrame, targets: int) -> None:
        self.spark, self.targets = table.sparkSession, targets
        self.schema = "t binary, style binary, m binary, size double, free binary, labels binary"
        self.table = table.withColumn("labels", F.lit(b"\xff" * 2 * targets))
        self.path: str | None = None

    def empty(self) -> bool:
        return self.table.isEmpty()

    def label(self, judges: Judges) -> None:
        """Rewrites the table with its new pseudo-labels; the one before is deleted."""
        shared, n = self.spark.sparkContext.broadcast(judges), self.targets

        def run(batches):
            for batch in batches:
                for part in C.slices(batch, "t"):
                    views, free, labels = unpacked(part), small(part, "free", n).astype(bool), small(part, "labels", 2 * n).reshape(-1, n, 2)
                    new = judge(views, shared.value, labels, free).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x.tobytes() for x in new], pa.binary())], names=part.schema.names)

        old, self.path = self.path, f"{C.own_folder(self.spark)}/crowd-{uuid.uuid4().hex}"
        self.table.mapInArrow(run, self.schema).write.parquet(self.path)
        self.table = self.spark.read.schema(self.schema).parquet(self.path)
        shared.destroy()
        if old:
            C.delete(self.spark, old)

    def slopes(self, weights: list[list[np.ndarray] | None]) -> list[list[np.ndarray] | None]:
        """Summed on the workers; the driver gets FEW_SUMS rows, or with more cores the root of their number."""
        shared, n = self.spark.sparkContext.broadcast(weights), self.targets

        def run(batches):
            total = [own and [np.zeros((2, len(w) + 1)) for w in own] for own in shared.value]
            for batch in batches:
                for part in C.slices(batch, "t"):
                    own = Crowd(unpacked(part), np.zeros((part.num_rows, n), bool))
                    own.labels = small(part, "labels", 2 * n).reshape(-1, n, 2)
                    for sums, more in zip(total, own.slopes(shared.value), strict=True):
                        for a, b in zip(sums or (), more or (), strict=True):
                            a += b
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for own in total for a in own or ()]).tobytes()], pa.binary())], names=["g"])

        def add(batches):
            total = None
            for batch in batches:
                for x in batch.column("g"):
                    own = np.frombuffer(x.as_buffer())
                    total = own.copy() if total is None else total + own
            yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["g"])

        tasks = self.spark.sparkContext.defaultParallelism
        sums = self.table.select("t", "style", "m", "size", "labels").coalesce(tasks).mapInArrow(run, "g binary")
        if tasks > FEW_SUMS:
            sums = sums.repartition(int(tasks**0.5)).mapInArrow(add, "g binary")
        rows = sums.toArrow().column("g").to_pylist()
        shared.destroy()
        flat, out = np.sum([np.frombuffer(x) for x in rows], 0) if rows else None, []
        at = 0
        for own in weights:
            out.append(own and [])
            for w in own or ():
                size = 2 * (len(w) + 1)
                out[-1].append(flat[at : at + size].reshape(2, -1) if rows else np.zeros((2, len(w) + 1)))
                at += size
        return out

    def close(self) -> None:
        if self.path:
            C.delete(self.spark, self.path)


def small(part: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return C.view(part.column(name))[0].view(np.int8).reshape(-1, width)


def packed(x: Sparse) -> pa.Array:
    """The features of each row as 16-bit numbers."""
    order = np.argsort(x.row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(x.row, minlength=x.n))]) * 2
    return pa.Array.from_buffers(pa.binary(), x.n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x.col[order].astype(np.uint16))])


def unpacked(part: pa.RecordBatch, names: tuple[str, ...] = ("t", "style", "m", "size")) -> tuple[Sparse, Sparse]:
    """Both views of rows of ``packed`` features."""
    t, style, m, size = (part.column(x) for x in names)
    both = []
    for column, dense, width in ((t, C.view(style)[0].copy().view(float).reshape(-1, STYLES), 1 << WORD_BITS), (m, np.asarray(size).reshape(-1, 1), 1 << META_BITS)):
        data, at = C.view(column)
        both.append(Sparse(np.repeat(np.arange(len(at) - 1), np.diff(at) // 2), data.copy().view(np.uint16).astype(np.int64), dense, width))
    return both[0], both[1]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str | None = "n_chars", targets: tuple[str, ...] = ("quality", "toxic"), labelled: int = LABELLED) -> DataFrame:
    """``docs`` without the text, with ``p_<target>`` for each target: the probability that its label is 1.

    ``labels`` has the id and the targets (0, 1 or null) for some documents.
    Null texts count as empty, null metadata as a value of its own, null sizes
    as 0. Labels that repeat an id count by their largest value. Without enough
    labels of both kinds a target gets their share, or 0.5. Every row without a
    label of a target, also one without an id, takes part as unlabelled.
    Columns of ``docs`` named like a new one are replaced.
    """
    spark = docs.sparkSession
    docs = C.as_text(docs, text_col)
    meta, size = (C.free_name(docs, x) for x in ("__meta", "__size"))
    body = text_col
    ready = docs.withColumns({
        meta: F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in meta_cols)) if meta_cols else F.array().cast("array<string>"),
        size: F.coalesce(F.col(f"`{size_col}`").cast("double"), F.lit(0.0)) if size_col else F.lit(0.0),
    })

    def views(part: pa.RecordBatch) -> tuple[Sparse, Sparse]:
        row, col, style = text_view(*C.view(part.column(body)))
        values = list(zip(*part.column(meta).to_pylist(), strict=True)) or [[]]
        m_row, m_col, m_dense = meta_view([list(v) for v in values], np.asarray(part.column(size)))
        return Sparse(row, col, style, 1 << WORD_BITS), Sparse(m_row, m_col, m_dense, 1 << META_BITS)

    # Features are made once; what follows reads them instead of the texts.
    kept = [c for c in docs.columns if c != body and c.lower() not in {f"p_{t}".lower() for t in targets}]
    parts = {x: C.free_name(docs, "__" + x) for x in ("t", "style", "m", "dense")}

    def features(part: pa.RecordBatch) -> dict:
        t, m = views(part)
        style = pa.array([x.tobytes() for x in t.dense], pa.binary())
        return dict(zip(parts.values(), (packed(t), style, packed(m), pa.array(m.dense[:, 0])), strict=True))

    fields = [T.StructField(x, T.DoubleType() if k == "dense" else T.BinaryType()) for k, x in parts.items()]
    table = C.materialize(C.add_columns(ready, features, fields, body, drop=(body, meta, size)), "features")
    plain = table.select(F.col(f"`{id_col}`").cast("long").alias("__id"), *(F.col(f"`{x}`").alias(y) for x, y in zip(parts.values(), ("t", "style", "m", "size"), strict=True)))

    # A bounded sample of labelled rows, by the smallest hashes of ids, comes to the driver.
    marks = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("__id")).agg(*(F.max(F.col(f"`{t}`").cast("int")).alias(f"__{t}") for t in targets)).where("__id is not null")
    marks = C.materialize(marks, "marks")
    chosen = F.broadcast(C.materialize(marks.join(plain.select("__id").distinct(), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(labelled), "chosen"))  # labelled rows
    rows = plain.join(chosen, "__id").dropDuplicates(["__id"]).orderBy(F.xxhash64("__id")).toArrow().combine_chunks()
    whole = rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], rows.schema)
    text, metas = unpacked(whole)
    ys = [np.array([-1 if v is None else int(v > 0) for v in rows.column(f"__{t}").to_pylist()], int) for t in targets]
    # All rows that lack a label.
    free = F.concat(*(F.when(F.col(f"__{t}").isNull(), F.lit(b"\1")).otherwise(F.lit(b"\0")) for t in targets))
    others = plain.join(C.sized_broadcast(marks, F.lit(8 + 4 * len(targets))), "__id", "left").where(F.coalesce(*(F.when(F.col(f"__{t}").isNull(), True) for t in targets), F.lit(False)))
    crowd = SparkCrowd(others.select("t", "style", "m", "size", free.alias("free")), len(targets))
    shared = spark.sparkContext.broadcast(co_train_all(text, metas, ys, crowd))
    crowd.close()

    def score(part: pa.RecordBatch) -> dict:
        t, m = unpacked(part, tuple(parts.values()))
        return {f"p_{name}": pa.array(sigmoid(model.odds(t, m)), pa.float64()) for name, model in zip(targets, shared.value, strict=True)}

    fields = [T.StructField(f"p_{t}", T.DoubleType()) for t in targets]
    return C.add_columns(table.select(*(F.col(f"`{c}`") for c in [*kept, *parts.values()])), score, fields, parts["t"], drop=parts.values())
