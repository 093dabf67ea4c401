"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. Training words are
streamed through it; the state and the longest matching length after each word
say which windows of which items end there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
#: Words of test items that one automaton may hold (about 1 KB each in a worker); larger benchmarks take several passes.
BLOCK_WORDS = 60_000
NEW = ("n_words", "n_hit", "item_ids", "hit_spans")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(C.WORD_TABLE).split()


def named(items: set[str | None]) -> tuple[str, ...]:
    return tuple(sorted(i for i in items if i is not None))


class Automaton:
    """Suffix automaton over the words of many items; no run crosses from one item to the next."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        short: dict[int, set[str]] = {}
        for _, words in items:
            self._add(words)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        # The state of the last ``window`` words of each state's strings.
        self.anchor = [0] * len(order)
        for v in order:
            up = self.link[v]
            self.anchor[v] = v if v and self.length[v] >= window > self.length[up] else self.anchor[up] if up > 0 else 0
        for item, words in items:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= window:
                    ends.setdefault(self.anchor[v], set()).add(item)
            if 0 < len(words) < window:
                short.setdefault(self._state(words), set()).add(item)
        self.items = {v: named(x) for v, x in ends.items()}
        # Whole short items that are a suffix of a state's strings: (words, items), longest first.
        self.short: dict[int, tuple[tuple[int, tuple[str, ...]], ...]] = {}
        lengths = {self._state(words): len(words) for _, words in items if 0 < len(words) < window}
        for v in order[1:]:
            own = ((lengths[v], named(short[v])),) if v in short else ()
            if found := own + self.short.get(self.link[v], ()):
                self.short[v] = found

    def _state(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v

    def _add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, w: bytes, q: int) -> int:
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            new = len(nxt) - 1
            link[q] = new
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = new
                p = link[p]
            return new

        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else clone(last, w, q)
                continue
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            new, p = len(nxt) - 1, last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else clone(p, w, q)
            last = new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [first, last] of hit words, and the items with a window there."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        known, short, anchor = nxt[0], self.short, self.anchor
        spans: list[list[int]] = []
        items: set[str] = set()
        v = n = 0
        for i, w in enumerate(words):
            if w not in known:
                v = n = 0
                continue
            while w not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v][w]
            n += 1
            reach = 0
            if n >= window:
                reach = n
                items.update(self.items[anchor[v]])
            if v in short:
                for size, who in short[v]:
                    if size <= n:
                        items.update(who)
                        reach = max(reach, size)
            if reach:
                start = i - reach + 1
                while spans and spans[-1][1] >= start - 1:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])
        return spans, items


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Test items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).toLocalIterator():
        words = words_of(bytes(row["text"] or b""))
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["id"], words))
        size += len(words)
    yield block


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, min_span: int | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted strings) and ``hit_spans`` (first and last hit word, merged).

    A window is ``window`` consecutive words of an item, or a whole shorter
    item. Null or empty text has no words; items without words are left out;
    windows of an item with a null id hit but name no item; items that repeat an id are one item; without items nothing is
    hit. With ``min_span``, runs of at least so many hit words are cut from
    the text. Columns of ``docs`` named like a new column are replaced.

    Items that fit one automaton take one pass. For more, each block of them
    reads the texts and writes what it hits, narrow rows of a document's
    number, items and spans; these are merged and joined to the documents once.
    """
    docs = C.as_text(docs, text_col)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in NEW))
    kind = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", kind)]
    new = [*fields, T.StructField(text_col, T.StringType())] if min_span is not None else fields
    blocks = iter(item_blocks(items, item_id, item_text, block_words))
    block, following = next(blocks), next(blocks, None)
    if following is None:
        shared = Shared(docs.sparkSession, block, window)
        return C.add_columns(docs, lambda part: described(part, text_col, shared.scan(part.column(text_col)), min_span), new, text_col)
    row, hit = C.free_name(docs, "__row"), C.free_name(docs, "__hit")
    numbered = C.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # each block must see the same numbers
    found = []
    while block is not None:
        one = numbered.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_hits(Shared(docs.sparkSession, block, window)), "row long, items array<string>, spans array<struct<first: long, last: long>>")
        found.append(C.materialize(one, "hits"))
        block, following = following, next(blocks, None)
    hits = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    hits = hits.select(F.col("row").alias(row), F.struct("items", "spans").alias(hit))
    joined = numbered.join(C.sized_broadcast(C.materialize(hits, "hit"), F.size(f"{hit}.spans") * 16 + F.length(F.array_join(f"{hit}.items", ","))), row, "left")

    def told(part: pa.RecordBatch) -> dict:
        texts = C.texts(part.column(text_col))
        before = ((len(words_of(t)), merge([[s["first"], s["last"]] for s in x["spans"]]) if x else [], x["items"] if x else ()) for t, x in zip(texts, part.column(hit).to_pylist(), strict=True))
        return described(part, text_col, before, min_span)

    return C.add_columns(joined, told, new, text_col, drop=(row, hit))


_BUILT: dict[str, Automaton] = {}


class Shared:
    """A block of items on the workers; each builds its automaton when it first needs it, and keeps the last one."""

    def __init__(self, spark: SparkSession, block: list[tuple[str | None, list[bytes]]], window: int):
        self.key, self.window, self.block = uuid.uuid4().hex, window, spark.sparkContext.broadcast(block)  # block_words bounds it

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[list[int]], set[str]]]:
        """Number of words, spans and items of each text."""
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = Automaton(self.block.value, self.window)
        automaton = _BUILT[self.key]
        for text in C.texts(column):
            words = words_of(text)
            yield len(words), *automaton.scan(words)


def _hits(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text"):
                found = [(i, sorted(items), [{"first": a, "last": b} for a, b in spans]) for i, (_, spans, items) in enumerate(shared.scan(part.column("text"))) if spans]
                rows = part.column("row").take(pa.array([i for i, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([x for _, x, _ in found], pa.list_(pa.string())), pa.array([x for _, _, x in found], SPAN)], names=["row", "items", "spans"])

    return run


def described(part: pa.RecordBatch, text_col: str, found: Iterable[tuple[int, list[list[int]], Iterable[str]]], min_span: int | None) -> dict:
    """The new columns of rows with the given numbers of words, spans and items."""
    n_words, n_hit, ids, spans, cleaned = [], [], [], [], []
    for text, (words, own, items) in zip(C.texts(part.column(text_col)), found, strict=True):
        n_words.append(words)
        n_hit.append(sum(b - a + 1 for a, b in own))
        ids.append(sorted(items))
        spans.append([{"first": a, "last": b} for a, b in own])
        if min_span is not None:
            gone = [x for x in own if x[1] - x[0] + 1 >= min_span]
            cleaned.append(cut(text, gone) if gone else text)
    out = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "item_ids": pa.array(ids, pa.list_(pa.string())), "hit_spans": pa.array(spans, SPAN)}
    if min_span is not None:
        nulls = part.column(text_col).is_null().to_pylist()
        out[text_col] = C.text_array([None if null else x for x, null in zip(cleaned, nulls, strict=True)])
    return out


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the given runs of words (and what stands between their words)."""
    words = np.array([m.span() for m in WORD.finditer(text)])
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = int(words[b][1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", min_span: int = 1, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` with the runs of at least ``min_span`` hit words cut from the text; documents of which more than ``max_coverage`` of the words are hit are dropped.

    Returns the columns of ``docs``. Null or empty texts stay as they are; a
    text that loses nothing stays byte for byte.
    """
    columns = docs.columns
    own = {c: C.free_name(docs, "__own_" + c) for c in columns if c.lower() in NEW}
    docs = docs.withColumnsRenamed(own)
    found = find_contamination(docs, items, text_col, min_span=min_span, **options)
    out = found.where((F.col("n_words") == 0) | (F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage)))
    return out.drop(*NEW).withColumnsRenamed({v: k for k, v in own.items()}).select([F.col(f"`{c}`") for c in columns])
