"""Many terms looked for in one pass over the texts.

The terms become an automaton (Aho and Corasick) that reads a text once,
whatever their number, and finds all of their occurrences, overlapping ones too.
A worker builds it once from a broadcast list. A list that is too long for one
automaton is cut into blocks by the terms' hashes, and the texts pass one
automaton after the other. Texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the terms of one automaton: a few dozen bytes each in a worker.
BLOCK_CHARS = 4 << 20

_BUILT: dict[str, object] = {}


def automaton(key: str, words: Broadcast):
    """The automaton of a block, built once a worker; the one before is let go. None without terms."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words.value:
            found.add_word(w)
        found.make_automaton()
        _BUILT[key] = found if len(found) else None
    return _BUILT[key]


def blocks(terms: DataFrame, term: str) -> list[tuple[str, Broadcast]]:
    """The distinct terms (neither null nor empty) in blocks of about BLOCK_CHARS, each broadcast."""
    words = terms.select(F.col(term).cast("string").alias("w")).where(F.length("w") > 0).distinct()
    total = words.agg(F.sum(F.length("w").cast("long") + 8)).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    block: Column = F.pmod(F.xxhash64("w"), F.lit(max(1, n)))
    found = []
    for i in range(n):  # one block at a time comes to the driver
        own = words.where(block == i).toArrow().column("w").to_pylist()
        found.append((uuid.uuid4().hex, terms.sparkSession.sparkContext.broadcast(own)))
    return found


def term_positions(texts: DataFrame, terms: DataFrame, ids: Sequence[str], text: str = "text", term: str = "term") -> DataFrame:
    """Every occurrence of every term: the columns ``ids`` of the text, the term, and where it starts (characters, from 0).

    Occurrences may overlap one another and themselves. Repeated terms count
    once, null and empty ones not at all; null texts hold none.
    """
    slim = texts.select(*ids, F.col(text).cast("string").alias("text_"))
    fields = [*slim.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("start", T.LongType())]
    names = list(ids)

    def finder(key: str, words: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = automaton(key, words)
            for batch in batches:
                row, found, start = [], [], []

                def out(batch=batch) -> pa.RecordBatch:
                    at = pa.array(row, pa.int64())
                    done = pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(found, pa.string()), pa.array(start, pa.int64())], names=[f.name for f in fields])
                    row.clear(), found.clear(), start.clear()
                    return done

                for i, x in enumerate(batch.column("text_")):
                    x = x.as_py()
                    for last, n in tree.iter(x) if x else ():
                        row.append(i)
                        found.append(x[last + 1 - n : last + 1])
                        start.append(last + 1 - n)
                        if len(row) >= 100_000:
                            yield out()
                yield out()

        return run

    parts = [slim.mapInArrow(finder(*b), T.StructType(fields)) for b in blocks(terms, term)]
    if not parts:
        return slim.select(*names, F.lit("").alias("term"), F.lit(0).cast("long").alias("start")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def terms_in(texts: DataFrame, terms: DataFrame, text: str, term: str, out: str = "terms", first: bool = False) -> DataFrame:
    """``texts`` with ``out``: the terms that the text contains, each once, in order; with ``first`` none but the one that ends first."""
    names = texts.columns
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def marker(key: str, words: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = automaton(key, words)
            for batch in batches:
                found = []
                for x, before in zip(batch.column(text), batch.column(out), strict=True):
                    x, before = x.as_py(), before.as_py()
                    if not x or (first and before):
                        found.append(before)
                    elif first:
                        found.append(next(([x[last + 1 - n : last + 1]] for last, n in tree.iter(x)), before))
                    else:
                        found.append(sorted({*before, *(x[last + 1 - n : last + 1] for last, n in tree.iter(x))}))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.string()))], names=[*names, out])

        return run

    marked = texts.withColumn(out, F.array().cast("array<string>"))
    for b in blocks(terms, term):
        marked = marked.mapInArrow(marker(*b), schema)
    return marked
