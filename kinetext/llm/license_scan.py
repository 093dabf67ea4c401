"""License scanning by diagonal voting.

All rolling word k-grams of the documents are joined by hash to their
positions in license templates. Matches of one template vote for a diagonal,
document position minus template position; neighbouring diagonals merge, and a
span counts once enough of the template's grams stand in it.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Words of a gram of base templates and of others, how far diagonals may lie apart to merge, and the share of a template's grams that a span must have.
K_BASE, K, DRIFT, SHARE = 2, 3, 3, 0.6
#: A span remembers which of its template's grams it has, this many to a long; the longest template says how many longs.
MASK_BITS = 63


@dataclass(frozen=True)
class Template:
    """``base`` templates count wherever their words stand consecutively; others wherever a span is close enough."""

    label: str
    text: str
    base: bool = False

    @property
    def grams(self) -> int:
        return len(self.text.split()) - (K_BASE if self.base else K) + 1


BASE = [Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True)]
#: Sentences by which well-known public licenses are told: what they grant, what they ask for, and what they disclaim.
MORE = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    Template("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    Template("boost", "distributed under the boost software license version 1 0"),
    Template("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa-notice", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
]


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of 0-9, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(C.lower_az(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(words: Column) -> Column:
    """Each word with the two after it: array of (w, x, y); what lies beyond the end is null."""
    after = lambda n: F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))
    return F.arrays_zip(words.alias("w"), after(1).alias("x"), after(2).alias("y"))


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """Columns no, at, a, b, c and hash (of a and b); c is null where a gram has two words."""
    rows = []
    for no, t in enumerate(templates):
        words = t.text.split()
        rows += [(no, i, words[i], words[i + 1], None if t.base else words[i + 2]) for i in range(t.grams)]
    return spark.createDataFrame(rows, "no int, at int, a string, b string, c string").withColumn("hash", F.xxhash64("a", "b"))


def find_licenses(docs: DataFrame, templates: list[Template] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``places`` and ``spans``.

    ``places``: (label, start) of each base template's occurrence. ``spans``:
    (label, start, stop, share) of each other template's span; share is the
    part of its grams found. Both are sorted by start. Null or empty text has
    no words and no finds. Repeated rows are scanned each. Columns of ``docs``
    named like a new one are replaced; its columns must be of types that can
    be grouped, and may have any names.
    """
    templates = BASE + MORE if templates is None else templates
    lengths = [t.grams for t in templates]
    masks = range(-(-max([1, *lengths]) // MASK_BITS))
    spark = docs.sparkSession
    row = C.free_name(docs, "__row")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "places", "spans", text_col.lower())]
    index = template_grams(spark, templates)
    index = C.sized_broadcast(index, F.length("a") + F.length("b") + F.coalesce(F.length("c"), F.lit(0)))
    # The caller's columns travel as one struct, so that their names meet no others.
    own = F.struct(F.monotonically_increasing_id().alias(row), *(F.col(f"`{c}`") for c in kept))
    words = docs.select(own.alias("own"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    pairs = words.select("own", F.posexplode_outer(grams(F.col("words"))).alias("place", "gram"))
    pairs = pairs.select("own", "place", F.col("gram.w").alias("w"), F.col("gram.x").alias("x"), F.col("gram.y").alias("y")).withColumn("hash", F.xxhash64("w", "x"))
    same = (pairs["hash"] == index["hash"]) & (pairs["w"] == index["a"]) & (pairs["x"] == index["b"]) & (index["c"].isNull() | (pairs["y"] == index["c"]))
    hits = pairs.join(index, same, "left").select("own", "place", "no", F.when(F.col("no").isNotNull(), F.col("place") - F.col("at")).alias("diagonal"), "at")
    # A document's grams are in one task: the partial aggregate leaves a record for it and one for each of its diagonals.
    grams_seen = [F.bit_or(F.when(F.col("at").between(MASK_BITS * i, MASK_BITS * (i + 1) - 1), F.expr(f"shiftleft(1L, at - {MASK_BITS * i})"))).alias(f"g{i}") for i in masks]
    votes = hits.groupBy("own", "no", "diagonal").agg(F.count("place").alias("n"), *grams_seen, F.max("place").alias("last"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    meta = F.create_map(*(x for no, (t, n) in enumerate(zip(templates, lengths, strict=True)) for x in (F.lit(no), F.struct(F.lit(t.label).alias("label"), F.lit(n).alias("grams"), F.lit(t.base).alias("base")))))
    votes = votes.withColumn("t", F.element_at(meta, F.col("no")))
    exact = F.col("t.base") & (F.col("n") == F.col("t.grams"))
    # Neighbouring diagonals of one template merge while each is within DRIFT of the one before and starts near where it ends.
    by = Window.partitionBy("own", "no").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    votes = votes.withColumn("group", F.sum(F.when((gap <= DRIFT) & ~F.col("t.base"), 0).otherwise(1)).over(by))
    spans = votes.groupBy("own", "no", "group").agg(
        *(F.bit_or(f"g{i}").alias(f"g{i}") for i in masks), F.max("last").alias("last"), F.min(F.col("diagonal") + F.col("lo")).alias("start"), F.max(F.col("diagonal") + F.col("hi") + K).alias("stop"),
        F.max(exact).alias("exact")).withColumn("t", F.element_at(meta, F.col("no")))
    share = reduce(add, (F.coalesce(F.bit_count(f"g{i}"), F.lit(0)) for i in masks)) / F.col("t.grams")
    place = F.when(F.col("exact"), F.struct(F.col("start"), F.col("t.label").alias("label")))
    span = F.when(~F.col("t.base") & (share >= SHARE) & (F.col("stop") - F.col("start") <= 2 * (F.col("t.grams") + K)), F.struct("start", "stop", F.col("t.label").alias("label"), share.alias("share")))
    out = spans.groupBy("own").agg(
        F.max(F.col("last") + 1).alias("most"),
        F.array_sort(F.collect_list(place)).alias("places"), F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select(*(F.col(f"own.`{c}`") for c in kept), F.coalesce("most", F.lit(0)).cast("long").alias("n_words"), "places", "spans")


def summarize(found: DataFrame) -> DataFrame:
    """From ``find_licenses``: counts, first and last place, labels and a score from 0 to 1 (1 with a base place, else the best span's share)."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return found.withColumns({
        "n_base": F.size("places").cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": F.array_join(base, ","), "labels": F.array_join(every, ","), "score": F.when(F.size("places") > 0, 1.0).otherwise(best.cast(T.DoubleType())),
    })
