"""Transcript segmentation: which glosses belong to which sentence.

Blocks are rows (entry, speaker, pos, start_ms, end_ms, text) with boolean
markers is_full (a spoken sentence) and is_end (the last gloss of one). All
state is expressed by windows over one recording's speaker, so a recording is
the unit of parallelism and nothing is ordered across recordings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as X

KEYS = ("entry", "speaker")
# Single tokens that are dropped, and tokens that veto a whole sentence.
EXCLUDED_TOKENS = ("$GEST", "$GEST-NM", "$GEST-OFF", "$$EXTRA-LING-MAN", "$PMS", "$UNKLAR")
VETO_TOKENS, VETO_PREFIX = ("$PROD", "$ORAL", "$ALPHA", "$ORAL^"), "$ALPHA"
# Gloss types that are not timed, by name and by what they contain.
UNTIMED, UNTIMED_PARTS = (*EXCLUDED_TOKENS, "$PROD"), ("$ORAL", "$ALPHA")


def ordered(keys: Sequence[str] = KEYS, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*(order or ("pos",)))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def count_if(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0))


def split_dual(blocks: DataFrame, text: str = "text") -> DataFrame:
    """A block ``A: G1||G2`` becomes one block per gloss with the same interval, numbered by ``subpos``; other blocks keep subpos 0.

    Blocks with || but no label A or B are dropped.
    """
    line, label = F.col(text), r"^(A:|B:)\s*(.*)"
    dual = line.contains("||")
    parts = F.transform(F.split(F.regexp_extract(line, label, 2), r"\|\|"), lambda g: F.concat(F.regexp_extract(line, label, 1), F.lit(" "), F.trim(g)))
    rest = [c for c in blocks.columns if c != text]
    out = blocks.where(~dual | line.rlike(label)).select(*rest, F.posexplode(F.when(dual, parts).otherwise(F.array(line))).alias("subpos", text))
    return out.select(*blocks.columns, "subpos")


def filter_lines(blocks: DataFrame, types: DataFrame, most_ms: int = 2000) -> DataFrame:
    """Keep gloss and sentence lines of an original transcript: cleaned, split, capped, with ``is_full``."""
    from .joins import contains_any

    cleaned = blocks.withColumn("raw", F.col("text")).withColumn("text", X.clean_line("text"))
    cleaned = cleaned.withColumn("was_dual", F.col("text").contains("||"))
    parts = contains_any(split_dual(cleaned), types, "text", "gloss", out="has_gloss")
    full = ~F.col("was_dual") & ~F.col("has_gloss") & X.is_sentence("raw")
    kept = parts.withColumn("is_full", full).where(F.col("was_dual") | F.col("has_gloss") | F.col("is_full"))
    kept = kept.withColumn("end_ms", F.when(F.col("is_full"), F.col("end_ms")).otherwise(X.cap_end("start_ms", "end_ms", most_ms)))
    return kept.drop("raw", "was_dual", "has_gloss")


def split_speakers(blocks: DataFrame) -> DataFrame:
    """``speaker`` and the text without its label; lines of other speakers go."""
    label = r"^([AB]): "
    return blocks.withColumn("speaker", F.regexp_extract("text", label, 1)).where(F.col("speaker") != "").withColumn("text", F.regexp_replace("text", label, ""))


def swap_adjacent(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A gloss followed by a sentence with the same interval changes places with it; the sentence then starts 1 ms earlier. ``sort_key`` is the new order (twice pos, so that it stays whole)."""
    w = ordered(keys)
    full, st, en = F.col("is_full"), F.col("start_ms"), F.col("end_ms")
    after = full & ~F.lag("is_full").over(w) & (F.lag("start_ms").over(w) == st) & (F.lag("end_ms").over(w) == en)
    ahead = ~full & F.lead("is_full").over(w) & (F.lead("start_ms").over(w) == st) & (F.lead("end_ms").over(w) == en)
    marked = blocks.withColumns({"rn": F.row_number().over(w), "after": F.coalesce(after, F.lit(False)), "ahead": F.coalesce(ahead, F.lit(False))})
    key = F.col("rn") + F.when(F.col("after"), -1).when(F.col("ahead"), 1).otherwise(0)
    start = F.when(F.col("after"), F.greatest(F.lit(0).cast("long"), st - 1)).otherwise(st)
    return marked.withColumns({"sort_key": key, "start_ms": start}).drop("rn", "after", "ahead")


def mark_sentences(blocks: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos") -> DataFrame:
    """``is_end`` on the last block of each sentence.

    A sentence takes the glosses after it for as long as each starts before it
    ends; the first that starts later closes it. A sentence without glosses is
    its own end.
    """
    w = ordered(keys, order)
    sid = blocks.withColumn("sid", count_if(F.col("is_full")).over(so_far(w)))
    group = Window.partitionBy(*keys, "sid")
    inner = group.orderBy(order)
    sid = sid.withColumn("sentence_end", F.max(F.when(F.col("is_full"), F.col("end_ms"))).over(group))
    late = (F.col("start_ms") > F.col("sentence_end")) & ~F.col("is_full")
    sid = sid.withColumn("inside", (F.col("sid") > 0) & ~F.coalesce(F.max(late).over(so_far(inner)), F.lit(False)))
    end = F.col("inside") & ~F.coalesce(F.lead("inside").over(inner), F.lit(False))
    return sid.withColumn("is_end", end).drop("sid", "sentence_end", "inside")


def end_groups(blocks: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos") -> DataFrame:
    """``group_id``: the blocks since the last end; ``is_group``: whether the group has an end (else its blocks stand alone)."""
    out = blocks.withColumn("group_id", F.coalesce(count_if(F.col("is_end")).over(before(ordered(keys, order))), F.lit(0)))
    return out.withColumn("is_group", F.max("is_end").over(Window.partitionBy(*keys, "group_id")))


def drop_tokens(blocks: DataFrame, excluded: Sequence[str] = EXCLUDED_TOKENS, out: str = "tokens", text: str = "text") -> DataFrame:
    """``tokens`` of the text without the excluded ones (compared without a marker)."""
    return blocks.withColumn(out, F.filter(X.words(text), lambda x: ~X.base_gloss(x).isin(*excluded)))


def exclude(blocks: DataFrame, excluded: Sequence[str] = EXCLUDED_TOKENS, veto: Sequence[str] = VETO_TOKENS, prefix: str = VETO_PREFIX, keys: Sequence[str] = KEYS, order: str = "pos") -> DataFrame:
    """Drop excluded tokens, empty blocks, and whole groups with a veto token; a group that loses its last block hands the end on to the one before."""
    grouped = drop_tokens(end_groups(blocks, keys, order), excluded)
    kept = grouped.where(F.size("tokens") > 0)
    group = Window.partitionBy(*keys, "group_id")
    vetoed = F.exists("tokens", lambda x: X.base_gloss(x).isin(*veto) | X.base_gloss(x).startswith(prefix))
    lone_veto = F.exists("tokens", lambda x: x.isin(*veto))
    last = F.row_number().over(group.orderBy(F.desc(order))) == 1
    kept = kept.withColumns({"vetoed": F.max(vetoed).over(group), "lone": lone_veto, "is_end": F.col("is_group") & last})
    kept = kept.where(F.when(F.col("is_group"), ~F.col("vetoed")).otherwise(~F.col("lone")))
    return kept.withColumn("text", F.array_join("tokens", " ")).drop("vetoed", "lone", "tokens", "group_id", "is_group")


def prune_types(types: DataFrame, equal: Sequence[str] = UNTIMED, parts: Sequence[str] = UNTIMED_PARTS, column: str = "gloss") -> DataFrame:
    """Distinct types without ^ at their ends, less those that equal one of ``equal`` or contain one of ``parts``. Null types go."""
    out = types.select(F.regexp_replace(column, r"\^+$", "").alias(column)).where(F.col(column).isNotNull() & ~F.col(column).isin(*equal))
    for part in parts:
        out = out.where(~F.contains(F.col(column), F.lit(part)))
    return out.distinct()


def forward_sentences(blocks: DataFrame, own: Column, keys: Sequence[str] = ("entry",), order: str = "pos", sep: str = ",", fps: Column | float = 50) -> DataFrame:
    """Sentences by a scan forward: keys, pos, full_sentence, glosses, start_frame, end_frame.

    ``own`` says which blocks of a file are the speaker's. The first sentence
    since the last end takes all of the speaker's blocks up to the next end,
    itself included; later sentences among them count as glosses and keep
    their marker. A block of another speaker before that end breaks the scan:
    nothing up to it is a sentence. A sentence that is its own end ends a scan
    and opens none.
    """
    rows = blocks.withColumn("own_", F.coalesce(own, F.lit(False)))
    closes = ~F.col("own_") | F.col("is_end")
    rows = rows.withColumn("run_", F.coalesce(count_if(closes).over(before(ordered(keys, order))), F.lit(0)))
    opens = F.col("own_") & F.col("is_full") & ~F.col("is_end")
    text = F.when(F.col("is_full"), F.concat("text", F.lit(X.FULL))).otherwise(F.col("text"))
    found = rows.groupBy(*keys, "run_").agg(
        F.max(F.col("own_") & F.col("is_end")).alias("ended"),
        F.min(F.when(opens, F.struct(F.col(order).alias("at"), "text", "start_ms", "end_ms"))).alias("first"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), text.alias("text")))).alias("all"),  # one sentence's blocks
    ).where(F.col("ended") & F.col("first").isNotNull())
    glosses = F.transform(F.filter("all", lambda x: x["at"] > F.col("first.at")), lambda x: x["text"])
    whole = F.regexp_replace("first.text", "/+$", "")
    return found.select(*keys, F.col("first.at").alias(order), whole.alias("full_sentence"), F.array_join(glosses, sep).alias("glosses"), X.ms_to_frame("first.start_ms", fps).alias("start_frame"), X.ms_to_frame("first.end_ms", fps).alias("end_frame"))


def sentence_rows(blocks: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos", strict: bool = False) -> DataFrame:
    """The blocks of complete sentences with their ``sid``: from the sentence to its end, both included.

    With ``strict``, sentences without a gloss are left out.
    """
    # A sentence that is its own end opens nothing.
    opens = F.col("is_full") & ~F.col("is_end")
    out = blocks.withColumn("sid", count_if(opens).over(so_far(ordered(keys, order))))
    group = Window.partitionBy(*keys, "sid")
    out = out.withColumns({"ended": F.coalesce(F.max("is_end").over(before(group.orderBy(order))), F.lit(False)), "complete": F.max("is_end").over(group)})
    out = out.where((F.col("sid") > 0) & ~F.col("ended") & F.col("complete")).drop("ended", "complete")
    if strict:
        out = out.withColumn("n", count_if(~F.col("is_full")).over(group)).where("n > 0").drop("n")
    return out


def sentence_pairs(blocks: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos", sep: str = ",", strict: bool = False) -> DataFrame:
    """One row per complete sentence: keys, sid, full_sentence, its interval, glosses (joined in order)."""
    rows = sentence_rows(blocks, keys, order, strict)
    full = F.col("is_full")
    glosses = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~full, F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))), lambda x: x["t"]), sep)
    return rows.groupBy(*keys, "sid").agg(
        F.max(F.when(full, F.col("text"))).alias("full_sentence"),
        F.max(F.when(full, F.col("start_ms"))).alias("start_ms"),
        F.max(F.when(full, F.col("end_ms"))).alias("end_ms"),
        glosses.alias("glosses"),
    )


def lost_flags(blocks: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos") -> DataFrame:
    """``lost``: a gloss after the end of its sentence and before the next one; never the end itself."""
    opens = F.col("is_full") & ~F.col("is_end")
    out = blocks.withColumn("sid", count_if(opens).over(so_far(ordered(keys, order))))
    ended = F.coalesce(F.max("is_end").over(before(ordered([*keys, "sid"], order))), F.lit(False))
    return out.withColumn("lost", ~F.col("is_full") & ~F.col("is_end") & ended)


def renumber(blocks: DataFrame, keys: Sequence[str] = KEYS, *order: str, out: str = "block_idx") -> DataFrame:
    return blocks.withColumn(out, F.row_number().over(ordered(keys, *order)))


def every_nth(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Every n-th row of a global order, without gathering the rows."""
    from .joins import running

    return running(df, F.lit(1), order, "before_").where(F.col("before_") % n == n - 1).drop("before_")


def occurrence_names(matches: DataFrame, term: str, name: Column, *order: str) -> DataFrame:
    """``occurrence`` of each match of a term and ``out_name``, with _002 and so on from the second. A term's matches are counted range by range."""
    from .joins import running

    out = running(matches, F.lit(1), order, "before_", [term]).withColumn("occurrence", (F.col("before_") + 1).cast("int")).drop("before_")
    return out.withColumn("out_name", F.when(F.col("occurrence") > 1, F.format_string("%s_%03d", name, F.col("occurrence"))).otherwise(name))


def flagged(df: DataFrame, column: str, value: str = "true") -> DataFrame:
    """Rows whose flag, as text, is the value but for case and blanks at its ends."""
    return df.where(F.lower(F.trim(F.col(column).cast("string"))) == value)


def with_text(blocks: DataFrame, text: str, label: int = 3, column: str = "text") -> DataFrame:
    """Blocks whose text after the label is exactly ``text``."""
    return blocks.where(F.expr(f"substring(`{column}`, {label + 1})") == text)
