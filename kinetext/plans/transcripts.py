"""From original transcripts to a parallel corpus and timing tables: lazy plans without files between the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segments as S
from ..operators import timing


def marked_blocks(blocks: DataFrame, types: DataFrame) -> DataFrame:
    """Original blocks (entry, pos, block_idx, start_ms, end_ms, text) to speakers' blocks with is_full, is_end and pos renumbered."""
    kept = S.split_speakers(S.filter_lines(blocks, types))
    kept = S.renumber(kept, S.KEYS, "pos", "subpos", out="place").drop("pos").withColumnRenamed("place", "pos")
    swapped = S.renumber(S.swap_adjacent(kept), S.KEYS, "sort_key", out="place").drop("pos", "sort_key").withColumnRenamed("place", "pos")
    return S.mark_sentences(swapped)


def parallel_corpus(blocks: DataFrame, types: DataFrame) -> DataFrame:
    """(entry, speaker, full_sentence, glosses, start_ms, end_ms) of complete sentences with allowed glosses."""
    return S.sentence_pairs(S.exclude(marked_blocks(blocks, types))).drop("sid")


def sentence_videos(pairs: DataFrame, root: str) -> DataFrame:
    """Where each sentence stands in which video."""
    from ..functions import text as X

    return pairs.select("full_sentence", F.col("glosses").alias("gloss_sequence"), F.concat(F.lit(root + "/"), "entry", F.lit("/video-"), F.lower("speaker"), F.lit(".mp4")).alias("video_path"), X.ms_to_clock("start_ms", ".").alias("start_time"), X.ms_to_clock("end_ms", ".").alias("end_time"))


def timing_table(blocks: DataFrame, types: DataFrame) -> DataFrame:
    """Raw times of every occurrence of a known gloss that is timed."""
    marked = marked_blocks(blocks, types)
    named = marked.withColumns({"block_index": F.col("pos").cast("string"), "gloss": F.split_part("text", F.lit(":"), F.lit(1))})
    return timing.gloss_times(named, types=S.prune_types(types))
