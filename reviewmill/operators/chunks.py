"""Overlapping sentence chunks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.fixed import CHUNK_CHARS, CHUNK_OVERLAP
from reviewmill.functions.text import norm_ws

# A sentence ends with one of these and is followed by spaces.
SENTENCE_GAP = r"(?<=[.!?]) +"


def sentence_split(normalized: Column) -> Column:
    return F.split(normalized, SENTENCE_GAP)


def hard_split(sentences: Column, target: int) -> Column:
    """Optional: cut sentences that cannot fit a chunk into pieces that do."""
    width = target - 2

    def pieces(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / width))
        return F.transform(starts, lambda i: F.substr(s, (i * width + 1).cast("int"), F.lit(width)))

    return F.flatten(F.transform(sentences, pieces))


def chunk_starts(sentences: Column, target: int = CHUNK_CHARS) -> Column:
    """Position of the first sentence of each chunk.

    Greedy: a sentence joins the chunk while that stays below ``target`` characters. The chunk
    counts a joining space before each sentence, but not before one that opened it by not
    fitting. A first sentence too long for any chunk leaves an empty chunk before it. The fold
    carries lengths only; no text is copied until the chunks are cut.
    """
    lengths = F.transform(sentences, lambda s: F.length(s))
    start = F.struct(
        F.array(F.lit(0)).alias("starts"), F.lit(0).alias("open"), F.lit(0).alias("next")
    )

    def add(state: Column, length: Column) -> Column:
        grown = state["open"] + length + 1
        fits = grown < target
        return F.struct(
            F.when(fits, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(state["next"])))
            .alias("starts"),
            F.when(fits, grown).otherwise(length).alias("open"),
            (state["next"] + 1).alias("next"),
        )

    return F.aggregate(lengths, start, add, lambda state: state["starts"])


def chunk_join(sentences: Column, starts: Column) -> Column:
    """The text of each chunk."""

    def cut(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(sentences))
        return F.array_join(F.slice(sentences, start + 1, end - start), " ")

    return F.transform(starts, cut)


def chunk_pack(sentences: Column, target: int = CHUNK_CHARS) -> Column:
    """Sentences of a text that is not blank, packed into chunks.

    ``packed_chunks`` does the same for whole tables, with each step evaluated once.
    """
    return chunk_join(sentences, chunk_starts(sentences, target))


def chunk_overlap(
    packed: Column, target: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP
) -> Column:
    """Each chunk with the tail of the one before, cut to ``target + overlap`` characters."""
    if overlap <= 0:
        return packed

    def widen(chunk: Column, i: Column) -> Column:
        before = F.get(packed, i - 1)
        joined = F.when(i == 0, chunk).otherwise(F.concat(before, F.lit(" "), chunk))
        return F.substr(joined, F.lit(-(target + overlap)))

    return F.when(F.size(packed) > 1, F.transform(packed, widen)).otherwise(packed)


def chunk_texts(
    text: Column,
    target: int = CHUNK_CHARS,
    overlap: int = CHUNK_OVERLAP,
    split_long: bool = False,
) -> Column:
    """All chunks of a text; missing or blank text has none."""
    normalized = norm_ws(F.coalesce(text, F.lit("")))
    sentences = sentence_split(normalized)
    if split_long:
        sentences = hard_split(sentences, target)
    chunks = chunk_overlap(chunk_pack(sentences, target), target, overlap)
    return F.when(normalized != "", chunks).otherwise(F.array().cast("array<string>"))


def packed_chunks(df: DataFrame, text: str, target: int = CHUNK_CHARS, split_long: bool = False) -> DataFrame:
    """``df`` with the chunks of its texts, before they overlap, in ``_packed``.

    The steps are separate projections, so that each is evaluated once per row. In one expression
    the split and the fold are evaluated again for every chunk, as its lambda refers to them.
    """
    sentences = sentence_split(norm_ws(F.col(text)))
    if split_long:
        sentences = hard_split(sentences, target)
    return (
        df.withColumn("_sentences", sentences)
        .withColumn("_starts", chunk_starts(F.col("_sentences"), target))
        .withColumn("_packed", chunk_join(F.col("_sentences"), F.col("_starts")))
    )


def explode_chunks(
    df: DataFrame, text: str = "review_text", target: int = CHUNK_CHARS,
    overlap: int = CHUNK_OVERLAP, split_long: bool = False,
) -> DataFrame:
    """One row per non-empty chunk, with ``chunk_no`` and ``chunk_text``.

    The explode is an outer one: for an inner one the optimizer adds a filter on the array's size
    and pushes it, with a copy of the whole fold, below the projections.
    """
    present = df.filter(F.col(text).isNotNull() & (F.length(text) > 0))
    packed = packed_chunks(present, text, target, split_long)
    worked = packed.withColumn("_chunks", chunk_overlap(F.col("_packed"), target, overlap))
    others = [c for c in df.columns if c != text]
    return (
        worked.select(*others, F.posexplode_outer("_chunks").alias("chunk_no", "chunk_text"))
        .filter(F.col("chunk_text") != "")
    )
