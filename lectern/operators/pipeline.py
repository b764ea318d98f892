"""End-to-end transcript structuring as one lineage."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.operators import glossary, library, segments as seg
from lectern.session import settle


class Structured(NamedTuple):
    segments: DataFrame
    chunks: DataFrame
    chapters: DataFrame
    changes: DataFrame | None = None


def structure(
    utterances: DataFrame,
    rules: DataFrame,
    slides: DataFrame,
    *,
    chapter_gap_ms: int = C.CHAPTER_GAP_MS,
    chapter_max_ms: int = C.CHAPTER_MAX_MS,
    old_chunks: DataFrame | None = None,
    old_chapters: DataFrame | None = None,
) -> Structured:
    """Recognised spans -> stitched and corrected sentences -> chunks with slides and parents ->
    chapters. ``utterances``: see ``segments.stitch``, plus text and speaker.

    With ``old_chunks`` and ``old_chapters`` of the same courses (id, title, summary; chunks also text), titles and summaries
    are carried over: those of a chunk whose text is the same, those of a chapter of the same id. ``changes`` then says
    of every chunk whether it is kept, changed, added or gone: what is changed or added needs a new summary and vector.
    """
    stitched = seg.stitch(utterances)
    corrected = glossary.repair(stitched, rules, ["text"]).drop("fixes_text")
    # chunks are read four times below; they are written once, as the chunk table would be
    chunks = settle(seg.build_chunks(corrected, order=["start_ms", "pos"]))
    runs = seg.chapter_runs(chunks, gap_ms=chapter_gap_ms, max_span=chapter_max_ms)
    placed, chapters = seg.with_parents(seg.attach_slides(chunks, slides), runs), seg.chapters_of_runs(runs)
    changes = None
    if old_chunks is not None:
        placed = library.carry_over(_untitled(placed), old_chunks, "chunk_id", same=["text"])
        changes = library.changes(chunks, old_chunks, "chunk_id", ["text"])
    if old_chapters is not None:
        chapters = library.carry_over(_untitled(chapters), old_chapters, "chapter_id")
    return Structured(corrected, placed, chapters, changes)


def _untitled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"title": F.lit(""), "summary": F.lit("")})


def refresh_ocr(chunks: DataFrame, slides: DataFrame, rules: DataFrame) -> DataFrame:
    """New slide text: correct it by the glossary, then rewrite the chunks it changes."""
    fixed = glossary.repair(slides, rules, ["ocr_text"]).drop("fixes_ocr_text")
    return seg.refresh_slide_text(chunks, fixed)
