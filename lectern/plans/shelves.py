"""Stored libraries over the shared tables, as a running system has them: built when first asked for, searched from then on.

A library belongs to a session and to the very files it was made from: other paths, sizes or times make a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import search as S
from lectern.operators.stored import Library, Rows, Store, TermIndex
from lectern.operators.vector_blocks import VectorBlocks

_BUILT: dict[tuple, tuple] = {}


def _files(t, tables: Sequence[str]) -> tuple:
    """Path, length and time of every file of ``tables``."""
    out = []
    for name in tables:
        for file in sorted(getattr(t, name).inputFiles()):
            path = t.spark._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(out)


def _once(t, name: str, tables: Sequence[str], build: Callable[[], object]):
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    files = _files(t, tables)
    if key not in _BUILT or _BUILT[key][0] != files:
        _BUILT[key] = (files, build())
    return _BUILT[key][1]


def chunk_words(t, chunks: Callable[[], DataFrame]) -> TermIndex:
    """Keyword index over the texts of ``chunks`` (video_id, chunk_id, text)."""

    def build() -> TermIndex:
        index = TermIndex(Store.temporary(t.spark, "words"), "words")
        with index.store.begin() as change:
            index.put(change, chunks())
        return index

    return _once(t, "chunk_words", ["documents"], build)


def course_library(t, tables: Callable[[], dict[str, DataFrame]]) -> dict:
    """Sentences, chunks, slides and chapters as written rows, with the indexes of in-course search."""

    def build() -> dict:
        store = Store.temporary(t.spark, "library")
        keys = {"segments": "seg_key", "chunks": "chunk_id", "slides": "idx", "chapters": "idx"}
        found = {name: Rows(store, name, ["video_id", key], place="place") for name, key in keys.items()}
        with store.begin() as change:
            for name, rows in tables().items():
                found[name].put(change, rows)
        read = {name: rows.all() for name, rows in found.items()}

        def index(label: str, docs: DataFrame, split=X.tokens, once: bool = False) -> TermIndex:
            made = TermIndex(store, label, split, distinct=once)
            made.put(change, docs, grouped=once)
            return made

        named = lambda table, key, body: read[table].select("video_id", F.col(key).alias("chunk_id"), body.alias("text"))
        rows = S.searchable(*[read[n] for n in ("segments", "chunks", "slides", "chapters")])
        with store.begin() as change:
            indexes = S.Indexes(
                index("segment_words", named("segments", "seg_key", F.col("text"))),
                index("chunk_words", named("chunks", "chunk_id", X.fused_text(F.col("text"), F.col("ocr_text")))),
                index("pieces", S.blocks(rows), S.block_pieces, once=True),
            )
        return {**read, "indexes": indexes}

    return _once(t, "course_library", ["events"], build)


def vector_packs(t, vectors: Callable[[], DataFrame]) -> VectorBlocks:
    """The vectors of the documents, packed."""
    return _once(t, "vectors", ["documents", "embeddings"], lambda: VectorBlocks.pack(vectors()))


def temporary_library(t) -> Library:
    """A library of its own, to be changed by one query."""
    return Library(Store.temporary(t.spark, "changing"))
