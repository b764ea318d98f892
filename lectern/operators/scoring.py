"""Sums of weights over shared terms, block against pack.

Postings go in blocks of documents, questions in packs, both of bounded size; a task meets one with the other and sums in a matrix of
documents x questions. Products never become rows of a shuffle: what leaves the task are scores, or only those that can be among the best.
Where questions ask in their own course only, courses are dealt out first, so that work grows with the courses and not with documents x questions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import written

#: Postings of a block, questions of a pack, sums held at once.
BLOCK, PACK, CELLS = 200_000, 2_000, 500_000
#: Scores are ranked to nine digits outside: what is nearer than this to the last of the best goes along.
SLACK = 1e-8


def _encoded(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number per row, equal where the columns are, in which the first column counts most."""
    out = np.zeros(len(table), np.int64)
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        out = np.unique(out * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True)[1]
    return out


def _places(values: pa.ChunkedArray, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values.combine_chunks(), value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _best(sums: np.ndarray, course: np.ndarray, k: int) -> np.ndarray:
    """Which sums may be among the ``k`` best of their question and course; ``course`` is sorted."""
    out = np.zeros(sums.shape, bool)
    edges = np.flatnonzero(np.concatenate([[True], course[1:] != course[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        part = sums[a:b]
        least = np.partition(part, -k, axis=0)[-k] if b - a > k else 0
        out[a:b] = (part > 0) & (part >= least - SLACK)
    return out


def _summer(keys: list[str], scoped: bool, k: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = lambda block, pack: pa.schema([pack.schema.field("qid"), *[block.schema.field(c) for c in keys], pa.field("score", pa.float64())])

    def run(block: pa.Table, pack: pa.Table) -> pa.Table:
        out = schema(block, pack)
        if not len(block) or not len(pack):
            return out.empty_table()
        course_terms = ["video_id", "term"] if scoped else ["term"]
        place_b, place_p = np.zeros(len(block), np.int64), np.zeros(len(pack), np.int64)
        known = np.ones(len(pack), bool)
        for name in course_terms:
            among = block.column(name).combine_chunks().unique()
            there = _places(pack.column(name), among)
            known &= (there >= 0) & pack.column(name).is_valid().to_numpy()
            place_p, place_b = place_p * len(among) + there, place_b * len(among) + _places(block.column(name), among)
        pack = pack.filter(pa.array(known))
        if not len(pack):
            return out.empty_table()
        place_p = place_p[known]
        order = np.argsort(place_p, kind="stable")
        place_p, idf = place_p[order], pack.column("idf").to_numpy()[order]
        qids = pack.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
        names = qids.dictionary
        doc = _encoded(block, keys)
        by_doc = np.argsort(doc, kind="stable")
        doc, place_b, weight = doc[by_doc], place_b[by_doc], block.column("weight").to_numpy()[by_doc]
        first = np.searchsorted(doc, np.arange(doc[-1] + 1))
        course = _encoded(block, keys[:1])[by_doc][first]
        # a question is a column by its number in its course: the matrix is as wide as the course with most questions, not as the pack
        asked_in, home = np.zeros(len(pack), np.int64), np.zeros(len(first), np.int64)
        if scoped:
            among = block.column("video_id").combine_chunks().unique()
            asked_in, home = _places(pack.column("video_id"), among)[order], _places(block.column("video_id"), among)[by_doc][first]
        askers, asker = np.unique(asked_in * len(names) + qids.indices.to_numpy()[order], return_inverse=True)
        base = np.searchsorted(askers, np.arange(home.max() + 1) * len(names))
        column = asker - np.searchsorted(askers, asked_in * len(names))
        width = column.max() + 1
        low, high = np.searchsorted(place_p, place_b), np.searchsorted(place_p, place_b, "right")
        step, pieces = max(1, CELLS // width), []
        for d in range(0, len(first), step):
            a, b = first[d], first[d + step] if d + step < len(first) else len(doc)
            n = (high - low)[a:b]
            row = np.repeat(np.arange(a, b), n)
            asked = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            docs = min(step, len(first) - d)
            cell = (doc[row] - d) * width + column[asked]
            sums = np.bincount(cell, weight[row] * idf[asked], docs * width).reshape(docs, width)
            kept = sums > 0 if k is None else _best(sums, course[d:d + docs], k)
            rows, asks = np.nonzero(kept)
            found = block.select(keys).take(pa.array(by_doc[first[d + rows]]))
            of = askers[base[home[d + rows]] + asks] % len(names)
            pieces.append(pa.Table.from_arrays([names.take(pa.array(of)), *found.columns, pa.array(sums[rows, asks])], schema=out))
        return pa.concat_tables(pieces).combine_chunks()

    return run


def sums(found: DataFrame, asked: DataFrame, keys: Sequence[str], scoped: bool, k: int | None = None) -> DataFrame:
    """qid, the ``keys`` of documents and ``score``, the sum of weight x idf over shared terms, where there is one.

    ``found``: ``keys`` (the course ``video_id`` is the first), term, weight > 0; ``asked``: qid, video_id, term, idf > 0. ``scoped``: only documents of
    the question's course. With ``k`` only scores that may be among the ``k`` best of a question in a course are given, and ties.
    """
    keys = list(keys)
    asked = written(asked.select("qid", "video_id", "term", "idf"), "asked")
    if scoped:  # what no question of its course asks for is neither written nor shuffled
        found = found.join(asked.select("video_id", "term").distinct(), ["video_id", "term"], "left_semi")
    found = written(found.select(*keys, "term", "weight"), "weights")
    # with a course on both sides courses are dealt out first; only a part that is too large meets in several blocks and packs
    count = lambda df, n, size: df.select(F.ceil(2 * n / size).alias("n")).scalar()
    parts = F.greatest(F.lit(1), count(found, F.count("*"), BLOCK), count(asked, F.countDistinct("qid"), PACK)) if scoped else F.lit(1)
    part = F.pmod(F.xxhash64("video_id"), parts) if scoped else F.lit(0).cast("long")
    left, right = found.withColumn("_part", part), asked.withColumn("_part", part)
    blocks = left.groupBy("_part").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    packs = right.groupBy("_part").agg(F.greatest(F.lit(1), F.ceil(F.countDistinct("qid") / PACK)).alias("_packs"))
    sizes = written(blocks.join(packs, "_part"), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    by = ["_part", "_block", "_pack"]
    left = left.join(sizes, "_part").withColumn("_block", F.pmod(F.xxhash64(*keys), "_blocks")).withColumn("_pack", every("_packs"))
    right = right.join(sizes, "_part").withColumn("_pack", F.pmod(F.xxhash64("qid"), "_packs")).withColumn("_block", every("_blocks"))
    left, right = (rows.drop("_blocks", "_packs") for rows in (left, right))
    schema = T.StructType([asked.schema["qid"], *[found.schema[c] for c in keys]]).add("score", "double")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_summer(keys, scoped, k), schema)
