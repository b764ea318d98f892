"""Exact nearest vectors by cosine, block against block.

Vectors of a course are ordered by the signs of a few fixed random directions, so that like ones are neighbours, and packed into
matrices of at most ``SIZE`` rows with the mean direction and the widest angle from it. Questions of a course are packed too.

A search first bounds every (question, block) by the angle to the block's mean less its width; no vector is touched. Each question
then meets its most promising block, which gives it a score to beat, and after that only blocks whose bound reaches it. Pairs of packs
are multiplied as matrices in Arrow batches, and only the best ``k`` of a question leave a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import ordered
from lectern.session import written

SIZE, ASKED, DIRECTIONS = 1024, 256, 8
#: Scores that agree to so many digits are ties, which go by id; bounds are widened by more than that.
DIGITS, SLACK = 9, 1e-8


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1 (zero rows stay zero), and which rows are zero."""
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length == 0, 1, length)[:, None], length == 0


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of components and the signs along the fixed directions; rows without a whole vector go."""
    signs: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("vec")
        flat = vectors.flatten()
        sizes = np.diff(vectors.offsets.to_numpy())
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        ends = np.cumsum(sizes)
        whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (holes[ends] == holes[ends - sizes])
        rows = np.flatnonzero(whole)
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        codes = np.zeros(len(rows), np.int64)
        for dim in np.unique(sizes[rows]):
            if dim not in signs:
                signs[dim] = np.random.default_rng(int(dim)).normal(size=(dim, DIRECTIONS))
            mine = np.flatnonzero(sizes[rows] == dim)
            matrix = values[(ends[rows[mine]] - dim)[:, None] + np.arange(dim)]
            codes[mine] = ((matrix @ signs[dim] > 0) << np.arange(DIRECTIONS)).sum(axis=1)
        kept = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [kept.column("video_id"), kept.column("chunk_id"), pa.array(sizes[rows].astype(np.int32)), pa.array(codes), kept.column("vec")],
            names=["video_id", "chunk_id", "dim", "code", "vec"],
        )


_BLOCK = "video_id string, dim int, block string, ids array<string>, matrix binary, mean binary, width double, zeros boolean"


def _packer(size: int):
    def pack(key: tuple, number: int, ids: list[str], vectors: list) -> tuple:
        matrix = np.array(vectors, np.float64)
        unit, zero = _unit(matrix)
        mean = unit.sum(axis=0)
        mean /= max(np.sqrt((mean * mean).sum()), 1e-300)
        cosines = np.clip(unit[~zero] @ mean, -1, 1)
        width = float(np.arccos(cosines.min())) if len(cosines) else 0.0
        return (*key[:2], f"{key[2]}-{number}", ids, matrix.tobytes(), mean.tobytes(), width, bool(zero.any()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, ids, vectors = None, 0, [], []
        schema = pa.schema([
            ("video_id", pa.string()), ("dim", pa.int32()), ("block", pa.string()), ("ids", pa.list_(pa.string())), ("matrix", pa.binary()),
            ("mean", pa.binary()), ("width", pa.float64()), ("zeros", pa.bool_()),
        ])
        as_batch = lambda row: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("video_id", "dim", ordered.BLOCK, "chunk_id", "vec")]
            for video, dim, blk, chunk, vec in zip(*columns):
                if key is not None and (key[:2] != (video, dim) or len(ids) == size):
                    yield as_batch(pack(key, number, ids, vectors))
                    number, ids, vectors = number + 1, [], []
                key = (video, dim, blk)
                ids.append(chunk)
                vectors.append(vec)
        if ids:
            yield as_batch(pack(key, number, ids, vectors))

    return run


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _bounds(asked: pa.Array, dims: pa.Array, means: pa.Array, widths: pa.Array, zeros: pa.Array) -> pa.Array:
    """Per question of a pack the most that a vector of the block can score."""
    out = []
    for vectors, dim, mean, width, zero in zip(*[c.to_pylist() for c in (asked, dims, means, widths, zeros)]):
        unit, nought = _unit(np.array(vectors, np.float64))
        angle = np.arccos(np.clip(unit @ np.frombuffer(mean, np.float64), -1, 1)) - width
        bound = np.cos(np.maximum(angle, 0)) + SLACK
        bound = np.where(nought, SLACK, np.maximum(bound, SLACK) if zero else bound)
        out.append(bound.tolist())
    return pa.array(out, pa.list_(pa.float64()))


_HITS = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType())]))


def _best(k: int):
    @F.arrow_udf(_HITS)
    def run(asked: pa.Array, dims: pa.Array, matrices: pa.Array, ids: pa.Array) -> pa.Array:
        """The k best vectors of a block for every question n of a pack."""
        out = []
        for vectors, dim, matrix, names in zip(asked.to_pylist(), dims.to_pylist(), matrices.to_pylist(), ids.to_pylist()):
            unit, _ = _unit(_matrix([matrix], dim))
            scores = _unit(np.array(vectors, np.float64))[0] @ unit.T
            ranked = -np.round(scores, DIGITS)
            hits = []
            for n, row in enumerate(ranked):
                least = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                near = np.flatnonzero(row <= least)
                for i in sorted(near, key=lambda i, row=row: (row[i], names[i].encode()))[:k]:
                    hits.append({"n": n, "chunk_id": names[i], "score": float(scores[n, i])})
            out.append(hits)
        return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("chunk_id", pa.string()), ("score", pa.float64())])))

    return run


class VectorBlocks:
    """Packed vectors of a store (video_id, chunk_id, vec). Null vectors, empty ones and those with null components take no part."""

    def __init__(self, packed: DataFrame):
        self.packed = packed

    @classmethod
    def pack(cls, store: DataFrame, size: int = SIZE) -> VectorBlocks:
        doubles = F.col("vec").cast("array<double>").alias("vec")
        coded = store.select("video_id", "chunk_id", doubles).mapInArrow(
            _coded, "video_id string, chunk_id string, dim int, code long, vec array<double>"
        )
        placed = ordered.blocks(coded, ["video_id", "dim"], ["code", "chunk_id"])
        return cls(written(placed.mapInArrow(_packer(size), _BLOCK), "blocks"))

    def _packs(self, asked: DataFrame, per_pack: int) -> DataFrame:
        """Questions of a course in packs of about ``per_pack``: video_id, dim, pack, qids, asked."""
        rows = asked.select("qid", "video_id", F.col("qvec").cast("array<double>").alias("v"), F.size("qvec").alias("dim")).filter(
            (F.col("dim") > 0) & ~F.exists("v", lambda x: x.isNull())
        )
        packs = rows.groupBy("video_id", "dim").agg(F.ceil(F.count("*") / per_pack).alias("packs"))
        placed = rows.join(packs, ["video_id", "dim"]).withColumn("pack", F.pmod(F.xxhash64("qid"), F.col("packs")))
        listed = F.array_sort(F.collect_list(F.struct("qid", "v"))).alias("q")
        return placed.groupBy("video_id", "dim", "pack").agg(listed).select(
            "video_id", "dim", "pack", F.col("q.qid").alias("qids"), F.col("q.v").alias("asked")
        )

    def _scored(self, wanted: DataFrame, packs: DataFrame, k: int) -> DataFrame:
        """Hits of (video_id, dim, pack, block, ns): the questions at places ``ns`` of a pack against a block."""
        chosen = wanted.join(packs, ["video_id", "dim", "pack"]).select(
            "video_id", "dim", "block", F.transform("ns", lambda n: F.get("qids", n)).alias("qids"), F.transform("ns", lambda n: F.get("asked", n)).alias("asked")
        )
        pairs = chosen.join(self.packed.select("video_id", "dim", "block", "ids", "matrix"), ["video_id", "dim", "block"])
        hits = pairs.select("video_id", "qids", _best(k)("asked", "dim", "matrix", "ids").alias("hits"))
        return hits.select("video_id", "qids", F.explode("hits").alias("h")).select(
            F.get("qids", F.col("h.n")).alias("qid"), "video_id", "h.chunk_id", "h.score"
        )

    def search(self, asked: DataFrame, k: int, per_pack: int = ASKED) -> DataFrame:
        """The ``k`` best of each question (and no fewer of any block that could hold one): qid, video_id, chunk_id, score.
        ``asked``: qid, video_id, qvec; a question meets vectors of its course and of its length."""
        packs = written(self._packs(asked, per_pack), "packs")
        heads = self.packed.select("video_id", "dim", "block", "mean", "width", "zeros")
        bounded = packs.select("video_id", "dim", "pack", "asked").join(heads, ["video_id", "dim"]).select(
            "video_id", "dim", "pack", "block", F.posexplode(_bounds("asked", "dim", "mean", "width", "zeros")).alias("n", "bound")
        )
        keys = ["video_id", "dim", "pack"]
        bounds = written(bounded, "bounds")
        first = bounds.groupBy(*keys, "n").agg(F.max(F.struct("bound", "block")).alias("b")).select(*keys, "n", F.col("b.block").alias("block"))
        grouped = lambda rows: rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("n")).alias("ns"))
        opening = written(self._scored(grouped(first), packs, k), "opening")
        beat = opening.groupBy("qid", "video_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("beat"))
        places = packs.select(*keys, F.posexplode("qids").alias("n", "qid"))
        # a question has one best block, which is done; of the rest only what can reach the score to beat
        rest = (
            bounds.join(first.withColumnRenamed("block", "done"), [*keys, "n"]).filter("block <> done")
            .join(places, [*keys, "n"]).join(beat, ["qid", "video_id"], "left").filter("beat IS NULL OR bound >= beat")
        )
        return opening.unionByName(self._scored(grouped(rest), packs, k))
