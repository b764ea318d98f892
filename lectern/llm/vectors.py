"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the hash is the axis it then lies closest
to, with its sign. ``HASHES`` of them make a bucket of a table. A vector lives in one bucket per table and visits the
next likely ones (multiprobe). Vectors that meet are verified by their cosine in double precision, so no
wrong pair is linked. Equal vectors are one class with a count, however many there are.

Buckets of any size are cut into tiles, and tile pairs meet in a join that Spark can split; inside a task pairs become counts and a
forest of links, never rows. Each vector carries its buckets, so a pair that meets several times is counted the first time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import components, forest
from lectern.session import written

COSINE = 0.98
TABLES = 5
HASHES = 2
PROBES = 4
TILE = 512
SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: the own one, then the most likely others."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, tables, 1 + probes), np.int64)
    ranks = min(width, probes + 1)
    rows = np.arange(n)
    for t in range(tables):
        axes, losses = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            order = np.argpartition(-size, ranks - 1, axis=1)[:, :ranks] if ranks < width else np.tile(np.arange(width), (n, 1))
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(size, order, 1), axis=1, kind="stable"), 1)
            best = np.take_along_axis(size, order, 1)
            axes.append(2 * order + (np.take_along_axis(y, order, 1) < 0))
            losses.append((best[:, :1] - best) ** 2)
        base = np.stack([a[:, 0] for a in axes], axis=1)
        weigh = (2 * width) ** np.arange(hashes - 1, -1, -1)
        own = base @ weigh
        # other buckets: one of the hashes takes its second, third, ... axis; the smallest losses first
        others = np.concatenate([own[:, None] + (a[:, 1:] - a[:, :1]) * w for a, w in zip(axes, weigh)], axis=1)
        cost = np.concatenate([loss[:, 1:] for loss in losses], axis=1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        found = others[rows[:, None], pick]
        if found.shape[1] < probes:  # very small widths: fewer other buckets than probes
            found = np.concatenate([found, np.repeat(own[:, None], probes - found.shape[1], axis=1)], axis=1)
        first = (dim * tables + t) * (2 * width) ** hashes
        out[:, t, 0] = own + first
        out[:, t, 1:] = found + first
    return out


def _hash(tables: int, hashes: int, probes: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(vectors: pa.Array) -> pa.Array:
        rows = [np.asarray(v, float) for v in vectors.to_pylist()]
        dims = np.array([len(r) for r in rows], np.int64)
        out = np.empty((len(rows), tables * (1 + probes)), np.int64)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            out[at] = buckets(np.stack([rows[k] for k in at]), tables, hashes, probes).reshape(len(at), -1)
        return pa.array(list(out), pa.list_(pa.int64()))

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, bucket: int, tables: int) -> np.ndarray:
    """Whether ``bucket`` is the first place where the rows of a and b (pairs x tables x buckets) meet."""
    at_b = (a == b[:, :, :1]).any(axis=2)
    at_a = (b == a[:, :, :1]).any(axis=2)
    big = np.iinfo(np.int64).max
    # bucket numbers grow with the table, so the first meeting has the smallest number
    places = np.minimum(np.where(at_b, b[:, :, 0], big), np.where(at_a, a[:, :, 0], big)).min(axis=1)
    return places == bucket


def _compare(cosine: float, tables: int):
    def unpack(cell) -> tuple[np.ndarray, ...]:
        x = np.array([r["embedding"] for r in cell], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.array([r["codes"] for r in cell], np.int64)
        return (
            np.array([r["cls"] for r in cell], np.int64), np.array([r["n"] for r in cell], np.int64), x,
            codes.reshape(len(cell), tables, -1),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_pylist() for c in ("code", "left", "right", "same")]
            cls, add, root = [], [], []
            for code, left, right, same in zip(*cols):
                ida, na, xa, ca = unpack(left)
                idb, nb, xb, cb = (ida, na, xa, ca) if same else unpack(right)
                close = xa @ xb.T >= cosine
                i, j = np.nonzero(np.triu(close, 1) if same else close)
                for at in range(0, len(i), 100_000):
                    u, v = i[at:at + 100_000], j[at:at + 100_000]
                    ok = _first_meeting(ca[u], cb[v], code, tables)
                    u, v = u[ok], v[ok]
                    if not len(u):
                        continue
                    if same:
                        ids, links = ida, np.bincount(u, nb[v], len(ida)) + np.bincount(v, na[u], len(ida))
                        roots = forest(len(ida), u, v)
                    else:
                        ids = np.concatenate([ida, idb])
                        links = np.concatenate([np.bincount(u, nb[v], len(ida)), np.bincount(v, na[u], len(idb))])
                        roots = forest(len(ids), u, v + len(ida))
                    some = np.flatnonzero(links)
                    cls.append(ids[some])
                    add.append(links[some].astype(np.int64))
                    root.append(ids[roots[some]])
            if cls:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (cls, add, root)], names=["cls", "links", "root"])

    return run


def _tiles(codes: DataFrame, tables: int, probes: int, tile: int) -> DataFrame:
    """label, code, resident, part, rows. Only buckets where somebody lives and two or more meet."""
    spots = codes.select("label", "cls", F.posexplode("codes").alias("pos", "code")).select(
        "label", "code", "cls", (F.col("pos") % (1 + probes) == 0).alias("resident")
    )
    # a visit can name the own bucket, in very small widths only
    spots = written(spots.groupBy("label", "code", "cls").agg(F.max("resident").alias("resident")), "spots")
    sizes = spots.groupBy("label", "code").agg(F.count_if("resident").alias("r"), F.count_if(~F.col("resident")).alias("v"))
    sizes = sizes.filter("r >= 1 and r + v >= 2").select(
        "label", "code", F.ceil(F.col("r") / tile).alias("r"), F.greatest(F.lit(1), F.ceil(F.col("v") / tile)).alias("v")
    )
    parts = F.when(F.col("resident"), F.col("r")).otherwise(F.col("v"))
    placed = spots.join(sizes, ["label", "code"]).select(
        "cls", "code", "resident", F.pmod(F.xxhash64("cls"), parts).alias("part")
    )
    return written(
        placed.join(codes, "cls").groupBy("label", "code", "resident", "part")
        .agg(F.collect_list(F.struct("cls", "n", "embedding", "codes")).alias("rows")),
        "tiles",
    )


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows are compared if their labels are equal and not null. A vector that is null, empty, zero, or holds a null or a number
    that is not finite links with nothing, nor do vectors of different length. A null vec_id links like any other but names no
    component; where it stands alone its component_id is null and kept is false. Repeated rows count as vectors. Where axes
    tie, the first is the hash. Vectors of any length are hashed whole, padded to a power of two. Columns other than the
    three play no part, whatever their names. An empty table gives an empty result.
    More tables or probes raise recall, more hashes per table keep buckets small on larger collections.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = written(
        rows.filter(usable).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    codes = written(classes.withColumn("codes", _hash(tables, hashes, probes)("embedding")), "codes")
    tiles = _tiles(codes, tables, probes, tile)
    here = tiles.filter("resident").select("label", "code", F.col("part").alias("a"), F.col("rows").alias("left"))
    there = tiles.select("label", "code", "resident", F.col("part").alias("b"), F.col("rows").alias("right"))
    pairs = here.join(there, ["label", "code"]).filter("not resident or a <= b").select(
        "code", "left", "right", F.expr("resident and a = b").alias("same")
    ).filter("not same or size(left) > 1")
    found = written(pairs.mapInArrow(_compare(cosine, tables), "cls long, links long, root long"), "found")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    known = (
        classes.join(counts, "cls", "left").join(roots, "cls", "left")
        .select("label", "embedding", "first", F.coalesce("root", "cls").alias("root"),
                (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    firsts = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(firsts, "root").select("label", "embedding", "n_links", "component_id")
    joined = rows.filter(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionAll(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return near_duplicates(table(spark, folder, "embeddings"))
