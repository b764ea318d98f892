"""Shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to 2^bits steps; documents are sorted by the curve index of their cell and cut into
runs of equal counts, so each shard covers a compact region and a filter on any of the dimensions skips
most shards. Only DataFrame functions. The curve index is computed once per cell that occurs (at most 2^(3 * bits)),
and global positions come from range-partitioned blocks with carried counts, never from one sorted task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import ordered
from lectern.session import written

SHARDS = 16
BITS = 5


def hilbert_index(point: list[Column], bits: int) -> Column:
    """Position of an integer point on the Hilbert curve through a cube of side 2^bits.

    A fold over the bits from the highest: each step reads one bit of every coordinate as a corner of a
    cube, turns it into the current orientation, and takes its rank in Gray-code order.
    """
    n = len(point)
    mask = (1 << n) - 1
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entries = F.array(*[F.lit(gray(2 * ((w - 1) // 2)) if w else 0) for w in range(1 << n)])
    turns = F.array(*[F.lit((ones(w - 1 if w % 2 == 0 else w) if w else 0) % n) for w in range(1 << n)])
    ranks = F.array(*[F.lit(w) for _, w in sorted((gray(w), w) for w in range(1 << n))])
    right = lambda x, k: F.call_function("shiftright", x, k)
    left = lambda x, k: F.call_function("shiftleft", x, k)

    def rotate(x: Column, k: Column) -> Column:
        """n-bit rotation to the left by k of 0..n"""
        return left(x, k).bitwiseOR(right(x, F.lit(n) - k)).bitwiseAND(F.lit(mask))

    def step(state: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for nth, axis in enumerate(point):
            corner = corner.bitwiseOR(F.shiftleft(right(axis.cast("int"), bit).bitwiseAND(F.lit(1)), nth))
        turn = state["turn"] + 1
        seen = rotate(corner.bitwiseXOR(state["entry"]), F.lit(n) - turn)
        rank = F.get(ranks, seen)
        return F.struct(
            (state["index"] * (1 << n) + rank).alias("index"),
            state["entry"].bitwiseXOR(rotate(F.get(entries, rank), turn)).alias("entry"),
            ((state["turn"] + F.get(turns, rank) + 1) % n).alias("turn"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda s: s["index"])


def _named(column: str) -> Column:
    """Sorts with null last and joins like any string."""
    return F.coalesce(F.concat(F.lit("a"), F.col(column).cast("string")), F.lit("z"))


def _codes(rows: DataFrame, column: str, into: str, bits: int) -> DataFrame:
    """The rank of every distinct value, scaled to 2^bits steps."""
    values = rows.select(column).distinct()
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(column)) - 1
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    step = F.floor(nth * F.least(F.lit(1.0), F.lit(float(1 << bits)) / total)).cast("int")
    return values.select(column, step.alias(into))


def shards(docs: DataFrame, n: int = SHARDS, bits: int = BITS, names: tuple[str, ...] = ("lang", "source"), keep: bool = False) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, cell index, shard, slot and, with ``keep``, all columns in ``doc``.

    Counts of shards differ by one at most; slots are gapless from 0. Equal texts take the smallest index of their
    group and are neighbours on the curve, so a group is in one shard unless a cut falls into it. Dimensions are the columns
    ``names`` by rank of their values (null last) and the size by its logarithm. A null text has size 1 and crc 0, an empty
    one size 1. Rows of one cell are ordered by text hash, size and doc_id (null first); rows that repeat all of these are
    alike. A very long text is one row like any other. Columns of ``docs`` are kept inside ``doc``, so their names cannot
    clash. An empty table gives an empty result.
    """
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_hash"),
        *[_named(c).alias(f"_v{k}") for k, c in enumerate(names)],
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep else []),
    )
    # texts are read once; ranks, cells and groups come from the narrow table
    rows = written(rows, "shard-rows")
    rows = rows.withColumn(f"_c{len(names)}", F.least(F.floor(F.log2("size") * 1.5), F.lit((1 << bits) - 1)).cast("int"))
    for k in range(len(names)):
        rows = rows.join(_codes(rows, f"_v{k}", f"_c{k}", bits), f"_v{k}")
    axes = [f"_c{k}" for k in range(len(names) + 1)]
    # cells are bounded by the number of bits: 2^15 with three dimensions of five
    cells = rows.select(*axes).distinct().withColumn("index", hilbert_index([F.col(a) for a in axes], bits))
    rows = rows.join(F.broadcast(cells), axes).drop(*axes, *[f"_v{k}" for k in range(len(names))])
    groups = rows.groupBy("_hash", "size").agg(F.min("index").alias("_low"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(groups, ["_hash", "size"], "left").withColumn("index", F.coalesce("_low", "index")).drop("_low")
    order = ["index", "_hash", "size", "doc_id"]
    placed = ordered.blocks(rows.withColumn("_all", F.lit(0)), ["_all"], order)
    total = placed.count()
    placed = ordered.prefix(placed, ["_all"], order, {"nth": ("count", F.lit(1))})
    # whole numbers only, so that the cuts are exact
    shard = F.expr(f"cast(nth * {n} div {max(total, 1)} as int)")
    begin = F.expr(f"(cast(shard as bigint) * {total} + {n - 1}) div {n}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("nth") - begin).select(
        "doc_id", "size", "text_crc32", "index", "shard", "slot", *(["doc"] if keep else [])
    )


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, rows_per_file: int = 1_000_000) -> None:
    """Documents as Parquet, one folder per shard, in curve order inside the files; the files' own statistics
    on the dimensions then prune reads."""
    placed = shards(docs, n, keep=True)
    placed.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").select(
        "doc.*", F.col("shard").alias("shard")
    ).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
