"""SimHash near-duplicates: whole-text fingerprints, then an exact tiled comparison.

Fingerprints that occur are compared once each, however many documents share them. A tile holds
fingerprints whose four 16-bit quarters have the same population counts. Two fingerprints at most
``radius`` bits apart have quarter counts at most ``radius`` apart in sum, so only pairs of tiles
within that distance are compared, by numpy exclusive-or and bit counts; all others are skipped.
No candidate is lost and there is no cap: a crowded cell is cut into several tiles, and each pair of those meets.
Inside a task the links found are reduced to a forest, so a group of thousands of near copies costs links in the
number of its members, not pairs. More than four quarters prune harder; ``segments`` sets that.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import components, forest
from lectern.session import written

RADIUS = 3
SEGMENTS = 4
TILE = 1024
_GUARD = 32  # base of the cell number: counts reach 16, and +-RADIUS must not carry over


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> bytes:
    """Eight big-endian bytes; zero for a text without words."""
    words = raw.lower().split()
    n = len(words)
    if n == 0:
        return bytes(8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n < width:
        hashes = [digest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: n - width + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(begins, ends[width - 1:].tolist())]
    m = len(hashes)
    raw_bits = np.frombuffer(b"".join(hashes), np.uint8).reshape(m, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, m, 65_280):
        counts += _bit_sums(raw_bits[at:at + 65_280])
    return np.packbits(2 * counts > m).tobytes()


def _bit_sums(rows: np.ndarray) -> np.ndarray:
    """Ones per bit position. Eight byte-wide counters are added as one 64-bit number, 255 rows at a time."""
    bits = np.unpackbits(rows, axis=1).view(np.uint64)
    whole = len(bits) // 255 * 255
    total = np.zeros(64, np.int64)
    if whole:
        total += np.add.reduce(bits[:whole].reshape(-1, 255, 8), axis=1).view(np.uint8).sum(axis=0, dtype=np.int64)
    if whole < len(bits):
        total += np.add.reduce(bits[whole:], axis=0).view(np.uint8)
    return total


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    values = texts.cast(pa.binary()).to_pylist()
    raw = b"".join(fingerprint(v) if v else bytes(8) for v in values)
    return pa.array(np.frombuffer(raw, ">i8").astype(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long. Null and wordless texts get zero."""
    return docs.withColumn(into, _fingerprints(F.col(text)))


def _cell(segments: int):
    """Population counts of the segments as the digits of one number."""
    width = 64 // segments
    total = F.lit(0).cast("long")
    for k in range(segments):
        mask = ((1 << width) - 1) << (k * width)
        mask -= 1 << 64 if mask >= 1 << 63 else 0
        count = F.bit_count(F.col("fp").bitwiseAND(F.lit(mask).cast("long"))).cast("long")
        total = total * _GUARD + count + RADIUS + 1
    return total


def _steps(segments: int, radius: int) -> list[int]:
    """Differences of cell numbers within the radius: zero and one of each pair of opposites."""
    steps = []
    for vector in itertools.product(range(-radius, radius + 1), repeat=segments):
        if sum(map(abs, vector)) <= radius and vector >= (0,) * segments:
            number = 0
            for v in vector:
                number = number * _GUARD + v
            steps.append(number)
    return steps


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            left, right, same = (batch.column(i) for i in range(3))
            lv, lo = left.values.to_numpy(zero_copy_only=False).view(np.uint64), left.offsets.to_numpy()
            rv, ro = right.values.to_numpy(zero_copy_only=False).view(np.uint64), right.offsets.to_numpy()
            out_a, out_b = [], []
            for k, one in enumerate(same.to_pylist()):
                a, b = lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]]
                close = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                i, j = np.nonzero(np.triu(close, 1) if one else close)
                if not len(i):
                    continue
                nodes = a if one else np.concatenate([a, b])
                root = forest(len(nodes), i, j if one else j + len(a))
                linked = np.flatnonzero(root != np.arange(len(nodes)))
                out_a.append(nodes[root[linked]])
                out_b.append(nodes[linked])
            if out_a:
                yield pa.record_batch(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"]
                )

    return run


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints, enough of them to connect all that are within
    ``radius`` bits of each other. ``prints`` has a column fp; nulls are ignored."""
    if radius > RADIUS:
        raise ValueError(f"radius is at most {RADIUS}")
    cells = prints.select("fp").filter("fp is not null").distinct().withColumn("cell", _cell(segments))
    cells = written(cells, "cells")
    # one row per cell: at most 17^4 with four segments
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    if segments <= 4:
        sizes = F.broadcast(sizes)
    tiles = written(
        cells.join(sizes, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    here = tiles.select("cell", F.col("part").alias("part_a"), F.col("fps").alias("left"))
    near = tiles.select(
        F.explode(F.array(*map(F.lit, _steps(segments, radius)))).alias("step"), "cell",
        F.col("part").alias("part_b"), F.col("fps").alias("right"),
    ).select((F.col("cell") + F.col("step")).alias("cell"), "step", "part_b", "right")
    pairs = here.join(near, "cell").filter("step <> 0 or part_a <= part_b").select(
        "left", "right", F.expr("step = 0 and part_a = part_b").alias("same")
    )
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def _groups(prints: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """Adds component_id, kept and copies to prints (doc_id, text_hash, key); see ``near_duplicates``."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    # one row per print, then one per component: both aggregates combine before they shuffle
    heads = prints.groupBy(key).agg(F.min(order).alias("first"))
    rooted = heads.join(roots.withColumnRenamed("node", key), key, "left").select(
        key, "first", F.coalesce("root", key).alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("head"))
    places = rooted.join(firsts, "root").select(key, "head")
    repeats = (
        prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
        .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "copies")
    )
    return (
        prints.join(places, key)
        .join(repeats, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
        .select(
            "doc_id", "text_hash", key, F.col("head.d").alias("component_id"),
            (F.col("doc_id").eqNullSafe(F.col("head.d")) & (F.col("text_hash") == F.col("head.h"))).alias("kept"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
        )
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id, kept, copies.

    component_id is the smallest doc_id reachable over links, itself included (null ids do not
    count; a component of null ids only gets null). ``text_hash`` and doc_id tell rows apart.
    ``kept`` marks the first row of each component by (doc_id, text_hash), nulls last; rows equal in both are
    alike and all carry the mark, ``copies`` says how many there are. Texts that are null, empty or white have
    fingerprint zero and form one group like any other. A bit set in exactly half the shingles is 0. A very long text is
    fingerprinted whole, inside its row. Columns other than doc_id and text play no part, whatever their names. An empty
    table gives an empty result.
    """
    prints = written(
        with_fingerprint(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"),
        "prints",
    )
    return _groups(prints, "fp", components(links(prints, radius)))


# ------------------------------------------------------------------ similarity on five-word shingles

WORDS = 5
SIMILARITY = 0.8
#: Most bits in which candidates differ, in the first 64 and in all 256. Texts of similarity 0.8 differ in 9.7 and 38.8 bits on
#: average (deviations 2.9 and 5.7), short ones in up to half as many more, as their votes often tie; unrelated ones in 32 and 128.
WIDE_RADIUS = (22, 72)
WIDE_TILE = 8192
#: Most texts and shingles of a block whose sets are compared in memory; a single longer text is a block of its own.
BLOCK = (512, 500_000)
#: Shingles in more texts of a block than this are counted by a matrix product, others pair by pair.
OFTEN = 32
_WIDE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("whole", T.LongType()),
])


def shingle_set(raw: bytes) -> np.ndarray:
    """Different 64-bit hashes of the five-word shingles, ascending; a text of fewer words is one shingle."""
    words = raw.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n < WORDS:
        hashes = [xxhash.xxh64_digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: n - WORDS + 1].tolist()
        hashes = [xxhash.xxh64_digest(joined[a:b], 42) for a, b in zip(begins, ends[WORDS - 1:].tolist())]
    return np.unique(np.frombuffer(b"".join(hashes), np.uint64))


def wide_print(raw: bytes) -> tuple[int, bytes, int]:
    """Number of different five-word shingles, 256-bit SimHash over them, one hash of the whole set."""
    values = shingle_set(raw)
    m = len(values)
    if m == 0:
        return 0, bytes(32), 0
    counts = np.zeros((4, 64), np.int64)
    for at in range(0, m, 65_280):
        part = values[at:at + 65_280]
        for k in range(4):
            counts[k] += _bit_sums(part.view(np.uint8).reshape(-1, 8))
            # the next 64 bits: a mixing step of multiply and shift
            part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)
    whole = xxhash.xxh64_intdigest(values.tobytes(), 42)
    return m, np.packbits(2 * counts > m, axis=1).tobytes(), whole - (1 << 64 if whole >= 1 << 63 else 0)


@F.arrow_udf(_WIDE)
def _wide_prints(texts: pa.Array) -> pa.Array:
    rows = [wide_print(v or b"") for v in texts.cast(pa.binary()).to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))],
        names=["n", "print", "whole"],
    )


@F.arrow_udf(T.BinaryType())
def _shingle_sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(v or b"").tobytes() for v in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _nearest(n: int, left: np.ndarray, right: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of links that form a forest of the smallest differences: what is connected by links below any
    limit stays connected by chosen links below that limit."""
    root = np.arange(n)
    at = np.arange(len(left))
    chosen = []
    none = np.iinfo(np.int64).max
    while len(at):
        a, b = root[left[at]], root[right[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            break
        rank = (bits[at].astype(np.int64) << 40) + at
        best = np.full(n, none)
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        picked = np.unique(best[best != none]) & ((1 << 40) - 1)
        chosen.append(picked)
        root = forest(n, root[left[picked]], root[right[picked]])[root]
    return np.concatenate(chosen) if chosen else at


def _compare_wide(batches):
    for batch in batches:
        names = batch.schema.names
        cols = {name: batch.column(names.index(name)).to_pylist() for name in names}
        out = []
        for ida, a, idb, b, same in zip(*(cols[x] for x in ("ids_a", "left", "ids_b", "right", "same"))):
            a, b = (np.frombuffer(b"".join(x), np.uint64).reshape(-1, 4) for x in (a, b))
            ida, idb = np.array(ida, np.int64), np.array(idb, np.int64)
            for at in range(0, len(a), 256):
                part = a[at:at + 256]
                near = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0]) <= WIDE_RADIUS[0]
                i, j = np.nonzero(near)
                if same:
                    i, j = i[j > i + at], j[j > i + at]
                bits = np.bitwise_count(part[i] ^ b[j]).sum(axis=1, dtype=np.int64)
                ok = bits <= WIDE_RADIUS[1]
                if ok.any():
                    i, j, bits = i[ok], j[ok], bits[ok]
                    picked = _nearest(len(part) + len(b), i, j + len(part), bits) if not same else _nearest(
                        len(a), i + at, j, bits
                    )
                    out.append((ida[at + i[picked]], idb[j[picked]]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["a", "b"])


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of sets of different values whose Jaccard similarity is ``similarity`` or more."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(n), sizes)[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    times = np.diff(np.r_[begins, len(values)])
    number = np.repeat(np.arange(len(begins)), times)
    rare = (times <= OFTEN)[number]
    common = np.zeros(n * n, np.int64)
    # owners of one value ascend, so a pair is counted at i < j
    few, whose = number[rare], owner[rare]
    for step in range(1, OFTEN):
        both = few[step:] == few[:-step]
        if not both.any():
            break
        common += np.bincount(whose[:-step][both] * n + whose[step:][both], minlength=n * n)
    common = common.reshape(n, n)
    often = np.flatnonzero(times > OFTEN)
    for at in range(0, len(often), 4096):
        part = often[at:at + 4096]
        there = np.zeros((n, len(part)), np.float32)
        for column, value in enumerate(part):
            there[owner[begins[value]:begins[value] + times[value]], column] = 1
        common += np.triu(np.rint(there @ there.T).astype(np.int64), 1)
    either = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(common / np.maximum(either, 1) >= similarity, 1))


def _verify(similarity: float):
    """Rows of (block, node, set), the rows of a block one after another: links that connect its similar sets."""

    def linked(nodes: list[int], sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        i, j = similar([np.frombuffer(x, np.uint64) for x in sets], similarity)
        root = forest(len(nodes), i, j)
        ends = np.flatnonzero(root != np.arange(len(nodes)))
        nodes = np.array(nodes, np.int64)
        return nodes[root[ends]], nodes[ends]

    def run(batches):
        at, nodes, sets = None, [], []
        for batch in batches:
            out = []
            for block, node, values in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if block != at:
                    if len(nodes) > 1:
                        out.append(linked(nodes, sets))
                    at, nodes, sets = block, [], []
                nodes.append(node)
                sets.append(values)
            if out:
                yield pa.record_batch([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["a", "b"])
        if len(nodes) > 1:
            yield pa.record_batch(list(map(pa.array, linked(nodes, sets))), names=["a", "b"])

    return run


def _blocks(nodes: DataFrame, found: DataFrame, block: tuple[int, int]) -> DataFrame:
    """(node, blocks) of every node that has a candidate: two nodes of one candidate component whose shingle counts allow
    the similarity share a block. A component that fits is one block; others are cut by level and parts, which meet in pairs."""
    roots = components(found)
    groups = roots.select("node", "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    members = written(nodes.select("node", "n", "level").join(groups, "node"), "members")
    parts = F.ceil(F.greatest(F.count("*") / block[0], F.sum("n") / block[1]))
    whole = members.groupBy("root").agg(parts.alias("whole"))
    placed = members.join(whole, "root").withColumn("level", F.when(F.col("whole") > 1, F.col("level")).otherwise(0))
    sizes = written(placed.groupBy("root", "level").agg(parts.alias("parts")), "sizes")
    tiles = sizes.select("root", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    other = tiles.select("root", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"), F.col("level").alias("level_b"),
                         F.col("part").alias("part_b"))
    pairs = written(
        tiles.join(other, ["root", "level"]).filter("level <> level_b or part <= part_b")
        .withColumn("block", F.monotonically_increasing_id()),
        "blocks",
    )
    ends = pairs.select("root", "level", "part", "block").unionAll(pairs.select("root", "level_b", "part_b", "block")).distinct()
    meets = ends.groupBy("root", "level", "part").agg(F.collect_list("block").alias("blocks"))
    dealt = placed.join(sizes, ["root", "level"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.join(meets, ["root", "level", "part"]).select("node", "blocks")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, tile: int = WIDE_TILE, block: tuple[int, int] = BLOCK) -> DataFrame:
    """Documents whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more: columns as
    in ``near_duplicates``, with ``node`` for fp.

    Tiles of 256-bit fingerprints are compared as above and give candidates. Texts that similar have shingle counts within
    a factor of 1 / ``similarity``, so the populations that decide which tile pairs are skipped are the shingle counts.
    The candidates of a task are reduced to a forest, which keeps who may belong together; it is no list of links. Inside each
    component of candidates all pairs are compared on their whole shingle sets, and only similar pairs become links.
    Case of A-Z is ignored. Texts without words are copies of each other; texts of fewer than five words are compared as a whole.
    Very long texts are compared on the sets of all their shingles. Nulls, ties, repeated rows and other columns as in
    ``near_duplicates``.
    """
    prints = written(
        docs.select("doc_id", "text").withColumn("w", _wide_prints("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "w.n", "w.print", "w.whole"),
        "prints",
    )
    level = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-float(np.log(similarity)))).cast("long")
    # ids are stable from here on: the table is written once
    nodes = written(
        prints.groupBy("print", "n", "whole").agg(F.min(F.struct("text_hash", "doc_id")).alias("row"))
        .select("print", "n", "whole", "row", level.alias("level"), F.monotonically_increasing_id().alias("node")),
        "nodes",
    )
    sizes = nodes.groupBy("level").agg(F.ceil(F.count("*") / tile).alias("parts"))
    # one row per level: a logarithm of the longest text, some hundred at most
    tiles = written(
        nodes.join(F.broadcast(sizes), "level")
        .groupBy("level", F.pmod(F.xxhash64("node"), "parts").alias("part"))
        .agg(F.collect_list(F.struct("node", "print")).alias("rows"))
        .select("level", "part", F.col("rows.node").alias("ids"), F.col("rows.print").alias("prints")),
        "tiles",
    )
    here = tiles.select("level", F.col("part").alias("part_a"), F.col("ids").alias("ids_a"), F.col("prints").alias("left"))
    near = tiles.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "level", F.col("part").alias("part_b"),
        F.col("ids").alias("ids_b"), F.col("prints").alias("right"),
    ).select((F.col("level") + F.col("step")).alias("level"), "step", "part_b", "ids_b", "right")
    pairs = here.join(near, "level").filter("step = 1 or part_a <= part_b").select(
        "ids_a", "left", "ids_b", "right", F.expr("step = 0 and part_a = part_b").alias("same")
    )
    # tile pairs are few and heavy: deal them out evenly rather than by level
    spread = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(spread.mapInArrow(_compare_wide, "a long, b long").distinct(), "found")
    wanted = nodes.join(_blocks(nodes, found, block), "node").select("node", "blocks", "row.text_hash", "row.doc_id")
    keys = written(wanted.select("node", "blocks", "text_hash", F.col("doc_id").alias("_id")), "wanted")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sets = (
        texts.join(keys, (texts["text_hash"] == keys["text_hash"]) & texts["doc_id"].eqNullSafe(keys["_id"]))
        .select("node", "blocks", _shingle_sets("text").alias("shingles"))
        .select(F.explode("blocks").alias("block"), "node", "shingles")
    )
    # rows that repeat id and text come once to a block
    dealt = sets.repartition("block").dropDuplicates(["block", "node"]).sortWithinPartitions("block")
    sure = dealt.select("block", "node", "shingles").mapInArrow(_verify(similarity), "a long, b long")
    known = prints.join(nodes.select("print", "n", "whole", "node"), ["print", "n", "whole"]).select("doc_id", "text_hash", "node")
    return _groups(known, "node", components(sure))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group that ``near_duplicates`` or ``near_copies`` found, with all its columns.

    The document with the smallest doc_id stays, then the smallest text hash; of equal rows one.
    Texts are not shuffled, unless rows repeat both id and text: only those are brought together.
    """
    found = written(groups.filter("kept").select("doc_id", "text_hash", "copies").distinct(), "kept")
    hashed = F.xxhash64(docs["text"])

    def pick(keys: DataFrame) -> DataFrame:
        mine = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))
        return docs.join(mine, docs["doc_id"].eqNullSafe(mine["_id"]) & (hashed == mine["_h"]), "left_semi")

    single = pick(found.filter("copies = 1"))
    if found.filter("copies > 1").isEmpty():
        return single
    return single.unionAll(pick(found.filter("copies > 1")).dropDuplicates(["doc_id", "text"]))


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

