"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily with the largest piece that still fits. If a gap is left, the bin's smallest piece may give
way to two unpacked pieces that together fill the widened gap better. Pieces are dealt at random (by a hash of a stored row
number) into groups of a bounded size, and each group is packed on its own in one task; a group of 20 000 pieces loses
less than one sequence in a thousand to its last bins.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written

CAPACITY = 2048
GROUP = 20_000
END = 0
#: The vocabulary of byte_bpe_50k.json as ranks, several times faster; with that file's added tokens the same ids.
VOCABULARY = "byte_bpe_50k.tiktoken"
_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _added(name: str) -> dict[str, int]:
    """Added tokens of the json file beside the ranks, which are matched inside texts; none without such a file."""
    import public_tokenizers

    path = public_tokenizers.path(name.replace(".tiktoken", ".json"))
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def _encoder(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_added(name))


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _tokenise(capacity: int, vocabulary: str, keep_ids: bool, id_type: pa.DataType):
    def run(batches):
        encode = _encoder(vocabulary).encode_to_numpy
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or "", allowed_special="all"), END).astype("<u4")
                for nth, (start, length) in enumerate(_cut(len(ids), capacity)):
                    part = ids[start:start + length]
                    rows.append((doc_id, nth, start, length, zlib.crc32(part.tobytes()), part if keep_ids else None))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(arrays, names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and a closing END; a null text is an empty one. Only documents longer than ``capacity`` are
    cut. The crc is over the ids as little-endian 32-bit numbers. A very long text is encoded whole, inside its row. Rows that
    repeat id and text give their pieces as often as they occur. Other columns are not carried along, so no name can clash.
    An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = _PIECE.format(id=kind.simpleString()) + (", ids array<int>" if keep_ids else "")
    run = _tokenise(capacity, vocabulary, keep_ids, to_arrow_type(kind))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length. Lengths are from 1 to ``capacity``. Pieces of equal length are interchangeable: the
    last given is taken first."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stock = {n: order[cuts[n]:cuts[n + 1]].tolist() for n in range(1, capacity + 1) if cuts[n] < cuts[n + 1]}
    there = sum(1 << n for n in stock)  # bit n: a piece of length n is left
    upto = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]

    def take(n: int) -> int:
        nonlocal there
        piece = stock[n].pop()
        if not stock[n]:
            there ^= 1 << n
        return piece

    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0
    while there:
        items, gap = [], capacity
        while fits := there & upto[gap]:
            n = fits.bit_length() - 1
            items.append((n, take(n)))
            gap -= n
        if gap and there:
            small, piece = items[-1]
            pair = _two(stock, there, upto, gap + small, small)
            if pair:
                items.pop()
                items += [(n, take(n)) for n in pair]
                stock.setdefault(small, [])
                stock[small].append(piece)
                there |= 1 << small
        at = 0
        for n, piece in items:
            bins[piece], offsets[piece] = number, at
            at += n
        number += 1
    return bins, offsets


def _two(stock: dict, there: int, upto: list[int], room: int, beat: int) -> tuple[int, int] | None:
    """Two lengths left with the largest sum up to ``room``, if it is more than ``beat``."""
    best, pair = beat, None
    fits = there & upto[room - 1] if room > 1 else 0
    while fits:
        a = fits.bit_length() - 1
        if 2 * a <= best:
            break
        fits ^= 1 << a
        others = there & upto[min(a, room - a)]
        if others and others.bit_length() - 1 == a and len(stock[a]) < 2:
            others ^= 1 << a
        if others and a + others.bit_length() - 1 > best:
            best = a + others.bit_length() - 1
            pair = (a, best - a)
            if best == room:
                break
    return pair


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        rows = rows.drop(columns=["group", "row"])
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        rows["offset"] = offsets
        return rows

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; offsets of a sequence have no gaps.

    All other columns are carried along, so keep them narrow. An empty table gives an empty one.
    """
    rows = written(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return dealt.groupBy("group").applyInPandas(_pack(capacity), f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place. Repeated rows are packed as often as they occur."""
    return pack(pieces(docs, capacity), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids (the pieces' ids in order of their offsets)."""
    placed = pack(pieces(docs, capacity, keep_ids=True), capacity)
    gathered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(gathered, lambda p: p["ids"])).alias("ids"))


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return packed(table(spark, folder, "documents"))
