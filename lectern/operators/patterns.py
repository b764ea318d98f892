"""Many fixed strings looked for in many texts.

Strings go in packs and texts in blocks of bounded length; every block of a scope (a course) meets its packs in a task of its own. There the
strings are a tree of characters, walked by all places of the texts at once: a place goes on as long as some string does, so time grows
with the texts and not with texts x strings. Only what is found leaves the task, with the columns asked for.
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

#: Characters of the strings of a pack; of the texts of a block, at least and for each of its pack's (a tree is made for every block); of
#: texts laid out and of places walked at once; cells of a table of steps.
PACK, BLOCK, SHARE, SLICE, STRIDE, CELLS = 500_000, 1_000_000, 16, 1 << 20, 1 << 18, 1 << 23


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Tree:
    """Strings by their characters: node 0 is no node, node 1 the root."""

    def __init__(self, strings: list[str]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        letters = np.unique(_codes("".join(strings)))
        #: character -> 1, 2, ...; 0 for one that no string has
        self.letter = np.zeros(int(letters[-1]) + 2, np.int64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        steps: dict[int, int] = {}
        ends = []
        for s in strings:
            node = 1
            for c in self.letter[_codes(s)].tolist():
                node = steps.setdefault(node * self.width + c, len(steps) + 2)
            ends.append(node)
        self.string = np.full(len(steps) + 2, -1, np.int64)
        self.string[ends] = np.arange(len(strings))
        keys, nodes = (np.fromiter(x, np.int64, len(steps)) for x in (steps.keys(), steps.values()))
        self.table = None
        if len(self.string) * self.width <= CELLS:
            self.table = np.zeros(len(self.string) * self.width, np.int32)
            self.table[keys] = nodes
        else:
            order = np.argsort(keys)
            self.keys, self.nodes = keys[order], nodes[order]

    def _step(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[keys]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.nodes[at], 0)

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, string) of everything found, overlaps included."""
        letters = self.letter[np.minimum(codes, len(self.letter) - 1)]
        places, strings = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(codes), STRIDE):
            at = start + np.flatnonzero(letters[start:start + STRIDE])
            node, depth = np.ones(len(at), np.int64), 0
            while len(at):
                node = self._step(node * self.width + letters[at + depth])
                at, node = at[node > 0], node[node > 0].astype(np.int64)
                ended = self.string[node]
                places.append(at[ended >= 0])
                strings.append(ended[ended >= 0])
                depth += 1
                inside = at + depth < len(codes)
                at, node = at[inside], node[inside]
        return np.concatenate(places), np.concatenate(strings)


def _apart(group: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the sorted places of every group stay when each taken one covers its length, from the left."""
    near = np.zeros(len(place), bool)
    near[1:] = (group[1:] == group[:-1]) & (place[1:] - place[:-1] < length[1:])
    kept = np.ones(len(place), bool)
    last = None
    for i in np.flatnonzero(near):  # only runs of overlapping places are looked at one by one
        if last is None or not near[i - 1]:
            last = i - 1
        kept[i] = place[i] - place[last] >= length[i]
        if kept[i]:
            last = i
    return kept


def _slices(texts: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Runs of neighbouring texts, (first, number), of about SLICE characters; a longer text is one of its own or the end of one."""
    before = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())])[:-1]
    first = np.flatnonzero(np.diff(before // SLICE, prepend=-1))
    return list(zip(first.tolist(), np.diff(np.append(first, len(before))).tolist()))


def _finder(body: str, string: str, keep: list[str], window: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(texts: pa.Table, names: list[str], tree: _Tree | None) -> pa.Table:
        bodies = texts.column(body).to_pylist() if tree else []
        # the character between two texts is in no string: a code beyond all characters
        gap = np.array([0x110000], np.uint32)
        n = group = place = number = np.zeros(0, np.int64)
        if bodies:
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in bodies])])
            place, number = tree.walk(np.concatenate([x for t in bodies for x in (_codes(t), gap)]))
            row = np.searchsorted(starts, place, "right") - 1
            order = np.lexsort((place, number, row))
            row, place, number = row[order], place[order], number[order]
            group = row * len(names) + number
            kept = _apart(group, place, tree.lengths[number])
            row, place, number, group = row[kept], place[kept] - starts[row[kept]], number[kept], group[kept]
            n = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else n
        offsets = pa.array(np.concatenate([n, [len(place)]]).astype(np.int32))
        firsts = pa.array(row[n]) if len(n) else pa.array([], pa.int64())
        out = texts.select(keep).take(firsts)
        out = out.append_column(string, pa.array(names, pa.string()).take(pa.array(number[n], pa.int64())))
        out = out.append_column("at", pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))))
        if window is not None:
            cut = [bodies[r][max(0, p - window):p + len(names[s]) + window] for r, p, s in zip(row.tolist(), place.tolist(), number.tolist())] if len(n) else []
            out = out.append_column("near", pa.ListArray.from_arrays(offsets, pa.array(cut, pa.string())))
        return out

    def run(block: pa.Table, pack: pa.Table) -> pa.Table:
        names = sorted(pack.column(string).to_pylist())
        if not names or not len(block):
            return found(block.slice(0, 0), names, None)
        tree = _Tree(names)
        return pa.concat_tables([found(block.slice(*at), names, tree) for at in _slices(block.column(body))])

    return run


def matches(
    texts: DataFrame, strings: DataFrame, *, body: str = "text", string: str = "term", scope: str | None = "video_id",
    keep: Sequence[str] | None = None, window: int | None = None,
) -> DataFrame:
    """A row for every string that the ``body`` of a row of ``texts`` holds, case observed: the columns ``keep`` of that row (all of
    them), the string, and ``at``, its 0-based places, from the left and without overlaps. With ``window`` also ``near``, each
    place with so many characters on both sides.

    With ``scope`` both tables have that column and must agree in it. Null and empty strings are found nowhere, null texts hold
    nothing. A text stays whole, however long.
    """
    keep = list(texts.columns if keep is None else keep)
    by = F.col(scope) if scope else F.lit(0)
    asked = strings.select(by.alias("_by"), F.col(string)).filter(F.length(string) > 0).distinct()
    asked = written(asked, "asked")
    packs = asked.groupBy("_by").agg(F.sum(F.length(string)).alias("_strings"), F.ceil(F.sum(F.length(string)) / PACK).alias("_packs"))
    rows = texts.select(*dict.fromkeys([*keep, body]), by.alias("_by")).filter(F.length(body) > 0)
    chars = rows.groupBy("_by").agg((F.sum(F.length(body)) + F.count("*")).alias("_chars"))
    # a row per scope
    block = F.greatest(F.lit(BLOCK), SHARE * F.col("_strings") / F.col("_packs"))
    sizes = written(packs.join(chars, "_by").select("_by", "_packs", F.ceil(F.col("_chars") / block).alias("_blocks")), "sizes")
    key = ["_by", "_block", "_pack"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = rows.join(sizes, "_by").withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.col("_blocks")))
    dealt = dealt.withColumn("_pack", every("_packs")).drop("_packs", "_blocks")
    packed = asked.join(sizes, "_by").withColumn("_pack", F.pmod(F.xxhash64(string), F.col("_packs")))
    packed = packed.withColumn("_block", every("_blocks")).drop("_packs", "_blocks")
    schema = T.StructType([texts.schema[c] for c in keep])
    schema = schema.add(string, "string").add("at", T.ArrayType(T.IntegerType()))
    if window is not None:
        schema = schema.add("near", T.ArrayType(T.StringType()))
    return dealt.groupBy(*key).cogroup(packed.groupBy(*key)).applyInArrow(_finder(body, string, keep, window), schema)


def pairs(texts: DataFrame, strings: DataFrame, *, body: str = "text", string: str = "term", scope: str | None = "video_id") -> DataFrame:
    """Rows of ``texts`` with every string that their ``body`` holds: all columns of ``texts``, then ``string`` (see ``matches``)."""
    return matches(texts, strings, body=body, string=string, scope=scope).drop("at")
