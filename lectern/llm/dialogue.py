"""Conversation structure repair by iterative-deepening A*.

A conversation shall have role initials ``(s?(ua)+)?``. Rows are kept (K), deleted (D), reroled (R), or empty rows inserted (I); the
answer is the cheapest string of edits, the ASCII-least among equals.

1. Equal rows of a turn become one with a count. A row's class (role initial) and fault fit one letter. Rows are
   range-partitioned by (conversation, order), so that a conversation of any size is spread over blocks.
2. Blocks cut their conversations into segments of at most ``SEGMENT`` rows. What a segment does to the four places of the pattern
   (before all, after s, after u, after a) is found by iterative-deepening A*: depth-first search in ASCII edit order under
   increasing cost bounds; a table of failed states (row, place) with the budget they had cuts repeated work; the first
   accepting path is the answer. The estimate is the cost that faulty rows cannot avoid.
3. Segments of a conversation are chained: costs from the end, then edits from the start. An edit string of a segment ends with
   a row's edit, so none is the beginning of another, and the least choice at each segment is the least of all.
4. A second pass streams each conversation's rows, led by its edits, through the hash of the repaired rows.

One value grows with a conversation: its edits, one letter a row, which is the result asked for (the chain holds some thirty
bytes a row meanwhile). Texts stream: SHA-256 has to see them in order, so a conversation's last pass is one task's.

Null role, text, and turn or id inside the damage key are one space; null turns come first and leave gaps alone; a null conv_id is a
conversation. Rows of one turn are in order of (role, text). Empty texts are blank. Very long texts are never held twice. Other
columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WHITE
from lectern.operators import ordered
from lectern.session import written

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
SEGMENT = 16
#: Places of the pattern: before all, after s, after u, after a. What an edit emits there is settled but for a kept first row.
START, SYSTEM, USER, ANSWER = range(4)
NEXT = (USER, USER, ANSWER, USER)
PLACES = 4
CLASSES = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Places from which a conversation may end, and the rows that must be inserted there first.
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


# ------------------------------------------------------------------ damage


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the damage of the contract by crc32(conv_id:turn) modulo 20; n copies of a row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
        )
    )


# ------------------------------------------------------------------ search inside a segment


@lru_cache(maxsize=None)
def _moves(code: str, place: int) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, cost, rows used, next place) in ASCII order of the edits."""
    initial, fault = CLASSES[k : k + 1] if (k := (ord(code) - 65) // 4) < 3 else "", FAULTS[(ord(code) - 65) % 4]
    out = [("D", DELETE, 1, place), ("I", INSERT, 0, NEXT[place])]
    if fault not in ("blank", "duplicate"):
        more = CUT_SHORT if fault == "truncated" else 0
        if initial == "s" and place == START:
            out.append(("K", KEEP + more, 1, SYSTEM))
        elif initial == ("a" if place == USER else "u"):
            out.append(("K", KEEP + more, 1, NEXT[place]))
        out.append(("R", REROLE + more, 1, NEXT[place]))
    return tuple(out)


@lru_cache(maxsize=200_000)
def search(codes: str, start: int, goal: int) -> tuple[int, str] | None:
    """Cheapest edits that take the pattern over all rows of ``codes`` from ``start`` to ``goal``, ASCII-least among equals: (cost,
    edits), None if there are none. Inserted rows stand before a row, never behind the last one."""
    n = len(codes)
    faulty = [FAULTS[(ord(c) - 65) % 4] for c in codes]
    sure = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        sure[i] = sure[i + 1] + (DELETE if faulty[i] in ("blank", "duplicate") else min(DELETE, CUT_SHORT) if faulty[i] else 0)
    opens = [i for i, c in enumerate(codes) if ord(c) - 65 < 4 and faulty[i] in ("", "truncated")]

    def hopeless(i: int, place: int) -> bool:
        """No way back to a start, or to a system row that is passed or absent."""
        if goal == START:
            return place != START
        if goal == SYSTEM:
            return place > SYSTEM or place == START and not (opens and opens[-1] >= i)
        return i == n and place != goal

    bound, over, failed = 0, 0, {}

    def first(i: int, place: int, cost: int) -> str | None:
        nonlocal over
        if hopeless(i, place):
            return None
        if cost + sure[i] > bound:
            over = min(over, cost + sure[i])
            return None
        if i == n:
            return "" if place == goal else None
        if failed.get((i, place), -1) >= bound - cost:
            return None
        failed[i, place] = bound - cost  # stands while it is open too: a way round to the same state only costs more
        for edit, price, used, to in _moves(codes[i], place):
            rest = first(i + used, to, cost + price)
            if rest is not None:
                return edit + rest
        return None

    bound = sure[0]
    while True:
        over, failed = 1 << 40, {}
        found = first(0, start, 0)
        if found is not None:
            return bound, found
        if over == 1 << 40:
            return None
        bound = over


def table_of(codes: str, from_start: bool) -> list[str]:
    """PLACES x PLACES entries 'cost edits', '' where there is no way. The first segment of a conversation is entered at START only."""
    out = []
    for start in range(PLACES):
        for goal in range(PLACES):
            way = search(codes, start, goal) if start == START or not from_start else None
            out.append("" if way is None else f"{way[0]} {way[1]}")
    return out


def chain(count: int, entry: Callable[[int, int], str]) -> tuple[int, str]:
    """Cost and edits of a conversation of ``count`` segments; ``entry(segment, start * PLACES + goal)`` is one of its tables' entries."""
    ahead = np.zeros((count + 1, PLACES), np.int64)
    ahead[count] = [cost for cost, _ in ENDING]
    price = lambda k, way: int(e.partition(" ")[0]) if (e := entry(k, way)) else 1 << 40
    for k in range(count - 1, -1, -1):
        ahead[k] = [min(price(k, p * PLACES + g) + int(ahead[k + 1, g]) for g in range(PLACES)) for p in range(PLACES)]
    place, edits = START, []
    for k in range(count):
        best = [
            (entry(k, way).partition(" ")[2], g) for g in range(PLACES)
            if price(k, way := place * PLACES + g) + ahead[k + 1, g] == ahead[k, place]
        ]
        edit, place = min(best)
        edits.append(edit)
    return int(ahead[0, START]), "".join(edits) + ENDING[place][1]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _tables(codes: pa.Array, number: pa.Array) -> pa.Array:
    return pa.array([table_of(c, k == 0) for c, k in zip(codes.to_pylist(), number.to_pylist())], pa.list_(pa.string()))


_REPAIR = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType())]
)
_LEGAL = ("su", "ua", "au")


@F.arrow_udf(_REPAIR)
def _chained(segments: pa.Array) -> pa.Array:
    """segments: array<struct<k, codes, ways>> of one conversation, in order."""
    rows = []
    for conversation in segments:
        inner = conversation.values
        codes, ways = inner.field("codes"), inner.field("ways")
        ways = ways.flatten()
        cost, audit = chain(len(inner), lambda k, way: ways[k * PLACES * PLACES + way].as_py())
        found, illegal, last = [0] * len(FAULTS), 0, None
        for part in codes:
            for c in part.as_py():
                kind, fault = divmod(ord(c) - 65, len(FAULTS))
                now = CLASSES[kind : kind + 1]
                found[fault] += 1
                illegal += last is not None and last + now not in _LEGAL
                last = now
        rows.append((*found[1:], illegal, cost, audit))
    columns = list(zip(*rows)) or [()] * len(_REPAIR.names)
    kinds = [pa.int64()] * 5 + [pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_REPAIR.names)


# ------------------------------------------------------------------ passes over the rows


def _cut(size: int):
    """Sorted rows of a block -> (conv_id, block, part, codes) with at most ``size`` rows a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, block, held, part = None, None, 0, "", 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, *rest = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int64(), pa.string()))]],
                names=["conv_id", "block", "part", "codes"],
            )

        for rows in batches:
            kind = rows.schema.field("conv_id").type
            columns = [rows.column(c).to_pylist() for c in ("conv_id", ordered.BLOCK, "code", "n")]
            for conversation, blk, code, n in zip(*columns):
                if key is None or key[0] != conversation:
                    if held:
                        out.append((key[0], block, part, held))
                    key, held, part = (conversation,), "", 0
                block = blk
                again = code if (ord(code) - 65) % 4 == 1 else chr(ord(code) - (ord(code) - 65) % 4 + 2)
                while n:
                    take = min(n, size - len(held))
                    held += (code + again * (take - 1)) if code else again * take
                    code, n = "", n - take
                    if len(held) == size:
                        out.append((conversation, block, part, held))
                        held, part = "", part + 1
                    if len(out) >= 5000:
                        yield batch()
                        out = []
        if held:
            out.append((key[0], block, part, held))
        if out:
            yield batch()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each conversation led by its edits in ``text`` -> (conv_id, repaired_sha256). Nothing but the edits is held."""
    roles = ("", "", "user", "assistant")
    at, place, edits, digest, rows_out, key = 0, START, "", None, 0, None

    def emit(role: str, text: str, to: int) -> None:
        nonlocal place, rows_out
        if rows_out:
            digest.update(b"\n")
        digest.update(role.encode())
        digest.update(b":")
        digest.update(text.encode())
        place, rows_out = to, rows_out + 1

    def inserted() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            at += 1
            emit(roles[NEXT[place]], "", NEXT[place])

    for batch in batches:
        done = []
        kind = batch.schema.field("conv_id").type
        for conversation, leads, role, text, n in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "leads", "role", "text", "n")]):
            if leads:
                if digest is not None:
                    inserted()
                    done.append((key, digest.hexdigest()))
                at, place, edits, digest, rows_out, key = 0, START, text, hashlib.sha256(), 0, conversation
                continue
            for _ in range(n):
                inserted()
                edit, at = edits[at], at + 1
                if edit == "K":
                    emit(role, text, SYSTEM if place == START and role[:1] == "s" else NEXT[place])
                elif edit == "R":
                    emit(roles[NEXT[place]], text, NEXT[place])
        if done:
            yield _digests(done, kind)
    if digest is not None:
        inserted()
        yield _digests([(key, digest.hexdigest())], kind)


def _digests(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, digests = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def _code(initial: Column, repeated: Column) -> Column:
    """One letter from class and first fault."""
    bare = F.rtrim("text", F.lit(WHITE))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(bare == "", 1).when(repeated, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return F.char(kind * len(FAULTS) + fault + 65)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, optional n copies): gaps, blank, duplicate,
    truncated, illegal, cost (longs), audit, repaired_sha256."""
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    order = ["turn", "role", "text"]
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    base = written(rows.groupBy("conv_id", *order).agg(F.sum("n").alias("n")).withColumn("digest", digest), "base")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = base.groupBy("conv_id", "digest").agg(F.min(turn).alias("first")).select(F.col("conv_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    same = base["conv_id"].eqNullSafe(firsts["_id"]) & (base["digest"] == firsts["_digest"])
    coded = base.join(firsts, same).select(
        "conv_id", *order, "n", _code(F.substring("role", 1, 1), ~turn.eqNullSafe(F.col("first"))).alias("code")
    )
    placed = ordered.blocks(coded, ["conv_id"], order)
    kind = placed.schema["conv_id"].dataType.simpleString()
    pieces = placed.select("conv_id", ordered.BLOCK, "code", "n").mapInArrow(_cut(segment), f"conv_id {kind}, block int, part long, codes string")
    listed = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "part", "codes"))).alias("s"))
    parts = listed.select("conv_id", F.posexplode("s").alias("k", "s")).select("conv_id", "k", "s.codes")
    segments = parts.select("conv_id", F.struct("k", "codes", _tables("codes", "k").alias("ways")).alias("s"))
    gathered = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    repaired = written(gathered.select("conv_id", _chained("s").alias("r")).select("conv_id", "r.*"), "repaired")

    text = lambda c: F.col(c).cast("string")
    led = repaired.select(
        "conv_id", F.lit(True).alias("leads"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), text("audit").alias("text"),
        F.lit(0).cast("long").alias("n"),
    ).unionByName(placed.select("conv_id", F.lit(False).alias("leads"), *order, "n"))
    ranked = led.repartition("conv_id").sortWithinPartitions("conv_id", F.col("leads").desc(), *order)
    hashes = ranked.select("conv_id", "leads", "role", "text", "n").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = base.groupBy("conv_id").agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"))
    both = repaired.unionByName(hashes, allowMissingColumns=True).unionByName(gaps, allowMissingColumns=True)
    return both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in RESULTS])


RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_NOTHING = {**{c: 0 for c in RESULTS[:6]}, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def repaired_after_damage(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every conversation of ``rows``, damaged and repaired; one that lost all its rows has zeros and no edits."""
    found = repair(damaged(rows), segment).unionByName(rows.select("conv_id").distinct(), allowMissingColumns=True)
    return found.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(_NOTHING[c])).alias(c) for c in RESULTS])


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return repaired_after_damage(table(spark, folder, "conversations"))


SQL = r"""
WITH RECURSIVE byte AS (
    SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) r(i)
),
k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
    FROM conversations, byte
),
d AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM k WHERE kind <> 0
),
o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM d
),
f AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
        CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
    FROM o
),
m AS (
    SELECT * FROM (VALUES (0, '', 0, 0, ''), (0, 'I', 5, 2, 'user:' || chr(10)), (0, 'II', 10, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
        (1, '', 0, 1, ''), (1, 'I', 5, 2, 'user:' || chr(10)), (1, 'II', 10, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
        (2, '', 0, 2, ''), (2, 'I', 5, 3, 'assistant:' || chr(10)), (3, '', 0, 3, ''), (3, 'I', 5, 2, 'user:' || chr(10))) v(q, pre, cost, mid, made)
),
e AS (
    SELECT * FROM (VALUES ('D', 2, 0, 0), ('D', 2, 1, 1), ('D', 2, 2, 2), ('D', 2, 3, 3), ('K', 0, 0, 1), ('K', 0, 0, 2), ('K', 0, 1, 2), ('K', 0, 2, 3), ('K', 0, 3, 2),
        ('R', 1, 0, 2), ('R', 1, 1, 2), ('R', 1, 2, 3), ('R', 1, 3, 2)) v(edit, price, mid, q2)
),
r AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0, 'a': '', 'o': ''} AS best FROM (SELECT DISTINCT conv_id FROM f)
    UNION ALL
    SELECT r.conv_id, f.i, e.q2, min({'c': r.best.c + m.cost + e.price + CASE WHEN f.fault = 't' AND e.edit <> 'D' THEN 5 ELSE 0 END,
        'a': r.best.a || m.pre || e.edit,
        'o': r.best.o || m.made || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
            ELSE CASE e.q2 WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || f.text || chr(10) END})
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN m ON m.q = r.q
    JOIN e ON e.mid = m.mid AND (e.edit = 'D' OR f.fault NOT IN ('b', 'd')) AND (e.edit <> 'K' OR f.c = CASE e.q2 WHEN 1 THEN 's' WHEN 2 THEN 'u' ELSE 'a' END)
    GROUP BY r.conv_id, f.i, e.q2
),
n AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id),
z AS (
    SELECT r.conv_id, min({'c': r.best.c + w.cost, 'a': r.best.a || w.pre, 'o': r.best.o || w.made}) AS best
    FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.i JOIN m w ON w.q = r.q AND w.mid IN (0, 3) GROUP BY r.conv_id
),
s AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(z.best.c, 0)::BIGINT AS cost, coalesce(z.best.a, '') AS audit,
    sha256(CASE WHEN length(coalesce(z.best.o, '')) > 0 THEN left(z.best.o, length(z.best.o) - 1) ELSE '' END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
