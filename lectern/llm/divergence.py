"""Divergence between the sources of a language, from count-level bitmaps.

1. Tasks count terms per (lang, source) and pass on sums. Terms in ``least_docs`` or more documents of their language are kept
   and numbered by falling frequency, so that terms of like counts share a word of 64 ids.
2. For every (source, count) the set of term ids with that count is stored as bitmap words; zero counts are stored nowhere.
3. A term's p depends on its group and count alone. So the distance of two sources is, over all pairs of counts, the
   number of terms in that joint cell (AND of two words, population count) times f of the two p. Cells with a zero count
   are the complement: a word AND NOT the union of the other source's words; both zero: neither union.

Work is dealt by (language, run of bitmap words, pair of source tiles): a task sees at most about 64 sources a tile and
1 024 terms, whatever the size of a language. Only sums per pair of sources leave it; all pairs are the result itself.

Null text, lang and source are ''. A language without kept terms has distance 0 between all its sources and no term rows.
Repeated rows are documents of their own. Very long texts are counted in pieces of a megabyte. Equal values rank by item. Other
columns of the input play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import ordered
from lectern.session import written

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bitmap words of 64 terms that a task takes, and sources of a tile (on average).
RUN, TILE = 16, 64
#: Distinct terms that a task holds before it passes its sums on, and bytes of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20
_OUT_ROWS = 50_000

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TO_TERMS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256)).translate(bytes.maketrans(_UPPER, _LOWER))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _sums(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (times, docs) in held.items():
        terms = list(times)
        for k in range(0, len(terms), _OUT_ROWS):
            part = terms[k : k + _OUT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([times[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(times), set()
            for words in _pieces(text.as_py().translate(_TO_TERMS)):
                times.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(times) - before
            if size > HELD:
                yield from _sums(held)
                held, size = {}, 0
    yield from _sums(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group, and how many of its documents hold it.

    Terms are runs of ASCII letters and other than ASCII characters; only A-Z are lower-cased.
    """
    counted = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 V)), in decimals: the product may pass 64 bits."""
    over = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))"
    return F.expr(f"1 + ({over}) DIV CAST({total} + 2 * v AS DECIMAL(20, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def count_levels(known: DataFrame) -> DataFrame:
    """(lang, source, n, id) -> (lang, source, n, word, bits): the ids of a group's terms that occur n times, 64 ids a word."""
    return known.groupBy("lang", "source", "n", F.expr("id DIV 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(id % 64 AS INT)))").alias("bits")
    )


def _cells(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _distances(table: pa.Table) -> pa.Table:
    """One run of words of one pair of tiles: what its terms add to the distance of every pair of sources."""
    names = table.column("source").combine_chunks().dictionary_encode()
    who, names = names.indices.to_numpy(), names.dictionary.to_pylist()
    number = lambda c: table.column(c).to_numpy()
    n, p, word, tile, v = number("n"), number("p"), number("word"), number("tile"), int(number("v")[0])
    bits = number("bits").view(np.uint64)
    size, (low, high) = len(names), (int(number("a")[0]), int(number("b")[0]))
    nothing, home = np.zeros(size, np.int64), np.zeros(size, np.int64)
    nothing[who[n == 0]] = p[n == 0]
    home[who] = tile
    shared, alone, none = (np.zeros((size, size), np.int64) for _ in range(3))
    first = int(number("run")[0]) * RUN
    order = np.flatnonzero(n > 0)
    order = order[np.argsort(word[order], kind="stable")]
    for w in range(first, min(first + RUN, -(-v // 64))):
        every = np.uint64((1 << min(64, v - 64 * w)) - 1)
        rows = order[np.searchsorted(word[order], w, "left") : np.searchsorted(word[order], w, "right")]
        own, pw, b = who[rows], p[rows], bits[rows]
        union = np.zeros(size, np.uint64)
        np.bitwise_or.at(union, own, b)
        up, down = np.flatnonzero(home[own] == low), np.flatnonzero(home[own] == high)
        joint = np.bitwise_count(b[up, None] & b[None, down])
        i, j = np.nonzero(joint)
        np.add.at(shared, (own[up[i]], own[down[j]]), joint[i, j] * _cells(pw[up[i]], pw[down[j]]))
        lacks = np.bitwise_count(b[:, None] & ~union[None, :])
        i, j = np.nonzero(lacks)
        np.add.at(alone, (own[i], j), lacks[i, j] * _cells(pw[i], nothing[j]))
        none += np.bitwise_count(every & ~(union[:, None] | union[None, :]))
    sums = shared + alone + alone.T + none * _cells(nothing[:, None], np.maximum(nothing, 1)[None, :])
    i, j = np.nonzero((home[:, None] == low) & (home[None, :] == high) & ~np.eye(size, dtype=bool))
    value = sums[i, j]
    if low != high:
        i, j, value = np.r_[i, j], np.r_[j, i], np.r_[value, value]
    named = pa.array(names, pa.string())
    return pa.table({
        "lang": pa.array([table.column("lang")[0].as_py()] * len(i), pa.string()),
        "source": named.take(pa.array(i)), "item": named.take(pa.array(j)), "value": pa.array(value, pa.int64()),
    })


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank). Part 'pair': distance to every other source of the language, all ranks.
    Part 'term': the ``top_terms`` terms by which the source stands out from its language."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(term_counts(texts), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    order = ["down", "term"]
    placed = ordered.blocks(kept.select("lang", "term", "lang_n", (-F.col("lang_n")).alias("down")), ["lang"], order)
    terms = written(
        ordered.prefix(placed, ["lang"], order, {"id": ("count", F.lit(1))}).select("lang", "term", "lang_n", "id"), "terms"
    )
    known = written(counts.drop("docs").join(terms, ["lang", "term"]), "known")

    languages = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = texts.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = {"v": 0, "lang_total": 0, "total": 0}
    groups = written(
        groups.join(tiles, "lang").join(languages, "lang", "left").join(totals, ["lang", "source"], "left").fillna(none)
        .withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")),
        "groups",
    )
    runs = F.greatest(F.ceil(F.col("v") / (64 * RUN)), F.lit(1)).cast("long")
    zero = F.lit(0).cast("long")
    empty = groups.withColumn("run", F.explode(F.sequence(zero, runs - 1))).withColumns({"n": zero, "word": zero, "bits": zero})
    levels = count_levels(known).withColumn("run", F.expr(f"word DIV {RUN}")).join(groups, ["lang", "source"])
    columns = ["lang", "source", "tile", "tiles", "v", "run", "word", "n", "bits", F.when(F.col("v") > 0, _p("n", "total")).otherwise(1).alias("p")]
    other = F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("other")
    dealt = levels.select(*columns).unionByName(empty.select(*columns)).select("*", other)
    dealt = dealt.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}).drop("tiles", "other")
    parts = dealt.groupBy("lang", "run", "a", "b").applyInArrow(_distances, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    stands_out = (
        known.join(groups, ["lang", "source"])
        .withColumns({"p": _p("n", "total"), "q": _p("lang_n", "lang_total")}).filter("p > q")
        .select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    )
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs.withColumn("rank", F.row_number().over(ranked)), "pair").unionByName(part(stands_out, "term"))


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return audit(table(spark, folder, "documents"))


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (
    SELECT o.lang, o.source, coalesce(l.v, 0)::HUGEINT AS v, coalesce(l.n, 0)::HUGEINT AS ln, coalesce(s.n, 0)::HUGEINT AS n
    FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN l ON o.lang = l.lang LEFT JOIN s ON o.lang = s.lang AND o.source = s.source
),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
        1 + ({SCALE}::HUGEINT * (k.n + 2)) // (g.ln + 2 * g.v) AS q
    FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
f AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
),
r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
