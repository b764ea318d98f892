"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. Sources get targets: weights share a budget, no source more than ``limit`` times its size.
2. The budget is a number of equal blocks of words: ``block``, or a ``FINE``-th of the smallest target if that is less, so that a
   source of a few words comes near its target too. Blocks go to sources by the highest quotients
   target / (2k + 1), then each source's blocks go to its shards the same way, so every shard has an integer quota.
3. A shard's documents form a stream in the order of a seeded hash, cut into equal blocks. A quota of all blocks
   means every document once (twice at most); the rest is a run of blocks from a seeded start, around the end.

Only DataFrame functions. A source is cut into shards of about ``shard_words`` words by hash, so a source with a third
of all rows spreads over many tasks; single tasks see the table of sources, or of one source's shards, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 100
FINE = 20
SHARD_WORDS = 500_000
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins like any string."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("z"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(src, source_size) -> weight, target. Weights repeat over the sources in order of src.

    A source that would pass ``limit`` times its size stops there and the excess is shared again by weight.
    In order of limit / weight the capped sources come first, so one pass of running sums finds the level.
    One row per source meets in one task here.
    """
    one = F.lit(1)
    numbered = sources.withColumn("nth", F.row_number().over(Window.partitionBy(one).orderBy("src")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ordered = Window.partitionBy(one).orderBy("_ratio", "src")
    everything = Window.partitionBy(one)
    rows = (
        numbered.withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * float(limit))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "src", "_level"))).over(everything)["_level"]
    return rows.withColumn("target", F.least("_cap", F.coalesce(F.col("weight") * level, F.col("_cap")))).select(
        *sources.columns, "weight", "target"
    )


def apportion(units: DataFrame, group: list[str], unit: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the group's ``seats`` go to its units by the highest quotients votes / (2k + 1), ties by unit.

    With n units, a divisor between V / (Q + n/2) and V / (Q - n/2) gives out exactly Q seats by rounding. What rounding
    gives at the upper one is safe, and only the about 2n quotients between the two are ranked.
    """
    key = [F.col(c) for c in group] or [F.lit(1)]
    inside = Window.partitionBy(*key)
    q, half, total = F.col(seats), F.col("_n") / 2, F.col("_votes")
    ready = units.withColumn("_n", F.count("*").over(inside)).withColumn("_votes", F.sum(votes).over(inside))
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    low = F.when(q > half, F.greatest(F.floor(share * (q - half) + 0.5) - 1, F.lit(0))).otherwise(0)
    high = F.floor(share * (q + half) + 0.5) + 1
    ready = ready.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    ready = ready.withColumn("_rest", q - F.sum("_low").over(inside))
    tried = ready.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    rank = F.row_number().over(inside.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), unit, "_k"))
    won = F.sum(F.when((F.col("_rank") <= F.col("_rest")) & (F.col(votes) > 0), 1).otherwise(0))
    return tried.withColumn("_rank", rank).groupBy(*units.columns).agg((F.first("_low") + won).alias("quota"))


def _shards(sized: DataFrame, weights, share: float, limit: float, block: int, shard_words: int, seed: int):
    """Documents with their shard, and per shard its words, blocks and quota."""
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    smallest = F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything), F.lit(0.0))
    words = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(smallest / FINE))).cast("long")
    sources = targets(sources, weights, share, limit).withColumn("block", words)
    sources = sources.withColumn("_seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    sources = written(
        apportion(sources, [], "src", "target", "_seats")
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
        .withColumnRenamed("quota", "source_quota"),
        "sources",
    )
    placed = sized.join(sources, "src").withColumn("shard", F.pmod("key", "shards"))
    shards = placed.groupBy("src", "shard", "source_quota", "block").agg(F.sum("size").alias("words"))
    quotas = apportion(shards, ["src"], "shard", "words", "source_quota")
    blocks = F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long")
    quotas = (
        quotas.withColumn("blocks", blocks)
        .withColumn("quota", F.least(F.col("quota"), F.lit(int(limit)) * F.col("blocks")))
        .withColumn("full", F.floor(F.col("quota") / F.col("blocks")))
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), "blocks"))
    )
    edge = lambda i: F.floor(i * F.col("words") / F.col("blocks")).cast("long")
    quotas = written(
        quotas.select(
            "src", "shard", "full", "words", edge(F.col("start")).alias("begin"),
            edge(F.col("start") + F.col("quota") % F.col("blocks")).alias("end"),
        ),
        "quotas",
    )
    return placed, quotas


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _placed(docs: DataFrame, weights, share, limit, block, shard_words, seed):
    sized = written(
        docs.select("doc_id", _source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), _key(seed).alias("key")),
        "sized",
    )
    placed, quotas = _shards(sized, weights, share, limit, block, shard_words, seed)
    stream = Window.partitionBy("src", "shard").orderBy("key", "doc_id", "size")
    at = placed.withColumn("to", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    return at.withColumn("from", F.col("to") - F.col("size")).join(quotas, ["src", "shard"]), quotas


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT, block=BLOCK, shard_words=SHARD_WORDS, seed=SEED) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken (words, repeats counted).

    At most two documents of a shard are taken in part. Null texts and texts without words have size 0
    and nothing is taken. Null sources are one source, after all others. Reruns and other partitions give the same.
    Equal quotients go to the smaller source or shard, equal hashes are ordered by doc_id and size; rows that repeat id and
    text are documents of their own, and which of them is taken does not show. A very long text is one document: it may be
    taken in part, and a shard that consists of it alone has its blocks inside it. Other columns play no part, whatever
    their names. An empty table gives an empty result.
    """
    rows, _ = _placed(docs, weights, share, limit, block, shard_words, seed)
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("to"), b) - F.greatest(F.col("from"), a))
    run = inside(F.col("begin"), F.least("end", "words")) + inside(F.lit(0), F.col("end") - F.col("words"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + run).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT, block=BLOCK, shard_words=SHARD_WORDS, seed=SEED) -> DataFrame:
    """The mix itself, in whole documents: each row as often as the mix takes it, none if it does not.

    A document belongs to a run of blocks if its middle does, so a shard misses its quota by half a document at most.
    Runs are intervals of the seeded hash, so documents meet one small row per shard and texts
    need no sort. Documents without words follow their neighbours. Columns stay as they are. Nulls, ties and repeated rows
    as in ``mix``; a very long text is taken whole or not, so its shard may miss the quota by half of it.
    """
    rows, quotas = _placed(docs, weights, share, limit, block, shard_words, seed)
    middle = (F.col("from") + F.col("to")) / 2
    first = (middle >= F.col("begin")) & (middle < F.least("end", "words"))
    wraps = middle < F.col("end") - F.col("words")
    runs = written(
        rows.groupBy("src", "shards", "shard", "full").agg(
            F.min(F.when(first, F.col("key"))).alias("low"), F.max(F.when(first, F.col("key"))).alias("high"),
            F.max(F.when(wraps, F.col("key"))).alias("around"),
        ),
        "runs",
    )
    counts = written(runs.groupBy("src").agg(F.first("shards").alias("shards")), "counts")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), _source_key(docs["source"]).alias("src"), _key(seed).alias("key"))
    known = own.join(counts, "src").withColumn("shard", F.pmod("key", "shards")).drop("shards").join(runs, ["src", "shard"])
    key = F.col("key")
    extra = key.between(F.col("low"), F.col("high")) | (key <= F.col("around"))
    times = (F.col("full") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("int")
    return known.withColumn("times", times).filter("times > 0").select(
        F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")
    ).select("doc.*")


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return mix(table(spark, folder, "documents"))
