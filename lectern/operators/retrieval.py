"""Keyword (BM25) and vector retrieval, rank fusion, re-ranking.

Questions are a table, so one job answers a whole batch. A question names the course it is asked
in; word statistics cover the whole index, as the scores of one index do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import text
from lectern.operators import scoring, vector_blocks
from lectern.operators.vector_blocks import VectorBlocks
from lectern.session import settle, written


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group. Spark keeps k rows per task before it shuffles
    (WindowGroupLimit), so a large group never meets in one task whole."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return ranked.drop("_rank") if rank is None else ranked.withColumn(rank, F.col("_rank") - 1).drop("_rank")


# ------------------------------------------------------------------ keyword index


class Stored(Protocol):
    """An index that was written before (``stored.TermIndex``)."""

    def postings(self, wanted: DataFrame) -> DataFrame: ...

    def frequency(self, wanted: DataFrame) -> DataFrame: ...

    def totals(self) -> DataFrame: ...


def postings(
    docs: DataFrame, body: str = "text", wanted: DataFrame | None = None, marked: bool = False,
    split: Callable[[Column], Column] = text.tokens, grouped: bool = False, distinct: bool = False,
) -> DataFrame:
    """(document keys, len, term, tf). With ``wanted`` (a table of terms) only those terms, dropped
    before anything is shuffled as long as Spark finds that table small enough to ship. ``marked`` adds an empty
    term to every document, so that lengths can be summed over documents that hold no wanted term.

    Words are counted inside their row. Only documents whose keys stand in several rows are counted by a shuffle, as such rows
    are one document if their lengths agree; ``grouped`` says that there are none, so that nobody looks for them, and
    ``distinct`` that ``split`` gives no word twice.

    ``explode_outer`` rather than ``explode``: the latter makes Spark test the array for emptiness
    below the projection, which would split every text a second time.
    """
    keys = [c for c in docs.columns if c != body]
    none = F.array().cast("array<string>")
    words = docs.select(*keys, F.coalesce(split(F.col(body)), none).alias("_words"))
    one = F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf"))
    found = text.listed(F.col("_words")) if distinct else text.counted(F.col("_words"))
    # the length is taken before the explode, so that no row carries the whole array
    words = words.select(*keys, F.size("_words").alias("len"), (F.array_append(found, one) if marked else found).alias("_found"))
    words = words.select(*keys, "len", F.explode_outer("_found").alias("_f")).select(*keys, "len", "_f.term", "_f.tf").filter("tf > 0")
    if wanted is not None:
        terms = wanted.select("term")
        if marked:
            terms = terms.unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term")))
        words = words.join(terms.distinct(), "term", "left_semi").select(*keys, "len", "term", "tf")
    if grouped or not repeated(docs, keys):
        return words
    return words.groupBy(*keys, "len", "term").agg(F.sum("tf").alias("tf"))


def repeated(docs: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some keys stand in several rows; reads only the keys."""
    return not docs.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()


def bm25(
    docs: DataFrame | Stored,
    questions: DataFrame,
    *,
    body: str = "text",
    scoped: bool = True,
    k1: float = C.BM25_K1,
    b: float = C.BM25_B,
    k: int | None = None,
) -> DataFrame:
    """Scores of all documents that hold a term of a question: qid, video_id, chunk_id, score.

    ``docs``: video_id, chunk_id, ``body``; ``questions``: qid, video_id, term (one row per
    distinct term). ``scoped`` keeps documents of the question's own course. Document frequencies
    are counted from the same postings. ``docs`` may be a stored index: then no text is read. With ``k`` scores that cannot be
    among the ``k`` best of a question in a course stay away.
    """
    if not isinstance(docs, DataFrame):
        totals = docs.totals().select(F.struct("n_docs", "avg_len").alias("s")).scalar()
        found, keys = docs.postings(questions), ["video_id", "chunk_id"]
        return _scores(found, keys, questions, docs.frequency(questions), totals, scoped, k1, b, k)
    keys = [c for c in docs.columns if c != body]
    # Written once: the postings of the asked terms are small next to the texts, and all uses
    # below (lengths, frequencies, scores) would otherwise split every text again.
    found = written(postings(docs, body, questions, marked=True), "postings")
    frequency = found.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    stats = found.filter("term = ''").agg(F.struct(F.count("*").alias("n_docs"), (F.sum("len") / F.count("*")).alias("avg_len")).alias("s")).scalar()
    return _scores(found, keys, questions, frequency, stats, scoped, k1, b, k)


def _scores(
    found: DataFrame, keys: list[str], questions: DataFrame, frequency: DataFrame, stats: Column, scoped: bool, k1: float, b: float,
    k: int | None = None,
) -> DataFrame:
    n_docs, avg_len = stats["n_docs"], stats["avg_len"]
    idf = F.greatest(F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(C.BM25_MIN_IDF))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("len") / avg_len))
    asked = questions.join(frequency.withColumn("idf", idf), "term").select("qid", "video_id", "term", "idf")
    return scoring.sums(found.filter("term <> ''").withColumn("weight", weight), asked, keys, scoped, k)


def keyword_hits(
    docs: DataFrame | Stored, questions: DataFrame, k: int, rank: str | None = None, *, body: str = "text"
) -> DataFrame:
    """Best ``k`` per question. Scores are ranked to nine digits: sums of many words differ in the last
    ones from run to run, and ties are to go by id."""
    scores = bm25(docs, questions, body=body, k=k)
    return top(scores, ["qid"], [F.round("score", 9).desc(), F.col("chunk_id")], k, rank)


def answered(docs: DataFrame | Stored, questions: DataFrame, *, body: str = "text") -> DataFrame:
    """Questions that ``keyword_hits`` finds anything for (qid): some document of their course holds one of their terms. Asks for no
    scores, so terms meet the distinct terms of a course and not its documents."""
    found = postings(docs, body, questions) if isinstance(docs, DataFrame) else docs.postings(questions)
    held = found.select("video_id", "term").distinct()
    return questions.join(held, ["video_id", "term"], "left_semi").select("qid").distinct()


# ------------------------------------------------------------------ vectors


def vector_hits(store: DataFrame | VectorBlocks, asked: DataFrame, k: int, rank: str | None = None) -> DataFrame:
    """Best ``k`` vectors of a question's course by cosine: qid, video_id, chunk_id, score. ``store``: video_id, chunk_id, vec, or its
    packed form; ``asked``: qid, video_id, qvec. Vectors of another length do not take part."""
    packed = VectorBlocks.pack(store) if isinstance(store, DataFrame) else store
    order = [F.round("score", vector_blocks.DIGITS).desc(), F.col("chunk_id")]
    return top(packed.search(asked, k), ["qid"], order, k, rank)


# ------------------------------------------------------------------ fusion


def fuse(ranked: Sequence[tuple[str, DataFrame]], rrf_k: int = C.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (source name, hits with a 0-based ``rank``)."""
    parts = [
        df.select("qid", "video_id", "chunk_id", "rank", F.lit(name).alias("src")) for name, df in ranked
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("qid", "video_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_set("src")).alias("sources"),
    )


def candidates(
    docs: DataFrame | Stored, questions: DataFrame, store: DataFrame | VectorBlocks, asked: DataFrame, *, k: int = C.TOP_K
) -> DataFrame:
    """Keyword and vector hits of every question, max(4k, 20) of each, fused."""
    pool = max(k * 4, 20)
    return fuse(
        [
            ("keyword", keyword_hits(docs, questions, pool, "rank")),
            ("vector", vector_hits(store, asked, pool, "rank")),
        ]
    )


def hybrid(
    docs: DataFrame | Stored,
    questions: DataFrame,
    store: DataFrame,
    asked: DataFrame,
    *,
    k: int = C.TOP_K,
    within: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` fused hits per question with a 0-based ``rank``; ``within`` (qid, chunk_id)
    restricts hits to one chapter."""
    fused = candidates(docs, questions, store, asked, k=k)
    if within is not None:
        fused = fused.join(within, ["qid", "chunk_id"], "left_semi")
    return top(fused, ["qid"], [F.col("score").desc(), F.col("chunk_id")], k, "rank")


def time_bias(fused: DataFrame, positions: DataFrame) -> DataFrame:
    """Raise hits near the playing position a little. ``positions``: qid, chunk_id, distance_ms."""
    near = 1 + F.lit(C.TIME_BIAS_WEIGHT) / (1 + F.col("distance_ms") / C.TIME_BIAS_SCALE_MS)
    return (
        fused.join(positions, ["qid", "chunk_id"], "left")
        .withColumn("score", F.col("score") * F.when(F.col("distance_ms").isNull(), 1.0).otherwise(near))
        .drop("distance_ms")
    )


def rerank(hits: DataFrame, scores: DataFrame, *, head: int = max(C.RERANK_TOP_N * 6, 20)) -> DataFrame:
    """Re-order the first ``head`` hits by new scores; the tail keeps its order behind them.

    ``hits``: qid, chunk_id, rank, score; ``scores``: qid, chunk_id, new_score. If a question has
    no new scores at all (the scorer failed), its order stays.
    """
    joined = hits.join(scores, ["qid", "chunk_id"], "left")
    in_head = (F.col("rank") < head) & F.col("new_score").isNotNull()
    w = Window.partitionBy("qid").orderBy(
        in_head.desc(), F.when(in_head, F.col("new_score")).desc_nulls_last(), F.col("rank")
    )
    return (
        joined.withColumn("new_rank", F.row_number().over(w) - 1)
        .withColumn("score", F.when(in_head, F.col("new_score")).otherwise(F.col("score")))
        .drop("new_score", "rank")
        .withColumnRenamed("new_rank", "rank")
    )


def fallback(
    asked: DataFrame, found: DataFrame, chunks: DataFrame, k: int = C.TOP_K
) -> DataFrame:
    """Questions without any candidate in ``found`` (qid) get the first chunks of their course (max(3, min(k, 5)))."""
    n = max(3, min(k, 5))
    lost = asked.select("qid", "video_id").join(found.select("qid").distinct(), "qid", "left_anti")
    opening = top(chunks.select("video_id", "chunk_id", "idx"), ["video_id"], [F.col("idx")], n)
    return lost.join(opening, "video_id").withColumn("score", F.lit(0.0)).withColumn("source", F.lit("fallback"))


def search(
    asked: DataFrame,
    docs: DataFrame,
    questions: DataFrame,
    store: DataFrame,
    vectors_asked: DataFrame,
    *,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    k: int = C.TOP_K,
    head: int = max(C.RERANK_TOP_N * 6, 20),
    index: Stored | None = None,
) -> DataFrame:
    """The whole in-course search of a batch of questions: qid, video_id, chunk_id, score, sources, rank.

    ``asked``: qid, video_id, chapter_id (NULL = whole course), at_ms (NULL = no playing position); ``docs``: video_id,
    chunk_id, idx, parent_id, start_ms, text; ``questions``, ``store`` and ``vectors_asked`` as in ``candidates``.
    Keyword and vector hits are fused, restricted to the chapter, raised near the playing position and cut to the pool;
    ``scorer`` (hits -> qid, chunk_id, new_score) re-orders the head of the pool before the cut to ``k``. Only a question
    without any candidate in its course falls back to the opening of its chapter or course.
    """
    pool = max(k * 4, 20)
    texts = docs.select("video_id", "chunk_id", "text") if index is None else index
    fused = settle(candidates(texts, questions, store, vectors_asked, k=k))
    wish = asked.select("qid", "chapter_id", "at_ms")
    places = docs.select("video_id", "chunk_id", "parent_id", "start_ms")
    rows = fused.join(wish, "qid").join(places, ["video_id", "chunk_id"])
    rows = rows.filter(F.col("chapter_id").isNull() | (F.col("parent_id") == F.col("chapter_id")))
    near = 1 + F.lit(C.TIME_BIAS_WEIGHT) / (1 + F.abs(F.col("start_ms") - F.col("at_ms")) / C.TIME_BIAS_SCALE_MS)
    rows = rows.withColumn("score", F.col("score") * F.coalesce(near, F.lit(1.0)))
    hits = top(rows, ["qid"], [F.round("score", 12).desc(), F.col("chunk_id")], pool, "rank").select(
        "qid", "video_id", "chunk_id", "score", "sources", "rank"
    )
    if scorer is not None:
        several = hits.groupBy("qid").agg(F.count("*").alias("n")).filter("n > 1").select("qid")
        scores = scorer(hits.filter(F.col("rank") < head)).join(several, "qid", "left_semi").filter("new_score IS NOT NULL")
        tags = scores.select("qid", "chunk_id", F.lit(True).alias("_new"))
        hits = rerank(hits, scores, head=head).join(tags, ["qid", "chunk_id"], "left").withColumn(
            "sources", F.when(F.col("_new"), F.array_append("sources", F.lit("rerank"))).otherwise(F.col("sources"))
        )
    best = hits.filter(F.col("rank") < k).select("qid", "video_id", "chunk_id", "score", "sources", "rank")
    lost = asked.join(fused.select("qid").distinct(), "qid", "left_anti")
    inside = lost.join(docs.select("video_id", "chunk_id", "idx", "parent_id"), "video_id").filter(
        F.col("chapter_id").isNull() | (F.col("parent_id") == F.col("chapter_id"))
    )
    opening = top(inside, ["qid"], [F.col("idx")], max(3, min(k, 5)), "rank").select(
        "qid", "video_id", "chunk_id", F.lit(0.0).alias("score"), F.array(F.lit("fallback")).alias("sources"), "rank"
    )
    return best.unionByName(opening)
