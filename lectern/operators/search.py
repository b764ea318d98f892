"""In-course search over six stages, and search across courses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text
from lectern.operators import retrieval
from lectern.operators.retrieval import Stored
from lectern.session import written

HIT = ("qid", "stage", "pos", "idx", "start_ms", "end_ms", "text", "score", "source")


@dataclass
class Indexes:
    """Stored indexes of a library: words of sentences, words of chunks, and three-character pieces of everything that is searched
    by substring (documents (video_id, block) of ``searchable``, see ``blocks``)."""

    segment_words: Stored
    chunk_words: Stored
    pieces: Stored


def piece_list(body: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def block_pieces(texts: Column) -> Column:
    """``piece_list`` of several texts together."""
    return F.array_distinct(F.flatten(F.transform(texts, piece_list)))


FIELDS = ("title", "summary", "ocr_text", "text")
#: 2 ** BLOCK_BITS neighbouring rows have one entry in the index of pieces: most of their pieces are the same.
BLOCK_BITS = 6
#: kind -> (stage, score, the row's name within its course, fields that are searched)
_KINDS = {
    "segment": (2, C.STAGE_SEGMENT_LIKE, "seg_key", ("text",)),
    "chunk": (4, C.STAGE_CHUNK_LIKE, "chunk_id", FIELDS),
    "slide": (5, C.STAGE_SLIDE_LIKE, "idx", ("ocr_text",)),
    "chapter": (6, C.STAGE_CHAPTER_LIKE, "idx", ("title", "summary")),
}


def searchable(segments: DataFrame, chunks: DataFrame, slides: DataFrame, chapters: DataFrame) -> DataFrame:
    """All rows that substring search looks at: video_id, kind, key, block, idx, start_ms, end_ms and the fields it looks at. Rows that
    are numbered by a column ``place`` share a block with their neighbours, others are a block each (``block`` is their key)."""
    out = None
    for (kind, (_, _, key, fields)), rows in zip(_KINDS.items(), (segments, chunks, slides, chapters)):
        named = lambda c, kind=kind: F.concat_ws(":", F.lit(kind), c.cast("string"))
        block = F.shiftright("place", BLOCK_BITS) if "place" in rows.columns else F.col(key)
        part = rows.select(
            "video_id", F.lit(kind).alias("kind"), named(F.col(key)).alias("key"), named(block).alias("block"),
            F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms",
            *[(F.col(f) if f in fields else F.lit(None).cast("string")).alias(f) for f in FIELDS],
        )
        out = part if out is None else out.unionByName(part)
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """What the index of pieces is made of (split by ``block_pieces``): rows of ``searchable`` by block, as (video_id, chunk_id, text), the
    block's name and the array of its texts."""
    body = F.concat_ws("\n", *FIELDS)
    texts = rows.groupBy("video_id", F.col("block").alias("chunk_id")).agg(F.collect_list(body).alias("text"))
    return texts.withColumn("text", F.array_sort("text"))


def like_pairs(rows: DataFrame, asked: DataFrame, pieces: Stored | None = None) -> DataFrame:
    """Rows of ``searchable`` with a field that holds the text ``q`` of a question of their course, ignoring case.

    With an index a question meets, of each kind, only the rows of blocks that hold its rarest piece of three characters in its course;
    one without a whole piece asks for the empty term, which every block has. Without an index it meets all rows of its course.
    """
    held = [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lower(F.col("q"))) for f in FIELDS]
    if pieces is None:
        pairs = rows.join(asked, "video_id")
    else:
        own = F.when(F.length(F.lower("q")) < 3, F.array(F.lit(""))).otherwise(piece_list(F.col("q")))
        needles = asked.select("qid", "video_id", F.explode(own).alias("term"))
        wanted = needles.select("video_id", "term").distinct()
        found = pieces.postings(wanted).select("video_id", "term", F.col("chunk_id").alias("block")).join(wanted, ["video_id", "term"])
        found = written(found.withColumn("kind", F.substring_index("block", ":", 1)), "pieces")
        counts = found.groupBy("video_id", "term", "kind").agg(F.count("*").alias("n"))
        kinds = F.explode(F.array(*map(F.lit, _KINDS))).alias("kind")
        rarest = needles.select("*", kinds).join(counts, ["video_id", "term", "kind"], "left").groupBy("qid", "video_id", "kind").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("term"))).alias("r")
        )
        chosen = rarest.filter("r.n > 0").select("qid", "video_id", "kind", F.col("r.term").alias("term"))
        places = chosen.join(found, ["video_id", "term", "kind"]).select("qid", "video_id", "block").join(asked.select("qid", "q"), "qid")
        pairs = rows.join(places, ["video_id", "block"])
    hit = held[0]
    for one in held[1:]:
        hit = hit | one
    return pairs.filter(hit)


def _stage(rows: DataFrame, number: Column | int, body: Column, score: Column, source: Column) -> DataFrame:
    number = F.lit(number) if isinstance(number, int) else number
    return rows.select(
        "qid", number.alias("stage"), "pos", F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms",
        body.alias("text"), score.cast("double").alias("score"), source.alias("source"),
    )


def course_search(
    asked: DataFrame,
    terms: DataFrame,
    *,
    segments: DataFrame,
    chunks: DataFrame,
    slides: DataFrame,
    chapters: DataFrame,
    k: int = C.SEARCH_TOP_K,
    cut: bool = True,
    indexes: Indexes | None = None,
) -> DataFrame:
    """``asked``: qid, video_id, q (blank questions find nothing); ``terms``: qid, video_id, term.

    Recognised speech often gets names wrong that slides and titles get right, so all are searched.
    Near-equal places (same ``start_ms`` bucket) show once; the earliest stage wins, then the rest
    is ordered by score (``cut=False`` stops before that). ``indexes`` are the stored indexes of the four tables; sentences
    and chunks are named there by ``seg_key`` and ``chunk_id``.
    """
    asked = written(asked.filter(text.strip(F.col("q")) != "").select("qid", "video_id", "q"), "asked")
    terms = terms.select("qid", "video_id", "term")
    ix = indexes or Indexes(None, None, None)
    q = F.col("q")

    def ranked(rows, body, words):
        keyed = rows.select("video_id", "chunk_id", body.alias("text")) if words is None else words
        hits = retrieval.keyword_hits(keyed, terms, k, "pos").withColumnRenamed("score", "bm")
        return hits.join(rows, ["video_id", "chunk_id"]).join(asked.select("qid", "q"), "qid")

    seg_hits = ranked(segments.withColumnRenamed("seg_key", "chunk_id"), F.col("text"), ix.segment_words)
    chunk_hits = ranked(chunks, text.fused_text(F.col("text"), F.col("ocr_text")), ix.chunk_words)
    chunk_snip = text.snippet(q, F.col("title"), F.col("ocr_text"), F.col("text"))
    like_snip = text.snippet(q, F.col("title"), F.col("summary"), F.col("ocr_text"), F.col("text"))
    slide_snip = F.concat(
        F.lit("[课件] "),
        F.coalesce(F.nullif(text.clip_around(q, F.col("ocr_text"), 80), F.lit("")), F.substring("ocr_text", 1, 120)),
    )
    chapter_line = F.concat(F.lit("[章节] "), text.chapter_title(F.col("title"), F.col("idx")))
    pairs = like_pairs(searchable(segments, chunks, slides, chapters), asked, ix.pieces)
    like_hits = retrieval.top(pairs, ["qid", "kind"], [F.col("start_ms"), F.col("idx")], k, "pos")
    kind = F.col("kind")
    per_kind = lambda n: F.create_map(*[F.lit(x) for name, row in _KINDS.items() for x in (name, row[n])])[kind]
    like_body = (
        F.when(kind == "segment", F.col("text")).when(kind == "chunk", like_snip).when(kind == "slide", slide_snip).otherwise(chapter_line)
    )
    union = (
        _stage(seg_hits, 1, F.col("text"), F.col("bm") + C.STAGE_SEGMENT_INDEX, F.lit("segment"))
        .unionByName(_stage(chunk_hits, 3, chunk_snip, F.col("bm") + C.STAGE_CHUNK_INDEX, F.lit("chunk")))
        .unionByName(_stage(like_hits, per_kind(0), like_body, per_kind(1), kind))
    )
    once = bucket_dedupe(union)
    return search_top(once, k) if cut else once


def bucket_dedupe(hits: DataFrame, width: int = C.SEARCH_BUCKET_MS) -> DataFrame:
    """One hit per time bucket: the one that came first by (stage, position)."""
    bucket = F.floor(F.col("start_ms") / width)
    rest = [c for c in hits.columns if c not in ("qid",)]
    return (
        hits.groupBy("qid", bucket.alias("_bucket"))
        .agg(F.min_by(F.struct(*rest), F.struct("stage", "pos")).alias("h"))
        .select("qid", *[F.col(f"h.{c}").alias(c) for c in rest])
    )


def search_top(hits: DataFrame, k: int = C.SEARCH_TOP_K) -> DataFrame:
    order = [F.round("score", 9).desc(), F.col("start_ms"), F.col("stage"), F.col("pos")]
    return retrieval.top(hits, ["qid"], order, k, "rank")


def cross_course(
    terms: DataFrame,
    chunks: DataFrame,
    titles: DataFrame,
    *,
    per_course: int = C.CROSS_PER_COURSE,
    index: Stored | None = None,
) -> DataFrame:
    """Best chunks over all courses: top ``per_course`` of each course, then one cut over all.

    Only the survivors (a few per question) are joined with their texts.
    """
    scores = retrieval.bm25(chunks.select("video_id", "chunk_id", "text") if index is None else index, terms, scoped=False, k=per_course)
    each = retrieval.top(scores, ["qid", "video_id"], [F.round("score", 9).desc(), F.col("chunk_id")], per_course)
    best = retrieval.top(each, ["qid"], [F.round("score", 9).desc(), F.col("chunk_id")], max(8, per_course * 2), "rank")
    return (
        best.join(chunks.select("video_id", "chunk_id", "start_ms", "end_ms", "text"), ["video_id", "chunk_id"])
        .join(titles.select("video_id", F.col("title").alias("course")), "video_id", "left")
        .withColumn("title", F.coalesce(F.nullif("course", F.lit("")), F.col("video_id")))
        .withColumn("text", F.substring("text", 1, 240))
        .withColumn("label", clock.clock_label(F.col("start_ms")))
        .drop("course")
    )


def evidence_text(hits: DataFrame) -> DataFrame:
    """The found places of a question as prompt lines, in rank order (at most ten per question)."""
    line = F.concat(F.lit("- 《"), "title", F.lit("》["), "label", F.lit("] "), "text")
    return hits.groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("evidence")
    )
