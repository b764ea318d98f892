"""Prompt material under a character budget.

Course-wide texts are only ever gathered up to their budget: running lengths over spread blocks tell which rows
begin within it. Sums and size histograms cover the rest of the course.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text as X
from lectern.operators import ordered
from lectern.session import settle, written


def joined(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, sep: str, name: str) -> DataFrame:
    """Ordered text of a bounded group."""
    item = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]), sep).alias(name)
    )


def waterfill_levels(sizes: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Per key the water level of the allocation: an item gets its size if that is at most
    ``level``, else ``level``. NULL level: everything fits.

    ``sizes``: key, size; ``budgets``: key, budget. Works on the histogram of sizes (sizes beyond
    the budget count as budget + 1), so a key of any number of items shrinks to at most budget + 2
    rows before it is ordered. Items are counted by size before they meet their budget.
    """
    counts = sizes.groupBy(key, "size").agg(F.count("*").alias("n"))
    capped = counts.join(budgets, key).withColumn("size", F.least(F.col("size"), F.col("budget") + 1))
    hist = capped.groupBy(key, "budget", "size").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key).orderBy("size")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key)
    run = hist.select(
        key, "budget", "size",
        F.coalesce(F.sum(F.col("size") * F.col("n")).over(below), F.lit(0)).alias("used"),
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("served"),
        F.sum("n").over(every).alias("items"),
    )
    share = F.floor((F.col("budget") - F.col("used")) / (F.col("items") - F.col("served")))
    return run.groupBy(key, "budget").agg(
        F.max("items").alias("items"),
        F.min_by(F.when(F.col("size") > share, F.greatest(share, F.lit(0))), F.when(F.col("size") > share, F.col("size"))).alias("level"),
    ).withColumn("level", F.when(F.col("budget") < F.col("items"), F.lit(0)).otherwise(F.col("level")).cast("long"))


def waterfill(items: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Adds ``limit`` to every item (columns key, size, ...)."""
    # a row per key: its size is known once it is written, so that Spark need not deal the items out by key
    levels = written(waterfill_levels(items.select(key, "size"), budgets, key).select(key, "level"), "levels")
    return items.join(levels, key, "left").withColumn(
        "limit", F.when(F.col("level").isNull(), F.col("size")).otherwise(F.least("size", "level"))
    ).drop("level")


def starts_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """Rows that begin within the first ``budget`` characters of their key, with ``_at``, the characters before.

    Only keys, order and sizes are ordered, spread over blocks, so a key may hold any part of the table; the rows
    that are left of a key have at most ``budget`` characters and one row more. (keys, order) must be unique.
    """
    narrow = rows.select(*keys, *order, size.cast("long").alias("_size"))
    at = ordered.prefix(ordered.blocks(narrow, keys, order), keys, order, {"_at": ("sum", F.col("_size"))})
    # written, so that its size is known: where few rows are left the texts of the others need not be shuffled
    near = written(at.filter(F.col("_at") <= budget).select(*keys, *order, "_at"), "near")
    return rows.join(near, [*keys, *order])


def prefix_take(blocks: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Blocks in order until the next one would exceed the budget (it is not skipped)."""
    first = starts_within(blocks.withColumn("_size", size), [key], [order], F.col("_size"), budget)
    return first.filter(F.col("_at") + F.col("_size") <= budget).drop("_size", "_at")


# ------------------------------------------------------------------ whole-course prefix


def course_head(courses: DataFrame, chapters: DataFrame, max_chars: int) -> DataFrame:
    """Title, length, summary and chapter list of a course, with the length of the whole head
    (``head_len``). Only chapters that can show within ``max_chars`` are gathered."""
    line = F.concat(
        F.lit("- ["), clock.clock_label(F.col("start_ms")), F.lit("] "), X.chapter_title(F.col("title"), F.col("idx")),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("："), X.strip(F.col("summary")))).otherwise(""),
    )
    lined = chapters.select("video_id", "idx", line.alias("_line"))
    near = starts_within(lined, ["video_id"], ["idx"], F.length("_line") + 1, max_chars)
    listed = joined(near, ["video_id"], ["idx"], "_line", "\n", "_chapters")
    lengths = lined.groupBy("video_id").agg((F.sum(F.length("_line") + 1) - 1).alias("_all"))
    summary = X.strip(X.without_outline(F.col("video_summary")))
    head = courses.join(listed, "video_id", "left").join(lengths, "video_id", "left").select(
        "video_id",
        (F.coalesce("_all", F.lit(0)) - F.coalesce(F.length("_chapters"), F.lit(0))).alias("_hidden"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("# 课程材料："), F.coalesce(F.nullif("title", F.lit("")), F.lit("未命名课程"))),
            F.concat(F.lit("总时长："), clock.clock_label(F.col("duration_ms"))),
            F.when(F.coalesce("video_summary", F.lit("")) != "", F.concat(F.lit("\n## 全课摘要\n"), summary)),
            F.when(F.col("_chapters").isNotNull(), F.concat(F.lit("\n## 章节结构\n"), "_chapters")),
        ).alias("head"),
    )
    return head.withColumn("head_len", F.length("head") + F.col("_hidden")).drop("_hidden")


def full_prefix(
    courses: DataFrame, chapters: DataFrame, chunks: DataFrame, max_chars: int = C.PREFIX_MAX_CHARS
) -> DataFrame:
    """The whole transcript with slide text as far as the budget allows.

    Speech is never cut; the room that is left is shared among the slide texts by water-filling,
    measured after they are compacted. Byte-stable for the same data.
    """
    head = course_head(courses, chapters, max_chars)
    mark = F.concat(F.lit("\n【"), clock.clock_label(F.col("start_ms")), F.lit("】"))
    ocr = F.when(F.coalesce("ocr_text", F.lit("")) == "", "").otherwise(X.compact_lines(F.col("ocr_text"), None))
    # only lengths are measured, shared out and ordered; the texts of the rows that show meet them at the end. Written, as they are read twice
    body = written(chunks.select(
        "video_id", "idx", F.length(mark).alias("mark"), F.length("text").alias("text"), F.length(ocr).alias("size"),
    ), "lengths")
    has_ocr = F.when(F.col("size") > 0, 1).otherwise(0)
    fixed = body.groupBy("video_id").agg(
        # label + text, their two line breaks, slide label and its line break
        (F.sum(F.col("mark") + F.col("text") + 2 + has_ocr * (len(C.OCR_LABEL) + 1))).alias("fixed")
    )
    # the head counts its own line breaks; one more joins it to the transcript heading
    room = F.lit(max_chars) - F.col("head_len") - len("\n## 逐字稿") - 2 - F.coalesce("fixed", F.lit(0))
    budgets = head.join(fixed, "video_id", "left").select("video_id", F.greatest(F.lit(0), room).alias("budget"))
    limited = waterfill(body, budgets, "video_id")
    slide = (F.col("size") > 0) & (F.col("limit") > 0)
    # mark, slide label with as much of the slide text as its limit, text, each with its line break; what is null is no line
    lines = [F.col("mark") + 1, F.when(slide, len(C.OCR_LABEL) + F.least("size", "limit") + 1), F.col("text") + 1]
    taken = F.greatest(F.lit(1), sum((F.coalesce(n, F.lit(0)) for n in lines), F.lit(0)))
    near = starts_within(limited, ["video_id"], ["idx"], taken, max_chars).select("video_id", "idx", "size", "limit", "_at")
    rows = chunks.select("video_id", "idx", mark.alias("_mark"), "text", ocr.alias("_ocr")).join(written(near, "shown"), ["video_id", "idx"])
    shown = F.when(F.col("size") <= F.col("limit"), F.col("_ocr")).otherwise(
        F.concat(F.substring(F.col("_ocr"), F.lit(1), F.greatest(F.lit(0), F.col("limit") - 1).cast("int")), F.lit(C.ELLIPSIS))
    )
    part = F.concat_ws("\n", "_mark", F.when(slide, F.concat(F.lit(C.OCR_LABEL), shown)), "text")
    # what starts beyond the cut is left out, and the part that crosses it is cut one character later
    near = rows.select("video_id", "idx", F.substring(part, F.lit(1), (F.lit(max_chars + 1) - F.col("_at")).cast("int")).alias("_part"))
    transcript = joined(near, ["video_id"], ["idx"], "_part", "\n", "_transcript")
    whole = head.join(transcript, "video_id", "left").select(
        "video_id", F.concat_ws("\n", "head", F.lit("\n## 逐字稿"), "_transcript").alias("prefix")
    )
    return _measured(whole, max_chars)


def _measured(whole: DataFrame, max_chars: int) -> DataFrame:
    """Prefixes cut at ``max_chars`` with a notice, and their estimated tokens."""
    return whole.withColumn(
        "prefix",
        F.when(F.length("prefix") > max_chars, F.concat(F.substring("prefix", 1, max_chars), F.lit(C.CUT_NOTICE)))
        .otherwise(F.col("prefix")),
    ).withColumn("tokens", X.estimate_tokens(F.length("prefix")))


def outline_lines(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Outline of a course as rows in reading order (video_id, ch, idx, line): chapter headings
    (idx = -1) and the points of their chunks."""
    heads = chapters.select(
        "video_id", F.col("idx").alias("ch"), F.lit(-1).cast("long").alias("idx"),
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("\n## "), X.chapter_title(F.col("title"), F.col("idx")), F.lit("　["), clock.clock_label(F.col("start_ms")),
                F.lit(" - "), clock.clock_label(F.col("end_ms")), F.lit("]"),
            ),
            F.nullif(X.strip(F.coalesce("summary", F.lit(""))), F.lit("")),
        ).alias("line"),
    )
    label = clock.clock_label(F.col("start_ms"))
    point = F.concat(
        F.lit("- ["), label, F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), label),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("："), X.strip(F.col("summary")))).otherwise(""),
    )
    of = chapters.select("video_id", F.col("chapter_id").alias("parent_id"), F.col("idx").alias("ch"))
    points = chunks.join(of, ["video_id", "parent_id"]).select("video_id", "ch", F.col("idx").cast("long").alias("idx"), point.alias("line"))
    return heads.unionByName(points)


def outline_prefix(
    courses: DataFrame, chapters: DataFrame, chunks: DataFrame, max_chars: int = C.PREFIX_MAX_CHARS
) -> DataFrame:
    """Title, length, summary and outline of a course as one text, cut at ``max_chars`` like the full prefix, so a course of
    any size gathers no more than that."""
    lines = outline_lines(chapters, chunks)
    near = starts_within(lines, ["video_id"], ["ch", "idx"], F.length("line") + 1, max_chars).withColumn(
        "line", F.substring("line", F.lit(1), (F.lit(max_chars + 1) - F.col("_at")).cast("int"))
    )
    listed = joined(near, ["video_id"], ["ch", "idx"], "line", "\n", "_lines")
    whole = courses.join(listed, "video_id", "left").select(
        "video_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("# 课程大纲："), F.coalesce(F.nullif("title", F.lit("")), F.lit("未命名课程"))),
            F.concat(F.lit("总时长："), clock.clock_label(F.col("duration_ms"))),
            F.when(
                F.coalesce("video_summary", F.lit("")) != "",
                F.concat(F.lit("\n## 全课摘要\n"), X.strip(X.without_outline(F.col("video_summary")))),
            ),
            "_lines",
        ).alias("prefix"),
    )
    return _measured(whole, max_chars)


def prefix_inputs(courses: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """One hash per course (video_id, inputs) of all that its prefix is made of, whatever the order of rows."""
    def hashed(rows: DataFrame, kind: int, columns: Sequence[str]) -> DataFrame:
        # a null is hashed as nothing, so its place is told by a flag
        told = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
        return rows.select("video_id", F.xxhash64(F.lit(kind), *told).alias("h"))

    rows = (
        hashed(courses, 0, ["title", "duration_ms", "video_summary"])
        .unionByName(hashed(chapters, 1, ["chapter_id", "idx", "title", "summary", "start_ms", "end_ms"]))
        .unionByName(hashed(chunks, 2, ["chunk_id", "parent_id", "idx", "title", "summary", "start_ms", "text", "ocr_text"]))
    )
    sums = [F.sum(h.cast("decimal(20,0)")).cast("string").alias(n) for h, n in ((F.col("h"), "x"), (F.xxhash64("h"), "y"))]
    return rows.groupBy("video_id").agg(*sums).select("video_id", F.xxhash64("x", "y").alias("inputs"))


def stale_prefixes(
    courses: DataFrame, chapters: DataFrame, chunks: DataFrame, stored: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(courses whose prefix must be built with their hash, stored prefixes that still hold)."""
    now = prefix_inputs(courses, chapters, chunks).join(courses.select("video_id"), "video_id", "left_semi")
    key = ["video_id", "inputs"]
    return now.join(stored, key, "left_anti"), stored.join(now, key, "left_semi")


def choose_prefixes(
    courses: DataFrame,
    chapters: DataFrame,
    chunks: DataFrame,
    stored: DataFrame | None = None,
    *,
    max_chars: int = C.PREFIX_MAX_CHARS,
    max_tokens: int = C.PREFIX_TOKEN_BUDGET,
) -> DataFrame:
    """The prefix a question of the course is asked with: the full one, or the outline where the full one, measured as it
    is, exceeds ``max_tokens``. Columns video_id, inputs, prefix, tokens, used_outline.

    ``stored`` is an earlier result: only courses whose inputs have changed since are built, the others are taken from it,
    courses that are gone are left out. It must have been made with the same limits.
    """
    kept = None
    if stored is None:
        todo = written(prefix_inputs(courses, chapters, chunks).join(courses.select("video_id"), "video_id", "left_semi"), "todo")
    else:
        todo, kept = stale_prefixes(courses, chapters, chunks, stored)
        todo = written(todo, "todo")  # a row per course, as ``long`` below: courses are picked without dealing out their texts by course
        courses, chapters, chunks = (d.join(todo.select("video_id"), "video_id", "left_semi") for d in (courses, chapters, chunks))
    full = settle(full_prefix(courses, chapters, chunks, max_chars))
    long = written(full.filter(F.col("tokens") > max_tokens).select("video_id"), "long")
    outline = outline_prefix(*(d.join(long, "video_id", "left_semi") for d in (courses, chapters, chunks)), max_chars)
    built = full.filter(F.col("tokens") <= max_tokens).withColumn("used_outline", F.lit(False)).unionByName(
        outline.withColumn("used_outline", F.lit(True))
    )
    built = todo.join(built, "video_id").select("video_id", "inputs", "prefix", "tokens", "used_outline")
    return built if kept is None else built.unionByName(kept.select(*built.columns))


def citation_prefix(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Only the found chunks (a handful per question), for libraries of many courses."""
    span = F.concat(F.lit("\n【"), clock.clock_label(F.col("start_ms")), F.lit(" - "), clock.clock_label(F.col("end_ms")), F.lit("】"))
    part = F.concat_ws(
        "\n", span, "text",
        F.when(F.coalesce("ocr_text", F.lit("")) != "", F.concat(F.lit(C.OCR_LABEL), X.compact_lines(F.col("ocr_text")))),
    )
    rows = hits.join(chunks, ["video_id", "chunk_id"]).withColumn("_part", part)
    return joined(rows, ["qid"], ["rank"], "_part", "\n", "_body").select(
        "qid", F.concat(F.lit("# 检索到的课程片段\n"), "_body").alias("prefix")
    )


def series_line(title: Column, video_id: Column, summary: Column, limit: int = 1200) -> Column:
    """One course of a series prefix."""
    text = X.strip(F.coalesce(summary, F.lit("")))
    short = F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), r"\s+\z", ""), F.lit(C.ELLIPSIS))).otherwise(text)
    name = F.coalesce(F.nullif(title, F.lit("")), video_id)
    return F.concat(
        F.lit("## 《"), name, F.lit("》（video_id="), video_id, F.lit("）\n"),
        F.coalesce(F.nullif(short, F.lit("")), F.lit("（尚无全课摘要）")), F.lit("\n"),
    )


def question_text(questions: DataFrame, history: DataFrame, spans: DataFrame) -> DataFrame:
    """What changes per question goes after the stable prefix: recent talk, the question, the
    playing position, the chapter, likely places.

    ``questions``: qid, session_id, question, current_ms, chapter; ``history``: qid, pos, role,
    content (at most HISTORY_MESSAGES each); ``spans``: qid, rank, start_ms, end_ms.
    """
    said = F.concat(
        F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit("："), X.fit(X.strip(F.col("content")), C.HISTORY_CHARS)
    )
    talk = joined(history.withColumn("_line", said), ["qid"], ["pos"], "_line", "\n", "_talk")
    place = F.concat(clock.clock_label(F.col("start_ms")), F.lit("-"), clock.clock_label(F.col("end_ms")))
    places = joined(spans.filter(F.col("rank") < C.HINT_SPANS).withColumn("_s", place), ["qid"], ["rank"], "_s", "、", "_places")
    return questions.join(talk, "qid", "left").join(places, "qid", "left").select(
        "qid",
        F.concat_ws(
            "\n",
            F.when(F.col("_talk").isNotNull(), F.concat(F.lit("【此前对话】（仅供理解指代与追问，课程事实仍以材料为准）\n"), "_talk", F.lit("\n"))),
            F.concat(F.lit("用户问题："), "question"),
            F.when(F.col("current_ms").isNotNull(), F.concat(F.lit("（用户当前播放到 "), clock.clock_label(F.col("current_ms")), F.lit("，仅作参考，不代表问题范围）"))),
            F.when(F.col("chapter").isNotNull(), F.concat(F.lit("（用户限定只在本章回答："), "chapter", F.lit("）"))),
            F.when(F.col("_places").isNotNull(), F.concat(F.lit("（以下是检索到的可能相关位置，供你优先核对："), "_places", F.lit("）"))),
        ).alias("prompt"),
    )


def chapter_transcripts(
    chunks: DataFrame, keys: Sequence[str], order: str = "idx", budget: int = C.CHAPTER_CHAR_BUDGET
) -> DataFrame:
    """Transcript of a chapter under a budget: speech first, slide text in what is left, stop at
    the first cut speech. Columns start_ms, text, ocr_text.

    Labels and speech come in full until the budget is used up, so only chunks whose labels and speech begin
    within it can show; the others are left out before anything is gathered.
    """
    mark = F.concat(F.lit("\n【"), clock.clock_label(F.col("start_ms")), F.lit("】"))
    taken = F.length(mark) + 1 + F.length(F.coalesce("text", F.lit("")))
    near = starts_within(chunks, keys, [order], taken, budget)
    row = F.struct(
        F.col(order).alias("n"),
        mark.alias("head"),
        F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))).alias("tail"),
        F.coalesce("ocr_text", F.lit("")).alias("ocr"),
    )
    start = F.struct(
        F.lit(0).alias("total"), F.lit(False).alias("cut"), F.lit(False).alias("stop"), F.lit("").alias("out")
    )
    label = len("\n" + C.OCR_LABEL)

    def step(s: Column, c: Column) -> Column:
        left = F.lit(budget) - s["total"]
        room = F.greatest(F.lit(0), left - F.length(c["head"]))
        tail = X.fit(c["tail"], room)
        tail_cut = F.length(tail) < F.length(c["tail"])
        ocr_room = left - F.length(c["head"]) - F.length(tail) - label
        shown = X.fit(c["ocr"], ocr_room)
        ocr = F.when((c["ocr"] != "") & (ocr_room > 0), F.concat(F.lit("\n" + C.OCR_LABEL), shown)).otherwise("")
        ocr_cut = (c["ocr"] != "") & ((ocr_room <= 0) | (F.length(shown) < F.length(c["ocr"])))
        part = F.concat(c["head"], ocr, tail)
        went_on = F.struct(
            (s["total"] + F.length(part)).alias("total"), (s["cut"] | tail_cut | ocr_cut).alias("cut"),
            tail_cut.alias("stop"), F.when(s["out"] == "", part).otherwise(F.concat(s["out"], F.lit("\n"), part)).alias("out"),
        )
        full = F.struct(s["total"].alias("total"), F.lit(True).alias("cut"), F.lit(True).alias("stop"), s["out"].alias("out"))
        return F.when(s["stop"], s).when(left <= 0, full).otherwise(went_on)

    def finish(s: Column) -> Column:
        return F.when(s["cut"], F.concat_ws("\n", s["out"], F.lit(C.CHAPTER_CUT_NOTICE))).otherwise(s["out"])

    return near.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows")).select(
        *keys, F.aggregate("_rows", start, step, finish).alias("transcript")
    )
