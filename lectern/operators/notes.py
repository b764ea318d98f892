"""Study notes: checked guides, term tables, roll-ups, document assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text as X
from lectern.functions.lists import unfold
from lectern.operators import context, glossary, intervals, ordered, patterns, retrieval
from lectern.session import written


def guide_times(line: Column) -> Column:
    """Times of a closing line '> 时间 MM:SS', NULL when the line is none."""
    norm = X.strip(F.regexp_replace(F.regexp_replace(line, r"^[>\s*]+", ""), r"[*\s]+$", ""))
    body = F.regexp_extract(norm, r"^时间\s*(.+)$", 1)
    times = F.regexp_extract_all(body, F.lit(C.RE_GUIDE_TIME), F.lit(1))
    return F.when(F.size(times) > 0, times)


def verify_guides(guides: DataFrame, anchors: DataFrame, tolerance: int = C.GUIDE_TOLERANCE_MS) -> DataFrame:
    """Keep only paragraphs that close with a time near a real anchor of the course.

    ``guides``: gid, video_id, text; ``anchors``: video_id, start_ms. Wrong times are dropped from a
    line that also has right ones; text after the last time line has no anchor and goes, so a guide without any
    time line becomes empty. The lines of one guide are one reply, which bounds the groups.
    """
    rows = guides.select("gid", "video_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"\s+$", "")).filter(
        ~X.strip(F.col("line")).rlike(r"^#{1,3}\s*学习导读\s*$")
    )
    rows = rows.withColumn("times", guide_times(F.col("line")))
    before = Window.partitionBy("gid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.coalesce(F.count("times").over(before), F.lit(0)))
    said = rows.filter("times IS NOT NULL").select("gid", "video_id", "block", F.posexplode("times").alias("tpos", "label"))
    part = F.split("label", ":")
    hour, minute = F.get(part, F.lit(0)).cast("long"), F.get(part, F.lit(1)).cast("long")
    said = said.withColumn("at", (hour * 60 + minute) * 1000).withColumn("label", F.format_string("%02d:%02d", hour, minute))
    good = intervals.tolerance_semi(said, anchors, ["video_id"], at="at", anchor="start_ms", tolerance=tolerance)
    distinct = good.groupBy("gid", "block", "label").agg(F.min("tpos").alias("tpos"))
    valid = context.joined(distinct, ["gid", "block"], ["tpos"], "label", "、", "valid")
    body = context.joined(rows.filter("times IS NULL"), ["gid", "block"], ["pos"], "line", "\n", "body")
    closed = rows.filter("times IS NOT NULL").select("gid", "block")
    blocks = closed.join(valid, ["gid", "block"], "left").join(body, ["gid", "block"], "left")
    blocks = blocks.withColumn(
        "text", F.when(F.col("valid").isNotNull(), X.strip(F.concat_ws("\n", "body", F.concat(F.lit("> 时间 "), "valid"))))
    )
    item = F.when(F.col("text").isNotNull(), F.struct("block", "text"))
    checked = blocks.groupBy("gid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n\n").alias("text"),
        F.count("valid").alias("kept"),
        F.count_if(F.col("valid").isNull()).alias("dropped"),
    )
    none = F.lit(0).cast("long")
    return guides.select("gid").distinct().join(checked, "gid", "left").select(
        "gid", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kept", none).alias("kept"), F.coalesce("dropped", none).alias("dropped")
    )


def guide_terms(text: Column) -> Column:
    """Back-quoted terms and English words of four or more characters, first mention first."""
    quoted = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(C.RE_BACKTICK), F.lit(1)), X.strip),
        lambda w: (w != "") & ~w.startswith(">"),
    )
    words = F.filter(F.regexp_extract_all(text, F.lit(C.RE_TERM_WORD), F.lit(0)), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.concat(quoted, words))


def unverified_terms(guides: DataFrame, chunks: DataFrame) -> DataFrame:
    """Terms of a guide that occur nowhere in its course, case ignored: gid, video_id, term.

    A term made of word characters can only occur inside a word, so it is looked for in the
    distinct words of the course. Terms with other characters are looked for in the texts.
    ``guides``: gid, video_id, text; ``chunks``: video_id, text.
    """
    terms = unfold(guides, ["gid", "video_id"], guide_terms(F.col("text")), "term").withColumn("_low", F.lower("term"))
    open_terms = terms.select("video_id", "_low").distinct()
    plain = F.col("_low").rlike(r"^[a-z0-9_.$\[\]]{4,}$")
    split = F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9_.$\[\]]+"))
    # written once: the search measures the words before it deals them out, and would split all texts twice
    words = written(unfold(chunks, ["video_id"], split, "word").filter(F.length("word") >= 4).distinct(), "words")
    found = lambda texts, body, terms: patterns.matches(texts, terms, body=body, string="_low", keep=["video_id"]).select("video_id", "_low")
    in_words = found(words, "word", open_terms.filter(plain))
    in_texts = found(chunks.select("video_id", F.lower("text").alias("_body")), "_body", open_terms.filter(~plain))
    absent = open_terms.join(in_words.unionByName(in_texts).distinct(), ["video_id", "_low"], "left_anti")
    return terms.join(absent, ["video_id", "_low"], "left_semi").drop("_low")


# ------------------------------------------------------------------ terms


def merge_concepts(concepts: DataFrame) -> DataFrame:
    """First mention of every term of a course: chunk concepts by chunk, then course concepts.

    Columns: video_id, source (0 chunk, 1 course), idx, pos (row numbers from 0 on, below 10^18), term, definition, start_ms; rows of one
    (video_id, source, idx, pos) agree in definition and start_ms. A term's first place is found without its definition, as a number
    that a hash aggregate can keep; only then is the definition of that place fetched, each once and not once per term."""
    place = ["video_id", "source", "idx", "pos"]
    high, low = (F.lit(f"1{'0' * n}").cast("decimal(37,0)") for n in (36, 18))
    digits = lambda c: F.col(c).cast("decimal(18,0)")
    at = (digits("source").cast("decimal(1,0)") * high + digits("idx") * low.cast("decimal(19,0)") + digits("pos")).cast("decimal(38,0)")
    first = concepts.groupBy("video_id", "term").agg(F.min(at).alias("_at"))
    said = concepts.select(at.alias("_at"), F.col("video_id").alias("_v"), *place[1:], "definition", "start_ms").distinct()
    mine = first["video_id"].eqNullSafe(said["_v"]) & (first["_at"] == said["_at"])
    return first.join(said, mine).select("video_id", "term", "definition", "start_ms", F.struct(*place[1:]).alias("first"))


def concept_lines(merged: DataFrame) -> DataFrame:
    """Lines of a course's term file, ordered by ``first``; they stay rows."""
    return merged.select(
        "video_id", "term", "first",
        F.concat(F.lit("- **"), "term", F.lit("**（"), clock.clock_label(F.coalesce("start_ms", F.lit(0))), F.lit("）："), "definition").alias("line"),
    )


def write_concepts(merged: DataFrame, folder: str) -> None:
    (
        concept_lines(merged).repartitionByRange("video_id", "first").sortWithinPartitions("video_id", "first")
        .select("video_id", F.col("line").alias("value")).write.partitionBy("video_id").mode("overwrite").text(folder)
    )


def term_table(chunks: DataFrame, rows: int = 60, chars: int = 200) -> DataFrame:
    """Terms found as 'term：definition' lines in summaries; first mention wins, ``rows`` terms."""
    lines = chunks.select("video_id", "idx", F.posexplode(X.lines(F.coalesce("summary", F.lit("")))).alias("pos", "line"))
    line = X.strip(F.col("line"))
    at = F.position(F.lit("："), line)
    term = F.btrim(F.substring(line, F.lit(1), at - 1), F.lit(" -•*"))
    definition = X.strip(F.substring(line, at + 1, F.length(line)))
    found = lines.filter(at > 0).select("video_id", "idx", "pos", term.alias("term"), definition.alias("definition"))
    found = found.filter(F.length("term").between(2, 20) & (F.col("definition") != ""))
    order = F.struct("idx", "pos")
    first = found.groupBy("video_id", "term").agg(F.min(order).alias("_at"), F.min_by("definition", order).alias("definition"))
    return retrieval.top(first, ["video_id"], [F.col("_at")], rows, "rank").drop("_at").withColumn(
        "definition", F.substring("definition", 1, chars)
    )


# ------------------------------------------------------------------ roll-ups


def chapter_bodies(chunks: DataFrame) -> DataFrame:
    """Points of a chapter's chunks, the input of its summary. A chapter lasts minutes."""
    label = clock.clock_label(F.col("start_ms"))
    title = F.coalesce(F.nullif("title", F.lit("")), label)
    gist = F.coalesce(F.nullif("summary", F.lit("")), X.truncate(F.col("text"), 200))
    rows = chunks.withColumn("_line", F.concat(F.lit("- ["), label, F.lit("] "), title, F.lit("："), gist))
    return context.joined(rows, ["video_id", "parent_id"], ["idx"], "_line", "\n", "body")


def course_bodies(courses: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapter summaries of a course, the input of its own summary, as ordered rows (video_id,
    idx, line); idx -1 is the heading. Rows, because a course may have any number of chapters."""
    head = F.concat(
        F.lit("\n## "), X.chapter_title(F.col("title"), F.col("idx")), F.lit(" ["), clock.clock_label(F.col("start_ms")),
        F.lit("-"), clock.clock_label(F.col("end_ms")), F.lit("]\n"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("（无摘要）")),
    )
    first = F.concat(F.lit("课程原名："), "title", F.lit("\n总时长："), clock.clock_label(F.col("duration_ms")))
    return courses.select("video_id", F.lit(-1).cast("long").alias("idx"), first.alias("line")).unionByName(
        chapters.select("video_id", F.col("idx").cast("long").alias("idx"), head.alias("line"))
    )


def document_rows(
    courses: DataFrame, chapters: DataFrame, notes: DataFrame, terms: DataFrame, guides: DataFrame | None = None
) -> DataFrame:
    """The notes document as ordered rows (video_id, part, idx, text): heading (part 0), reading guide, outline table,
    one section per chapter with notes, term table. ``notes``: chapter_id, note. ``guides``: video_id, text, kept, one
    checked guide per course (``verify_guides``); a course without chapters or whose guide kept no paragraph has none."""
    return around_sections(courses, chapters, terms, guides).unionByName(sections(chapters, notes))


def around_sections(courses: DataFrame, chapters: DataFrame, terms: DataFrame, guides: DataFrame | None = None) -> DataFrame:
    """``document_rows`` without the sections."""
    counts = chapters.groupBy("video_id").agg(F.count("*").alias("_n"))
    head = courses.join(counts, "video_id", "left").select(
        "video_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("idx"),
        F.concat(
            F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("课程学习笔记")), F.lit("\n\n> 总时长 "),
            clock.clock_label(F.col("duration_ms")), F.lit("　·　"), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" 章"),
        ).alias("text"),
    )
    title = X.chapter_title(F.col("title"), F.col("idx"))
    brief = F.get(X.lines(X.strip(F.coalesce("summary", F.lit("")))), F.lit(0))
    outline = chapters.select(
        "video_id", F.lit(1).alias("part"), F.col("idx").cast("long").alias("idx"),
        F.concat(F.lit("| "), title, F.lit(" | "), clock.clock_label(F.col("start_ms")), F.lit(" | "), brief, F.lit(" |")).alias("text"),
    )
    table = terms.select(
        "video_id", F.lit(3).alias("part"), F.col("rank").cast("long").alias("idx"),
        F.concat(F.lit("| "), "term", F.lit(" | "), "definition", F.lit(" |")).alias("text"),
    )
    rows = head.unionByName(outline).unionByName(table)
    if guides is None:
        return rows
    said = guides.filter("kept > 0").join(chapters.select("video_id").distinct(), "video_id", "left_semi")
    return rows.unionByName(said.select(
        "video_id", F.lit(0).alias("part"), F.lit(1).cast("long").alias("idx"), F.concat(F.lit("\n## 学习导读\n\n"), "text").alias("text")
    ))


def _section_head() -> tuple[Column, Column]:
    """Title of a chapter, heading of its section."""
    title = X.chapter_title(F.col("title"), F.col("idx"))
    return title, F.concat(
        F.lit("\n---\n\n## "), (F.col("idx") + 1).cast("string"), F.lit(". "), title, F.lit("\n\n`"),
        clock.clock_label(F.col("start_ms")), F.lit(" - "), clock.clock_label(F.col("end_ms")), F.lit("`\n\n"),
    )


def sections(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of ``document_rows`` per chapter with notes."""
    title, head = _section_head()
    return chapters.join(notes, "chapter_id").select(
        "video_id", F.lit(2).alias("part"), F.col("idx").cast("long").alias("idx"),
        F.concat(head, X.strip(X.without_heading(F.col("note"), title))).alias("text"),
    )


def section_texts(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """The texts of ``sections`` for ``with_findings`` (video_id, part, idx, piece, text, times): headings (piece 0) and, each once, the
    notes (piece 1), at the first chapter they stand under. Chapters that share a chapter_id share its one note."""
    title, head = _section_head()
    part, times = F.lit(2).alias("part"), F.lit(1).cast("long").alias("times")
    # which notes lose their first line under which chapter is known from that line
    met = chapters.join(notes.select("chapter_id", X.first_heading(F.col("note")).alias("_first")), "chapter_id")
    at = F.col("idx").cast("long")
    heads = met.select("video_id", part, at.alias("idx"), F.lit(0).alias("piece"), head.alias("text"), times)
    cut = F.coalesce(F.contains("_first", title), F.lit(False))
    uses = met.groupBy("video_id", "chapter_id", cut.alias("_cut")).agg(F.count("*").alias("times"), F.min(at).alias("idx"))
    note = F.when(F.col("_cut"), X.without_heading(F.col("note"), F.lit(""))).otherwise(F.col("note"))
    return heads.unionByName(uses.join(notes, "chapter_id").select("video_id", part, "idx", F.lit(1).alias("piece"), note.alias("text"), "times"))


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("part int, idx long, text string, video_id string").parquet(folder)


def _put(rows: DataFrame, folder: str) -> None:
    by = ["video_id", "part", "idx"]
    (
        rows.select(*by, "text").repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("video_id")
        .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)
    )


def write_documents(document: DataFrame, folder: str, degraded: DataFrame | None = None, force: bool = False) -> None:
    """Stores ``document_rows`` below ``folder``/now, a partition per course; other courses there stay untouched.

    A course in ``degraded`` (video_id, degraded), most of whose chapters failed, does not replace a document that is already there,
    unless ``force``; where there is none it is written. What gets replaced is copied to ``folder``/previous first.
    """
    spark = document.sparkSession
    old = _stored(spark, f"{folder}/now")
    if old is not None:
        held = old.select("video_id").distinct()
        if degraded is not None and not force:
            document = document.join(degraded.filter("degraded").join(held, "video_id", "left_semi"), "video_id", "left_anti")
        document = written(document, "documents")
        _put(old.join(document.select("video_id").distinct(), "video_id", "left_semi"), f"{folder}/previous")
    _put(document, f"{folder}/now")


def read_documents(spark: SparkSession, folder: str, version: str = "now") -> DataFrame:
    """video_id, part, idx, text of the stored documents; ``version``: now or previous."""
    rows = _stored(spark, f"{folder}/{version}")
    return spark.createDataFrame([], "video_id string, part int, idx long, text string") if rows is None else rows.select("video_id", "part", "idx", "text")


def with_findings(document: DataFrame, suspects: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``document_rows`` and, as part 4, a table of the terms in it that a person should confirm, which stay unchanged in the text.

    ``texts`` (video_id, part, idx, piece, text, times): what is looked through in place of the rows, when many of them hold the same
    (``section_texts``); no term spans two of them.

    Rows are ordered by kind, then term; a course without findings has no such part. The rows of a course are numbered over
    blocks, so no document is gathered.
    """
    if texts is None:
        found = glossary.flag(document, "video_id", "text", suspects, at=["part", "idx"])
    else:
        found = glossary.flag(texts, "video_id", "text", suspects, at=["part", "idx", "piece"], times="times")
    kinds = list(C.FINDING_LABELS)
    nth = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    label, hint = (F.element_at(F.array(*[F.lit(C.FINDING_LABELS[k][i]) for k in kinds]), F.col("_k").cast("int")) for i in (0, 1))
    order = ["_k", "term"]
    blocked = ordered.blocks(found.select("video_id", nth.alias("_k"), "term", "n"), ["video_id"], order)
    numbered = ordered.prefix(blocked, ["video_id"], order, {"idx": ("count", F.lit(1))}, inclusive=True)
    line = F.concat(
        F.lit("| `"), F.replace("term", F.lit("|"), F.lit("\\|")), F.lit("` | "), label, F.lit(" | "), hint, F.lit(" | "),
        F.col("n").cast("string"), F.lit(" |"),
    )
    head = F.lit(
        "\n## 待人工确认的术语\n\n> 以下术语**未做自动替换**：它们可能是转写听错，也可能本来就是对的。\n\n| 术语 | 类型 | 说明 | 出现次数 |\n|---|---|---|---|"
    )
    part = F.lit(4).alias("part")
    heads = found.select("video_id").distinct().select("video_id", part, F.lit(0).cast("long").alias("idx"), head.alias("text"))
    return document.unionByName(heads).unionByName(numbered.select("video_id", part, F.col("idx").cast("long").alias("idx"), line.alias("text")))
