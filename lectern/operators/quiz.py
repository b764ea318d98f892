"""Quizzes: material, validation of generated questions, publishing, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text as X
from lectern.operators import context, retrieval

LETTERS = ("A", "B", "C", "D")
QUESTION = (
    "struct<id:string,stem:string,options:map<string,string>,answer:string,explanation:string,start_ms:string>"
)


def material(chapters: DataFrame, chunks: DataFrame, budget: int = C.QUIZ_MATERIAL_CHARS) -> DataFrame:
    """Chapter blocks for question writing, in order until the budget is reached: the summary, or
    else points from the first four chunks."""
    first = retrieval.top(chunks, ["parent_id"], [F.col("idx")], 4)
    tip = X.strip(F.coalesce(F.nullif("summary", F.lit("")), F.nullif("title", F.lit("")), F.col("text")))
    point = F.concat(F.lit("- ["), clock.clock_label(F.col("start_ms")), F.lit("] "), F.substring(tip, 1, 220))
    points = context.joined(
        first.withColumn("_tip", tip).filter("_tip <> ''").withColumn("_line", point), ["parent_id"], ["idx"], "_line", "\n", "_points"
    ).withColumnRenamed("parent_id", "chapter_id")
    summary = X.strip(F.coalesce("summary", F.lit("")))
    block = F.concat(
        F.lit("\n## "), X.strip(X.chapter_title(F.col("title"), F.col("idx"))), F.lit(" ["), clock.clock_label(F.col("start_ms")),
        F.lit("-"), clock.clock_label(F.col("end_ms")), F.lit("]\n"),
        F.when(summary != "", F.concat(F.substring(summary, 1, 800), F.lit("\n")))
        .otherwise(F.coalesce(F.concat("_points", F.lit("\n")), F.lit(""))),
    )
    blocks = chapters.join(points, "chapter_id", "left").select("video_id", "idx", block.alias("block"))
    return context.prefix_take(blocks, "video_id", "idx", F.length("block"), budget)


def material_text(courses: DataFrame, chapters: DataFrame, chunks: DataFrame, budget: int = C.QUIZ_MATERIAL_CHARS) -> DataFrame:
    """One text per course: title, length, summary, then the chapter blocks. NULL where there is too little to ask about.

    ``courses``: video_id, title, duration_ms, video_summary."""
    blocks = context.joined(material(chapters, chunks, budget), ["video_id"], ["idx"], "block", "\n", "_blocks")
    summary = X.strip(F.coalesce("video_summary", F.lit("")))
    text = X.strip(F.concat_ws(
        "\n",
        F.concat(F.lit("课程："), F.coalesce("title", F.lit(""))), F.concat(F.lit("总时长："), clock.clock_label(F.col("duration_ms"))),
        F.when(summary != "", F.concat(F.lit("\n## 全课摘要\n"), F.substring(summary, 1, C.QUIZ_SUMMARY_CHARS))), "_blocks",
    ))
    return courses.join(blocks, "video_id", "left").select(
        "video_id", F.when(F.length(text) >= C.QUIZ_MIN_CHARS, text).alias("material")
    )


def wanted_count(asked: Column) -> Column:
    return F.greatest(F.lit(C.QUIZ_MIN_COUNT), F.least(F.lit(C.QUIZ_MAX_COUNT), F.coalesce(asked, F.lit(C.QUIZ_DEFAULT_COUNT))))


def usable_questions(raw: Column, count: Column) -> Column:
    """Generated questions that can be asked: a stem, four filled options, an answer among them.
    The first ``count`` of them, renumbered q1, q2, ..."""

    def tidy(q: Column) -> Column:
        options = F.map_from_arrays(
            F.array(*[F.lit(k) for k in LETTERS]),
            F.array(*[X.strip(F.coalesce(q["options"][k], F.lit(""))) for k in LETTERS]),
        )
        return F.struct(
            X.strip(F.coalesce(q["stem"], F.lit(""))).alias("stem"),
            options.alias("options"),
            F.upper(X.strip(F.coalesce(q["answer"], F.lit("")))).alias("answer"),
            X.strip(F.coalesce(q["explanation"], F.lit(""))).alias("explanation"),
            F.greatest(F.lit(0), F.coalesce(F.expr("null").cast("long"), q["start_ms"].try_cast("long"), F.lit(0))).alias("start_ms"),
        )

    def good(q: Column) -> Column:
        return (q["stem"] != "") & F.forall(F.map_values(q["options"]), lambda o: o != "") & q["answer"].isin(*LETTERS)

    kept = F.slice(F.filter(F.transform(F.coalesce(raw, F.array().cast(f"array<{QUESTION}>")), tidy), good), F.lit(1), count)
    return F.transform(
        kept,
        lambda q, i: F.struct(
            F.concat(F.lit("q"), (i + 1).cast("string")).alias("id"), q["stem"].alias("stem"), q["options"].alias("options"),
            q["answer"].alias("answer"), q["explanation"].alias("explanation"), q["start_ms"].alias("start_ms"),
        ),
    )


def validate(generated: DataFrame) -> DataFrame:
    """``generated``: quiz_id, asked, raw ARRAY<QUESTION>. Adds questions and ok (enough of them)."""
    count = wanted_count(F.col("asked"))
    return (
        generated.withColumn("wanted", count)
        .withColumn("questions", usable_questions(F.col("raw"), F.col("wanted")))
        .withColumn("ok", F.size("questions") >= F.least("wanted", F.lit(C.QUIZ_MIN_COUNT)))
        .drop("raw")
    )


def public(questions: Column) -> Column:
    """Questions without answer and explanation."""
    return F.transform(
        questions,
        lambda q: F.struct(q["id"].alias("id"), q["stem"].alias("stem"), q["options"].alias("options"), F.coalesce(q["start_ms"], F.lit(0)).alias("start_ms")),
    )


def grade_details(quizzes: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question: a missing answer is a wrong one. ``answers``: quiz_id, id, choice."""
    q = quizzes.select("quiz_id", F.explode("questions").alias("q")).select("quiz_id", "q.id", "q.answer", "q.stem")
    given = answers.select("quiz_id", "id", F.upper(X.strip(F.coalesce("choice", F.lit("")))).alias("chosen"))
    return q.join(given, ["quiz_id", "id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(""))).withColumn(
        "correct", F.col("chosen") == F.col("answer")
    )


def grade(details: DataFrame) -> DataFrame:
    return details.groupBy("quiz_id").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct_n")
    ).withColumn("score", F.round(F.col("correct_n") / F.col("total") * 100.0, 1))
