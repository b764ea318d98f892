"""Model replies: JSON out of free text, structured fields, usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

SUMMARY = (
    "struct<title:string,summary:string,key_points:array<string>,"
    "concepts:array<struct<term:string,definition:string>>,"
    "outline:array<struct<chapter:string,points:array<string>>>>"
)


def salvage_json(text: Column) -> Column:
    """The JSON of a reply as text: a fenced block, or the whole, or the widest {...}, or the
    widest [...]; NULL when nothing parses."""
    body = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(F.contains(body, F.lit("```")) & (fenced != ""), strip(fenced)).otherwise(body)
    candidates = [
        inner,
        F.regexp_extract(inner, r"(?s)(\{.*\})", 1),
        F.regexp_extract(inner, r"(?s)(\[.*\])", 1),
    ]
    return F.coalesce(*[F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in candidates])


def as_object(json: Column) -> Column:
    """An object stays; of a list the first object is taken; anything else is NULL."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    first = F.get(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(0))
    return F.when(F.ltrim(json).startswith("{"), json).otherwise(F.to_json(first))


def _filled(items: Column) -> Column:
    return F.filter(
        F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda p: F.coalesce(p, F.lit("")) != ""
    )


def summary_fields(json: Column) -> Column:
    """Chunk summary reply: title (40 characters), summary, concepts with term and definition."""
    r = F.from_json(json, SUMMARY)
    none = F.array().cast("array<struct<term:string,definition:string>>")
    concepts = F.filter(
        F.transform(
            F.coalesce(r["concepts"], none),
            lambda c: F.struct(strip(F.coalesce(c["term"], F.lit(""))).alias("term"), strip(F.coalesce(c["definition"], F.lit(""))).alias("definition")),
        ),
        lambda c: (c["term"] != "") & (c["definition"] != ""),
    )
    return F.struct(
        F.substring(strip(F.coalesce(r["title"], F.lit(""))), 1, 40).alias("title"),
        strip(F.coalesce(r["summary"], F.lit(""))).alias("summary"),
        concepts.alias("concepts"),
    )


def chapter_summary(json: Column) -> Column:
    """Chapter reply: the summary with its key points as a list."""
    r = F.from_json(json, SUMMARY)
    points = _filled(r["key_points"])
    listed = F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.concat(
        strip(F.coalesce(r["summary"], F.lit(""))),
        F.when(F.size(points) > 0, F.concat(F.lit("\n\n要点：\n"), listed)).otherwise(""),
    )


def course_summary(json: Column) -> Column:
    """Course reply: the summary with its outline as a list."""
    r = F.from_json(json, SUMMARY)
    none = F.array().cast("array<struct<chapter:string,points:array<string>>>")

    def line(o: Column) -> Column:
        points = F.array_join(_filled(o["points"]), "；")
        return F.concat(F.lit("- "), strip(o["chapter"]), F.when(points != "", F.concat(F.lit("："), points)).otherwise(""))

    kept = F.filter(F.coalesce(r["outline"], none), lambda o: strip(F.coalesce(o["chapter"], F.lit(""))) != "")
    outline = F.array_join(F.transform(kept, line), "\n")
    return F.concat(
        strip(F.coalesce(r["summary"], F.lit(""))),
        F.when(outline != "", F.concat(F.lit("\n\n大纲：\n"), outline)).otherwise(""),
    )


def usage_fields(usage_json: Column) -> Column:
    """STRUCT<prompt, completion, cached, total>; services name the cached tokens differently."""

    def number(path: str) -> Column:
        return F.coalesce(F.get_json_object(usage_json, path).try_cast("long"), F.lit(0))

    named = F.coalesce(
        F.get_json_object(usage_json, "$.prompt_cache_hit_tokens").try_cast("long"),
        F.get_json_object(usage_json, "$.cached_tokens").try_cast("long"),
        F.lit(0),
    )
    cached = F.when(named != 0, named).otherwise(number("$.prompt_tokens_details.cached_tokens"))
    return F.struct(
        number("$.prompt_tokens").alias("prompt"), number("$.completion_tokens").alias("completion"),
        cached.alias("cached"), number("$.total_tokens").alias("total"),
    )


def truncated(finish_reason: Column) -> Column:
    return F.coalesce(finish_reason, F.lit("")) == "length"


def failure_note(chunks: Column, chapters: Column, course: Column) -> Column:
    """What part of a summary run failed, '' if none did."""
    parts = F.concat_ws(
        "、",
        F.when(chunks > 0, F.concat(chunks.cast("string"), F.lit(" 个片段"))),
        F.when(chapters > 0, F.concat(chapters.cast("string"), F.lit(" 个章节"))),
        F.when(course, F.lit("全课摘要")),
    )
    return F.when(parts == "", "").otherwise(
        F.concat(F.lit("摘要生成部分失败（"), parts, F.lit("），转写与检索不受影响。可重跑入库补齐。"))
    )


def degraded(n_chapters: Column, n_sections: Column, n_failed: Column) -> Column:
    """Too many chapters failed: the written notes would be worse than the old ones."""
    limit = F.greatest(F.lit(3), F.floor(n_sections / 2) + 1)
    return (n_chapters > 0) & ((n_sections == 0) | (n_failed >= limit))
