"""Documents -> sections -> paragraphs -> chunks, all inside one row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions.lists import let
from lectern.functions.text import strip

# a heading is one line: marks alone have no text, whatever the next line says
_MARKS = r"#{1,3}[^\S\n]+\S"
_HEADING_START = rf"(?md)^(?={_MARKS})"
_HEADING = r"^#{1,3}[^\S\n]+(\S[^\n]*)"


def clean(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))


def guess_title(text: Column) -> Column:
    """The first filled line: a heading's text, or else its first 80 characters."""
    first = strip(F.get(F.split(strip(text), r"\R"), F.lit(0)))
    heading = strip(F.regexp_extract(first, _HEADING, 1))
    plain = F.substring(strip(F.regexp_replace(first, "^#+", "")), 1, 80)
    return F.when(heading != "", heading).otherwise(plain)


def sections(text: Column, fallback_title: Column) -> Column:
    """ARRAY<STRUCT<title, body>>: one entry per heading of level 1-3, text before the first
    heading as preface, the whole text under ``fallback_title`` if there is no heading."""
    parts = F.split(text, _HEADING_START)

    def section(part: Column, i: Column) -> Column:
        headed = part.rlike(_HEADING)
        title = strip(F.regexp_extract(part, _HEADING, 1))
        body = F.when(headed, strip(F.regexp_replace(part, _HEADING, ""))).otherwise(strip(part))
        return F.struct(F.when(headed, title).otherwise(F.lit(C.PREFACE_TITLE)).alias("title"), body.alias("body"), headed.alias("headed"))

    found = F.filter(F.transform(parts, section), lambda s: s["headed"] | (s["body"] != ""))
    whole = F.array(F.struct(fallback_title.alias("title"), strip(text).alias("body")))

    def chosen(all_: Column) -> Column:
        listed = F.transform(all_, lambda s: F.struct(s["title"].alias("title"), s["body"].alias("body")))
        return F.when(F.exists(all_, lambda s: s["headed"]), listed).otherwise(whole)

    return let(found, chosen)


def paragraphs(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, r"\n\s*\n"), strip), lambda p: p != "")


def pack(
    paras: Column,
    target: int = C.PARAGRAPH_TARGET_CHARS,
    most: int = C.PARAGRAPH_MAX_CHARS,
) -> Column:
    """Greedy packing of paragraphs into chunk texts.

    A paragraph that would push the buffer over ``most`` closes it and opens the next one, without
    the test for ``target``; otherwise it joins the buffer, which closes on reaching ``target``.
    """
    start = F.struct(
        F.lit("").alias("buf"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("done")
    )

    def step(s: Column, p: Column) -> Column:
        n = F.length(p)
        grown = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit("\n\n"), p))
        overflow = (s["size"] > 0) & (s["size"] + n > most)
        full = ~overflow & (s["size"] + n >= target)
        return F.struct(
            F.when(overflow, p).when(full, "").otherwise(grown).alias("buf"),
            F.when(overflow, n).when(full, 0).otherwise(s["size"] + n).alias("size"),
            F.when(overflow, F.concat(s["done"], F.array(s["buf"])))
            .when(full, F.concat(s["done"], F.array(grown)))
            .otherwise(s["done"])
            .alias("done"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["buf"] != "", F.concat(s["done"], F.array(s["buf"]))).otherwise(s["done"])

    return F.aggregate(paras, start, step, finish)


def timeline(chunks: Column) -> Column:
    """Chunk structs (sec, title, text) -> the same with start_ms / end_ms on a reading-speed axis."""
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<idx:int,sec:int,title:string,text:string,start_ms:bigint,end_ms:bigint>>").alias("done"),
    )

    def step(s: Column, c: Column) -> Column:
        until = s["at"] + F.greatest(F.lit(C.MIN_SPAN_MS), F.length(c["text"]) * C.MS_PER_CHAR)
        timed = F.struct(
            F.size(s["done"]).alias("idx"), c["sec"].alias("sec"), c["title"].alias("title"), c["text"].alias("text"),
            s["at"].alias("start_ms"), until.cast("long").alias("end_ms"),
        )
        return F.struct(until.cast("long").alias("at"), F.concat(s["done"], F.array(timed)).alias("done"))

    return F.aggregate(chunks, start, step, lambda s: s["done"])
