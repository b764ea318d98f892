"""Text expressions: tokens, snippets, truncation, keys."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions.lists import let

BLANKS = " \t\n\r\x0b\x0c 　"
_HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"


def _accent_pairs() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is one base letter plus marks."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(p) for p in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_pairs()


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """The lines of a text; a final line break opens no further line."""
    return F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")


def fold(text: Column) -> Column:
    """Lower case without accents, the form in which words are indexed."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


_WORD = r"[\p{L}\p{N}]+"
# every Han character with its successor; the last of a longer run adds nothing; a lone one stays
_HAN_PAIRS = rf"({_HAN})(?=({_HAN}))|(?<={_HAN}){_HAN}|({_HAN})"
_MIXED_TOKEN = rf"{_HAN}(?={_HAN})|(?<!{_HAN}){_HAN}(?!{_HAN})|(?:(?!{_HAN})[\p{{L}}\p{{N}}])+"


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def tokens(text: Column) -> Column:
    """Words of a text; runs of Han characters become overlapping character pairs.

    Plain ASCII texts skip the accent and Han steps.
    """
    paired = F.when(text.rlike(_HAN), F.regexp_replace(text, _HAN_PAIRS, " $1$2$3 ")).otherwise(text)
    ready = F.when(_is_ascii(text), F.lower(text)).otherwise(fold(paired))
    words = F.array_remove(F.split(ready, r"[^\p{L}\p{N}]+"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def counted(words: Column) -> Column:
    """Distinct words of a list with their numbers, as array<struct<term, tf>>: runs of the sorted list, counted where it is."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(w, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(w)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


def listed(words: Column) -> Column:
    """``counted`` of a list without repeats: nothing is sorted or counted."""
    return F.transform(words, lambda x: F.struct(x.alias("term"), F.lit(1).cast("long").alias("tf")))


def token_count(text: Column) -> Column:
    """size(tokens(text)) without building the words."""
    plain, mixed = F.regexp_count(text, F.lit(_WORD)), F.regexp_count(text, F.lit(_MIXED_TOKEN))
    count = F.when(_is_ascii(text), plain).when(text.rlike(_HAN), mixed).otherwise(plain)
    return F.coalesce(count, F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct words of two or more characters, in order of first appearance."""
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= 2))


def fused_text(spoken: Column, slide_text: Column) -> Column:
    """Spoken text and slide text as one indexable text."""
    return F.when(
        F.coalesce(slide_text, F.lit("")) == "", spoken
    ).otherwise(F.concat(spoken, F.lit("\n" + C.SLIDE_MARK), slide_text))


def contains_folded(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def clip_around(needle: Column, text: Column, radius: int = 60) -> Column:
    """The first occurrence of ``needle`` with ``radius`` characters either side, '' if absent."""
    at = F.position(F.lower(needle), F.lower(text))
    first = F.greatest(F.lit(1), at - radius)
    last = F.least(F.length(text), at - 1 + F.length(needle) + radius)
    body = one_line(F.substring(text, first, last - first + 1))
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(
            F.when(first > 1, F.lit(C.ELLIPSIS)).otherwise(""),
            body,
            F.when(last < F.length(text), F.lit(C.ELLIPSIS)).otherwise(""),
        )
    )


def snippet(needle: Column, *fields: Column) -> Column:
    """The first field that holds the needle, clipped; else the start of the first filled field."""
    hits = [F.nullif(clip_around(needle, f), F.lit("")) for f in fields]
    starts = [F.when(strip(f) != "", F.substring(one_line(f), 1, 120)) for f in fields]
    return F.coalesce(*hits, *starts, F.lit(""))


def compact_lines(text: Column, limit: int | None = 400) -> Column:
    """Non-blank lines joined with ' / ', cut with an ellipsis beyond ``limit``."""
    joined = F.array_join(
        F.filter(F.transform(lines(text), strip), lambda x: x != ""), " / "
    )
    return joined if limit is None else truncate(joined, limit)


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, then an ellipsis on top."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(C.ELLIPSIS))
    )


def fit(text: Column, room: Column | int) -> Column:
    """At most ``room`` characters including the ellipsis that marks a cut."""
    room = room if isinstance(room, Column) else F.lit(room)
    return (
        F.when(room <= 0, F.lit(""))
        .when(F.length(text) <= room, text)
        .otherwise(F.concat(F.substring(text, F.lit(1), (room - 1).cast("int")), F.lit(C.ELLIPSIS)))
    )


def short_title(text: Column, limit: int = 28) -> Column:
    flat = one_line(strip(F.coalesce(text, F.lit(""))))
    return F.when(flat == "", F.lit(C.NEW_CHAT_TITLE)).otherwise(fit(flat, limit))


def skeleton(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def dedup_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s\x{3000}]+", ""))


def estimate_tokens(n_chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_chars / F.lit(1.6))).cast("long")


def chapter_title(title: Column, idx: Column) -> Column:
    return F.coalesce(
        F.nullif(title, F.lit("")), F.concat(F.lit("第 "), (idx + 1).cast("string"), F.lit(" 章"))
    )


def without_outline(summary: Column) -> Column:
    """Drop a closing '大纲：' list, only if every filled line after the mark is a list item."""
    rows = lines(summary)
    marks = F.filter(
        F.transform(rows, lambda row, i: F.when(row.rlike(C.RE_OUTLINE_MARK), i)),
        lambda i: i.isNotNull(),
    )

    def tail(i: Column) -> Column:
        return F.filter(F.slice(rows, i + 2, F.size(rows)), lambda r: strip(r) != "")

    closing = F.filter(
        marks,
        lambda i: (F.size(tail(i)) > 0)
        & F.forall(tail(i), lambda r: r.rlike(C.RE_OUTLINE_ITEM)),
    )
    cut = F.get(closing, F.lit(0))
    kept = F.rtrim(F.array_join(F.slice(rows, F.lit(1), cut), "\n"))
    return F.when(cut.isNull(), summary).otherwise(F.regexp_replace(kept, r"\s+\z", ""))


def first_heading(text: Column) -> Column:
    """The first filled line, NULL when it is no heading."""
    head = F.get(_first_line(text), F.lit(0))
    return F.when(head.rlike(r"^\s{0,3}#{1,6}\s"), head)


def _first_line(text: Column) -> Column:
    """The first filled line and all after it."""
    return F.split(F.ltrim(text, F.lit(BLANKS)), r"\R", 2)


def without_heading(text: Column, title: Column) -> Column:
    """Drop a first heading line that repeats the title, with the blank lines around it. What stays of a text stays as it is."""
    rest = F.coalesce(F.get(_first_line(text), F.lit(1)), F.lit(""))
    return F.when(F.contains(first_heading(text), title), F.regexp_replace(rest, r"^(?:\h*\R)+", "")).otherwise(text)
