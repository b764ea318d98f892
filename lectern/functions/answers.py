"""Expressions over answers: normal form, key points, cited times, intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions.lists import let


def normalise(text: Column) -> Column:
    """Lower case; only digits, ASCII letters, Han and ^ + = stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), C.RE_ANSWER_REMOVED, "")


def without_extension(text: Column) -> Column:
    """Drop quoted blocks that open as '拓展' (off-course additions)."""
    return F.regexp_replace(
        F.regexp_replace(F.coalesce(text, F.lit("")), C.RE_EXTENSION_BLOCK, ""), r"\n\z", ""
    )


def ready_keypoints(keypoints: Column) -> Column:
    """ARRAY<STRUCT<name, forms>>: key points are lists of spellings; blank spellings and then
    empty points do not count. Worked out per question, before questions meet their answers."""
    kept = F.transform(keypoints, lambda alts: F.filter(alts, lambda a: F.trim(a) != ""))
    return F.transform(
        F.filter(kept, lambda alts: F.size(alts) > 0),
        lambda alts: F.struct(F.element_at(alts, 1).alias("name"), F.transform(alts, normalise).alias("forms")),
    )


def missing_keypoints(norm_answer: Column, ready: Column) -> Column:
    """Names of the key points none of whose forms occurs in the normalised answer."""
    # bound outside the inner lambdas, or the answer would be normalised once per form
    missed = let(
        norm_answer,
        lambda norm: F.filter(ready, lambda k: ~F.exists(k["forms"], lambda f: F.contains(norm, f))),
    )
    return F.transform(missed, lambda k: k["name"])


def citation_status(expect_ms: Column, starts: Column, tolerance_ms: Column) -> Column:
    near = F.exists(starts, lambda s: F.abs(s - expect_ms) <= tolerance_ms)
    return (
        F.when(expect_ms.isNull(), "n/a")
        .when(F.coalesce(F.size(starts), F.lit(0)) <= 0, "missing")
        .when(near, "ok")
        .otherwise("wrong")
    )


def citation_score(status: Column) -> Column:
    return F.when(status == "missing", 0.5).when(status == "wrong", 0.0).otherwise(1.0)


def question_score(rate: Column, status: Column) -> Column:
    return F.when(status == "n/a", rate).otherwise(0.7 * rate + 0.3 * citation_score(status))


def cited_labels(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.RE_ANSWER_TIME), F.lit(1))


def intent(question: Column) -> Column:
    low = F.lower(question)

    def has(words: tuple[str, ...]) -> Column:
        return low.rlike("|".join(words))

    return F.when(has(C.VISUAL_HINTS), "visual").when(has(C.GLOBAL_HINTS), "global").otherwise("local")
