"""Glossary: deterministic corrections, suspicious terms, evidence for open terms.

Rules are curated by hand, so the rules that apply to one course are a short list; it travels with
the rows of that course as an array and texts are corrected where they are, without a shuffle of
the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text as X
from lectern.functions.lists import let, unfold
from lectern.operators import patterns, retrieval
from lectern.operators.stored import Library
from lectern.session import written

RULE = "struct<wrong:array<string>,right:string,reason:string>"


# ------------------------------------------------------------------ rules


def clean_rules(rules: DataFrame) -> DataFrame:
    """Strip; drop rules without a right form or without any wrong form.

    Columns: video_id ('' = every course), wrong ARRAY<STRING>, right, reason, ord.
    """
    wrong = F.filter(F.transform("wrong", X.strip), lambda w: w != "")
    return (
        rules.withColumn("wrong", wrong).withColumn("right", X.strip(F.coalesce("right", F.lit(""))))
        .filter((F.col("right") != "") & (F.size("wrong") > 0))
    )


def _keyed(scope: int) -> Column:
    longest = F.array_max(F.transform("wrong", F.length))
    return F.struct(
        (-longest).alias("neg"), F.lit(scope).alias("scope"), F.col("ord").alias("ord"),
        F.struct("wrong", "right", F.coalesce("reason", F.lit("")).alias("reason")).alias("rule"),
    )


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rules``: global rules and those of the row's course, longest wrong form first, so
    that a short form never cuts up a longer one; equal lengths keep their order, global first."""
    kept = clean_rules(rules)
    common = kept.filter("video_id = ''").agg(F.array_sort(F.collect_list(_keyed(0))).alias("r")).scalar()
    own = kept.filter("video_id <> ''").groupBy("video_id").agg(F.collect_list(_keyed(1)).alias("_own"))
    ordered = F.transform(
        F.array_sort(F.concat("_common", F.coalesce("_own", F.slice("_common", F.lit(1), F.lit(0))))),
        lambda k: k["rule"],
    )
    return (
        rows.join(own, "video_id", "left").withColumn("_common", common)
        .withColumn("rules", ordered).drop("_own", "_common")
    )


def correct(text: Column, rules: Column) -> Column:
    """STRUCT<text, fixes ARRAY<STRUCT<wrong, right, n>>>: rules in order, variants in order."""

    def occurs(text: Column, r: Column) -> Column:
        return F.exists(r["wrong"], lambda w: F.contains(text, w))

    def variant(s: Column, wrong: Column, right: Column) -> Column:
        gone = F.length(s["text"]) - F.length(F.replace(s["text"], wrong, F.lit("")))
        replaced = F.struct(
            F.replace(s["text"], wrong, right).alias("text"),
            (s["n"] + F.floor(gone / F.length(wrong)).cast("int")).alias("n"),
        )
        return F.when(F.contains(s["text"], wrong), replaced).otherwise(s)

    def rule(s: Column, r: Column) -> Column:
        done = F.aggregate(
            r["wrong"],
            F.struct(s["text"].alias("text"), F.lit(0).alias("n")),
            lambda acc, w: variant(acc, w, r["right"]),
        )

        def booked(d: Column) -> Column:
            fix = F.struct(F.element_at(r["wrong"], 1).alias("wrong"), r["right"].alias("right"), d["n"].alias("n"))
            return F.struct(d["text"].alias("text"), F.concat(s["fixes"], F.array(fix)).alias("fixes"))

        return F.when(occurs(s["text"], r), let(done, booked)).otherwise(s)

    start = F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        F.array().cast("array<struct<wrong:string,right:string,n:int>>").alias("fixes"),
    )
    # texts that hold none of the wrong forms skip the fold
    touched = F.exists(rules, lambda r: occurs(text, r))
    return F.when(touched, F.aggregate(rules, start, rule)).otherwise(start)


def n_fixes(fixes: Column) -> Column:
    return F.aggregate(fixes, F.lit(0), lambda acc, f: acc + f["n"])


def repair(rows: DataFrame, rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Correct all ``fields``; adds ``fixes_<field>``. A second run over the result finds nothing
    as long as no right form contains a wrong one."""
    out = with_rules(rows, rules)
    # a generated column: conditions on it stay behind it, where on a plain one Spark would correct every text again to test them
    made = F.struct(*[correct(F.col(f), F.col("rules")).alias(f) for f in fields])
    out = out.select("*", F.explode_outer(F.array(made)).alias("_c"))
    return out.select(
        *[F.col(f"_c.{c}.text").alias(c) if c in fields else F.col(c) for c in rows.columns],
        *[F.col(f"_c.{f}.fixes").alias(f"fixes_{f}") for f in fields],
    )


def repair_report(repaired: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Replacements per course and field."""
    return repaired.groupBy("video_id").agg(*[F.sum(n_fixes(F.col(f"fixes_{f}"))).alias(f) for f in fields])


#: What of a course is corrected: table -> its text columns.
REPAIRED = {
    "segments": ("text",), "chunks": ("text", "title", "summary", "ocr_text"), "chapters": ("title", "summary"), "slides": ("ocr_text",),
    "courses": ("video_summary",),
}


def repair_library(tables: dict[str, DataFrame], rules: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Corrects every text of the courses: sentences, chunks, chapters, slides and course summaries.

    Gives the corrected tables and a report (video_id, part, n) of parts in which something was replaced; their
    chunks are the ones to embed and index anew.
    """
    fixed, report = {}, None
    for part, df in tables.items():
        fields = REPAIRED[part]
        done = repair(df, rules, fields)
        fixed[part] = done.select(*df.columns)
        n = F.lit(0)
        for f in fields:
            n = n + n_fixes(F.col(f"fixes_{f}"))
        rows = done.groupBy("video_id").agg(F.sum(n).alias("n")).filter("n > 0").select("video_id", F.lit(part).alias("part"), "n")
        report = rows if report is None else report.unionByName(rows)
    return fixed, report


def repair_stored(library: Library, rules: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes corrected chunks back to a stored library: video_id, n of courses in which something was replaced.

    Only chunks with a replacement are rewritten, and of those only chunks whose indexed text became another are indexed and embedded
    anew; all in one commit. A field without a replacement stays as it is, null too.
    """
    fields = REPAIRED["chunks"]
    fixes = [F.col(f"fixes_{f}") for f in fields]
    done = repair(library.chunks.all(), rules, fields).withColumn("_n", sum((n_fixes(f) for f in fixes), F.lit(0))).filter("_n > 0")
    changed = written(
        done.select("video_id", "chunk_id", "_n", *[F.when(F.size(x) > 0, F.col(f)).alias(f) for f, x in zip(fields, fixes)]), "repaired"
    )
    library.patch(changed.drop("_n"), embed)
    return changed.groupBy("video_id").agg(F.sum("_n").alias("n"))


def merge_fixes(repaired: DataFrame, fields: Sequence[str]) -> DataFrame:
    every = repaired.select(F.explode(F.concat(*[F.col(f"fixes_{f}") for f in fields])).alias("f"))
    return every.groupBy("f.wrong", "f.right").agg(F.sum("f.n").alias("n"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new rule for a wrong form of the same course replaces the old rule's right form and
    reason; otherwise it is added. Columns: video_id, wrong (one form), right, reason, ord.

    Blank or unchanged entries are refused by dropping them."""
    fresh = new.select(
        "video_id", X.strip(F.col("wrong")).alias("wrong"), X.strip(F.col("right")).alias("right"), "reason", "ord"
    ).filter("video_id <> '' AND wrong <> '' AND right <> '' AND wrong <> right")
    both = old.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
    return (
        both.groupBy("video_id", "wrong")
        .agg(F.max_by(F.struct("right", "reason"), F.struct("_v", "ord")).alias("x"), F.min("ord").alias("ord"))
        .select("video_id", "wrong", "x.right", "x.reason", "ord")
    )


# ------------------------------------------------------------------ suspicious terms


def _times(column: str | None) -> Column:
    return (F.col(column) if column else F.lit(1)).cast("long").alias("_times")


def identifiers(docs: DataFrame, key: str, body: str, at: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Identifiers with a separator, how often and how early they occur in a text. A text may be several rows, in order of ``at``;
    ``times`` is a column that says how often a row stands there."""
    found = F.regexp_extract_all(F.col(body), F.lit(C.RE_IDENTIFIER), F.lit(0))
    return (
        unfold(docs, [key, *at, _times(times)], found, "token", "pos")
        .groupBy(key, "token").agg(F.sum("_times").alias("n"), F.min(F.struct(*at, "pos") if at else "pos").alias("pos"))
    )


def spelling_variants(idents: DataFrame, key: str) -> DataFrame:
    """Pairs of identifiers of one text whose skeletons differ by one letter.

    Candidates share the skeleton or one of its forms with one character left out, so only near
    pairs ever meet; a form has at most (alphabet x length) skeletons, which bounds the groups.
    """
    skel = idents.withColumn("skel", X.skeleton(F.col("token")))
    n = F.length("skel")
    shorter = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.substring(F.col("skel"), F.lit(1), i - 1), F.substring(F.col("skel"), i + 1, n)),
    )
    words = skel.groupBy(key, "skel").agg(F.min("pos").alias("spos"))
    forms = words.select(key, "skel", "spos", F.explode(F.array_distinct(F.concat(F.array("skel"), shorter))).alias("form"))
    other = forms.select(F.col(key), F.col("skel").alias("skel2"), F.col("spos").alias("spos2"), "form")
    digits = [F.regexp_replace(c, "[^0-9]", "") for c in ("skel", "skel2")]
    pairs = (
        forms.join(other, [key, "form"])
        .filter((F.col("spos") < F.col("spos2")) & (F.levenshtein("skel", "skel2") == 1) & (digits[0] == digits[1]))
        .select(key, "skel", "skel2").distinct()
    )
    a = skel.select(key, "skel", F.col("token").alias("t1"), F.col("n").alias("n1"))
    b = skel.select(key, F.col("skel").alias("skel2"), F.col("token").alias("t2"), F.col("n").alias("n2"))
    return pairs.join(a, [key, "skel"]).join(b, [key, "skel2"]).select(
        key, F.concat_ws(" / ", "t1", "t2").alias("term"), (F.col("n1") + F.col("n2")).alias("n")
    )


def spaced_letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.RE_SPACED_LETTERS), F.lit(0))


def quoted_phrases(text: Column, trusted: Sequence[str] = C.TRUSTED_TERMS) -> Column:
    """Quoted English that reads like a phrase: has a blank and an all-lower-case word."""
    found = F.transform(F.regexp_extract_all(text, F.lit(C.RE_QUOTED), F.lit(1)), F.trim)
    known = F.array(*[F.lit(x.lower()) for x in trusted])

    def phrase(term: Column) -> Column:
        words = F.regexp_extract_all(term, F.lit("[A-Za-z]+"), F.lit(0))
        return (
            F.contains(term, F.lit(" "))
            & F.exists(words, lambda w: w == F.lower(w))
            & ~F.array_contains(known, F.lower(term))
        )

    return F.filter(found, phrase)


def flag(
    docs: DataFrame, key: str, body: str, suspects: DataFrame | None = None, at: Sequence[str] = (), times: str | None = None
) -> DataFrame:
    """Findings per text: term, kind, n. ``suspects``: table of listed terms (term), of any number. A text
    may be several rows, in order of ``at``; no term spans two rows. ``times`` is a column that says how often a row stands there.

    The in-text signals are computed where the text is; only findings are shuffled. Listed terms are all looked for in one pass over a text.
    """
    text, docs = F.col(body), docs.select(key, *at, body, _times(times))

    def tagged(terms: Column, kind: str) -> Column:
        return F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(kind).alias("kind")))

    local = F.concat(
        tagged(spaced_letters(text), "spaced_letters"),
        tagged(quoted_phrases(text), "quoted_phrase"),
    )
    found = unfold(docs, [key, "_times"], local, "f").select(key, "f.*", F.col("_times").alias("n"))
    variants = spelling_variants(identifiers(docs, key, body, at, "_times"), key).withColumn("kind", F.lit("inconsistent"))
    found = found.unionByName(variants.select(key, "term", "kind", "n"))
    if suspects is not None:
        listed = patterns.matches(docs, suspects, body=body, scope=None, keep=[key, "_times"])
        found = found.unionByName(listed.select(key, "term", F.lit("listed").alias("kind"), (F.size("at") * F.col("_times")).alias("n")))
    return merge_findings(found, key)


def merge_findings(found: DataFrame, key: str) -> DataFrame:
    """Sum by (term, kind); a listed term that is part of another finding of the text is dropped."""
    # written once: the texts would be read again for every use below
    merged = written(found.groupBy(key, "term", "kind").agg(F.sum("n").alias("n")), "findings")
    other = merged.filter("kind <> 'listed'").select(key, F.col("term").alias("_other"))
    listed = merged.filter("kind = 'listed'")
    kept = listed.join(
        other, (listed[key] == other[key]) & F.contains(other["_other"], listed["term"]), "left_anti"
    )
    return merged.filter("kind <> 'listed'").unionByName(kept)


# ------------------------------------------------------------------ evidence


def contexts(sources: DataFrame, terms: DataFrame, window: int = C.TERM_WINDOW_CHARS) -> DataFrame:
    """Every occurrence of a course's open terms with its surroundings.

    ``sources``: video_id, priority, grp, source_no, idx, label, ms (NULL = none), text, trusted. Sources of one
    ``grp`` are read side by side, index by index (a chunk's summary, then its text); ``terms``: video_id, term.
    """
    # the surroundings are cut out where the text is: rows carry those, not the text
    keep = [c for c in sources.columns if c != "text"]
    found = patterns.matches(sources, terms, keep=keep, window=window)
    snippets = F.transform("near", X.one_line)
    hit = unfold(found, [*keep, "term"], snippets, "snippet", "occ")
    stamp = F.when(F.col("ms").isNull(), "").otherwise(
        F.concat(F.lit("["), clock.clock_label(F.col("ms")), F.lit("] "))
    )
    return hit.withColumn("line", F.concat("label", F.lit(" "), stamp, F.lit("…"), "snippet", F.lit("…")))


def best_contexts(found: DataFrame, limit: int = C.TERM_CONTEXT_LIMIT) -> DataFrame:
    """First ``limit`` different surroundings per term, the most reliable sources first."""
    order = F.struct("priority", "grp", "idx", "source_no", "occ")
    once = (
        found.withColumn("_key", X.dedup_key(F.col("snippet")))
        .groupBy("video_id", "term", "_key")
        .agg(F.min(order).alias("_o"), F.min_by("line", order).alias("line"))
    )
    return retrieval.top(once, ["video_id", "term"], [F.col("_o")], limit, "rank").drop("_o", "_key")


def gate_verdicts(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """Check quoted evidence against first-hand material and say which verdicts may be applied.

    ``verdicts``: video_id, term, correct, confidence, evidence, action. Evidence must occur in a
    trusted surrounding of the term (letters and digits only); summaries do not count.
    """
    skel = X.skeleton(F.coalesce("evidence", F.lit("")))
    trusted = found.filter("trusted").select("video_id", "term", X.skeleton(F.col("snippet")).alias("_hay"))
    proof = (
        verdicts.select("video_id", "term", skel.alias("_ev")).filter("_ev <> ''").distinct()
        .join(trusted, ["video_id", "term"])
        .groupBy("video_id", "term", "_ev").agg(F.bool_or(F.contains("_hay", F.col("_ev"))).alias("_ok"))
    )
    out = verdicts.withColumn("_ev", skel).join(proof, ["video_id", "term", "_ev"], "left")
    out = out.withColumn("verified", F.coalesce("_ok", F.lit(False)))
    out = out.withColumn("action", F.when((F.col("action") == "replace") & ~F.col("verified"), "uncertain").otherwise(F.col("action")))
    applicable = (
        (F.col("action") == "replace") & (X.strip(F.coalesce("correct", F.lit(""))) != "")
        & F.col("confidence").isin("high", "medium") & F.col("verified") & (F.col("correct") != F.col("term"))
    )
    return out.withColumn("applicable", F.coalesce(applicable, F.lit(False))).drop("_ev", "_ok")
