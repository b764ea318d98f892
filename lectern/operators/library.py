"""Courses, series, sessions: merges, purges, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, paths, text as X
from lectern.functions.lists import unfold
from lectern.operators import retrieval

# ------------------------------------------------------------------ merges


def latest(rows: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Newest row per key. An aggregate, not a window: versions of one key combine before the
    shuffle, so many copies of one key are no hot group."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """New rows replace old rows of the same key; the newest of several new ones wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.struct("_new", version)).drop("_new")


def upsert_courses(old: DataFrame, new: DataFrame, now: Column, keep: Sequence[str] = ("video_summary", "created_at")) -> DataFrame:
    """All columns come from the new row but those kept from the old one; ``updated_at`` is set."""
    cols = [c for c in old.columns if c != "video_id"]
    joined = old.alias("o").join(new.alias("n"), "video_id", "full_outer")
    fresh = F.col("n._new").isNotNull()

    def pick(c: str) -> Column:
        if c == "updated_at":
            value = F.when(fresh, now).otherwise(F.col(f"o.{c}"))
        elif c in keep:
            value = F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        else:
            value = F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return value.alias(c)

    return joined.select("video_id", *[pick(c) for c in cols])


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """A blank new title keeps the old one, an unspecified deleted flag keeps the old flag."""
    j = old.alias("o").join(new.alias("n"), "video_id", "full_outer")
    return j.select(
        "video_id",
        F.coalesce(F.nullif(X.strip(F.col("n.title")), F.lit("")), F.col("o.title"), F.lit("")).alias("title"),
        F.coalesce("n.deleted", "o.deleted", F.lit(False)).alias("deleted"),
    )


def patch(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite the columns that the patch table fills."""
    cols = [c for c in changes.columns if c not in keys]
    j = base.alias("b").join(changes.alias("p"), list(keys), "left")
    return j.select(*[
        F.coalesce(f"p.{c}", f"b.{c}").alias(c) if c in cols else F.col(c if c in keys else f"b.{c}") for c in base.columns
    ])


def replace_courses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of every course that occurs in ``new`` are replaced as a whole."""
    return old.join(new.select("video_id").distinct(), "video_id", "left_anti").unionByName(new)


def write_courses(rows: DataFrame, folder: str, order: Sequence[str] = ("idx",), rows_per_file: int = 1_000_000) -> None:
    """Replace the written courses on disk and leave the others. Rows are range-partitioned by course and ``order``:
    a large course is written by many tasks, small ones share a task and get one file each."""
    by = ["video_id", *[c for c in order if c in rows.columns]]
    (
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .write.partitionBy("video_id").mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "dynamic").parquet(folder)
    )


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove courses from every table that describes them. The usage log stays (the money is
    spent) and so do quizzes; messages go with their sessions; titles are remembered as deleted."""
    keep = {"usage", "quizzes", "messages", "labels"}
    ids = gone.select("video_id").distinct()
    out = {n: df if n in keep else df.join(ids, "video_id", "left_anti") for n, df in tables.items()}
    if "messages" in tables:
        out["messages"] = tables["messages"].join(out["sessions"].select("session_id"), "session_id", "left_semi")
    if "labels" in tables:
        titles = ids.join(tables["videos"].select("video_id", "title"), "video_id", "left")
        out["labels"] = merge_labels(tables["labels"], titles.withColumn("deleted", F.lit(True)))
    return out


def carry_over(new: DataFrame, old: DataFrame, key: str, same: Sequence[str] = ()) -> DataFrame:
    """Bring titles and summaries over to a rebuilt structure: same id and, for chunks, same text.
    What the new row already has wins."""
    o = old.select(
        "video_id", key, *[F.col(c).alias(f"_o_{c}") for c in same],
        F.col("title").alias("_o_title"), F.col("summary").alias("_o_summary"),
    )
    j = new.join(o, ["video_id", key], "left")
    usable = F.lit(True)
    for c in same:
        usable = usable & F.col(c).eqNullSafe(F.col(f"_o_{c}"))

    def pick(c: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.when(usable, F.col(f"_o_{c}")), F.lit(""))

    return j.withColumn("title", pick("title")).withColumn("summary", pick("summary")).select(*new.columns)


def changes(new: DataFrame, old: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """What a rebuild does to each row: video_id, ``key``, change = kept, changed (a column of ``same`` differs), added, gone."""
    on = ["video_id", key]
    # a null is hashed as nothing, so its place is told by a flag
    told = [part for c in same for part in (F.col(c), F.col(c).isNull())]
    sides = [d.select(*on, F.xxhash64(*told).alias(f"_{side}")) for side, d in (("n", new), ("o", old))]
    kind = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "gone")
        .when(F.col("_n") == F.col("_o"), "kept").otherwise("changed")
    )
    return sides[0].join(sides[1], on, "full").select(*on, kind.alias("change"))


def reindex_targets(chunks: DataFrame, embedded: DataFrame, body: Column) -> DataFrame:
    """Chunks whose text has no vector yet. ``embedded``: chunk_id, text_hash."""
    return chunks.withColumn("text_hash", F.xxhash64(body)).join(embedded, ["chunk_id", "text_hash"], "left_anti")


# ------------------------------------------------------------------ listings


def course_rows(asked: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What the tables hold of the asked courses, each row named by its ``kind``. ``asked`` is a table with a video_id, so any
    number of courses is read in one job; tables share their columns."""
    out = None
    for kind, rows in tables.items():
        found = asked.join(rows, "video_id").withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out


def course_list(courses: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Courses with the number of their chapters, chunks, slides, ...: each child table is counted
    on its own before the join."""
    out = courses
    for name, rows in children.items():
        out = out.join(rows.groupBy("video_id").agg(F.count("*").alias(name)), "video_id", "left")
    return out.select(*courses.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in children])


def in_series(courses: DataFrame) -> DataFrame:
    """Courses with their series and its size, in display order: ungrouped last, then by label,
    members by title. Members stay rows, so a series may have any number of them."""
    tagged = courses.withColumn("series_id", paths.series_id(F.col("path"))).withColumn(
        "label", paths.series_label(F.col("series_id"))
    )
    sizes = tagged.groupBy("series_id").agg(F.count("*").alias("video_count"))
    return tagged.join(sizes, "series_id").withColumn("duration_label", clock.clock_label(F.col("duration_ms"))).orderBy(
        F.col("series_id") == paths.UNGROUPED, F.lower("label"), F.lower("title"), "video_id"
    )


def find_course(courses: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tokens -> courses by id, by path, or by part of the title; ``matches`` > 1 = ambiguous.

    An exact hit beats title hits. ``wanted``: token. Exact forms are equi-joins; a token left over meets only
    titles that hold its rarest piece of three characters (the token itself, if shorter), so a
    prefix that all titles share brings nobody together.
    """
    exact = (
        courses.select(F.col("video_id").alias("token"), "video_id")
        .unionByName(courses.select(F.col("path").alias("token"), "video_id"))
        .join(wanted, "token").groupBy("token").agg(F.min("video_id").alias("video_id"), F.lit(1).cast("long").alias("matches"))
    )
    rest = wanted.join(exact, "token", "left_anti")
    low = F.lower("title")
    grams = F.flatten(
        F.transform(
            F.array(F.lit(1), F.lit(2), F.lit(3)),
            lambda n: F.when(
                F.length(low) >= n,
                F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    titles = unfold(courses.filter(F.length("title") > 0), ["video_id", "title"], F.array_distinct(grams), "gram")
    token = F.lower("token")
    pieces = F.when(F.length(token) < 3, F.array(token)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3)))
    )
    asked = unfold(rest.filter(F.length("token") > 0), ["token"], F.array_distinct(pieces), "gram")
    common = titles.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(common, "gram", "left").groupBy("token").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("gram"))).alias("_r")
    )
    part = (
        rarest.filter("_r.n > 0").select("token", F.col("_r.gram").alias("gram"))
        .join(titles, "gram").filter(F.contains(low, F.lower("token")))
        .groupBy("token").agg(F.min("video_id").alias("video_id"), F.count("*").alias("matches"))
    )
    return exact.unionByName(part)


def status_label(status: Column) -> Column:
    pairs = [F.lit(x) for pair in C.STATUS_LABELS for x in pair]
    return F.create_map(*pairs)[status]


# ------------------------------------------------------------------ sessions


def session_list(sessions: DataFrame, messages: DataFrame, include_archived: bool = False) -> DataFrame:
    """Sessions with message count and a display title (own title, or the first question)."""
    user = F.col("role") == "user"
    per = messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("id"))).alias("first_question"),
    )
    shown = sessions if include_archived else sessions.filter(~F.col("archived"))
    first = F.coalesce("first_question", F.lit(""))
    title = F.when(F.col("title") != "", F.col("title")).when(first != "", X.short_title(first)).otherwise(F.lit(C.NEW_CHAT_TITLE))
    return (
        shown.join(per, "session_id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)))
        .withColumn("display_title", title)
    )


def last_messages(messages: DataFrame, n: int = C.HISTORY_MESSAGES) -> DataFrame:
    """The newest ``n`` messages of every session."""
    return retrieval.top(messages, ["session_id"], [F.col("id").desc()], n)


def touch_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """A new message moves its session up: updated = the later of both."""
    newest = messages.groupBy("session_id").agg(F.max("created_s").alias("_m"))
    return sessions.join(newest, "session_id", "left").withColumn(
        "updated_s", F.greatest("updated_s", F.coalesce("_m", "updated_s"))
    ).drop("_m")


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("session_id").distinct()
    return sessions.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti")


def check_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Does the session exist and belong to the course that is asked?"""
    known = sessions.select("session_id", F.col("video_id").alias("_of"))
    return requests.join(known, "session_id", "left").withColumn(
        "verdict",
        F.when(F.col("_of").isNull(), "unknown").when(F.col("_of") != F.col("video_id"), "other_course").otherwise("ok"),
    ).drop("_of")
