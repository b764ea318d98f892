"""Frames, slides and audio spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as C
from lectern.operators import intervals, ordered


def _cuts(ms: np.ndarray, stack: np.ndarray, ratio: float, hold: int):
    """first_cut(time, frame, start): the first row from ``start`` on that opens a new slide if the running
    one began at ``time`` with ``frame``; the number of rows if none does."""

    def first_cut(time: int, frame: np.ndarray, start: int) -> int:
        end = int(np.searchsorted(ms, time + hold, side="right"))  # held too long from here on
        for at in range(start, end, 64):
            part = stack[at:min(at + 64, end)]
            changed = np.abs(part - frame).mean(axis=1) / 255.0 > ratio
            if changed.any():
                return at + int(np.argmax(changed))
        return max(start, end)

    return first_cut


def frame_groups(
    frames: DataFrame,
    *,
    change_ratio: float = C.FRAME_CHANGE_RATIO,
    max_hold_ms: int = C.FRAME_MAX_HOLD_MS,
    max_groups: int | None = None,
) -> DataFrame:
    """Number the slide each sampled frame belongs to (column ``grp``).

    Columns: video_id, ms (unique in a course), gray ARRAY. A frame opens a new slide when it differs from the slide's
    first frame by more than ``change_ratio`` or the slide has been held too long. With ``max_groups`` frames past the
    last allowed slide are dropped.

    A course is spread over blocks. The slide that runs when a block begins started at most ``max_hold_ms`` before, so
    each block also gets the frames of that stretch and says for every one of them how a slide begun there leaves the
    block; these summaries are chained per course, and a second pass numbers the block's own frames.
    """
    key, halo = "video_id", "_halo"
    blocked = ordered.blocks(frames.select(key, "ms", "gray"), [key], ["ms"])
    # one row per block: only its first course can have begun in an earlier block
    starts = blocked.groupBy(ordered.BLOCK).agg(F.min(F.struct(key, "ms")).alias("_s")).select(
        ordered.BLOCK, F.col(f"_s.{key}").alias(key), F.col("_s.ms").alias("_from")
    )
    # a stretch of the longest hold touches two bins of that width
    edge = intervals.bin_of(F.col("_from"), max_hold_ms)
    before = (
        blocked.select(key, "ms", "gray", intervals.bin_of(F.col("ms"), max_hold_ms).alias("_bin"))
        .join(F.broadcast(starts.withColumn("_bin", F.explode(F.array(edge - 1, edge)))), [key, "_bin"])
        .filter((F.col("ms") < F.col("_from")) & (F.col("ms") >= F.col("_from") - max_hold_ms))
    )
    rows = blocked.select(ordered.BLOCK, key, "ms", "gray", F.lit(False).alias(halo)).unionByName(
        before.select(ordered.BLOCK, key, "ms", "gray", F.lit(True).alias(halo))
    )

    def parts(pdf: pd.DataFrame):
        pdf = pdf.sort_values("ms")
        stack = np.stack([np.asarray(g, dtype="float64") for g in pdf["gray"]])
        own = ~pdf[halo].to_numpy(dtype=bool)
        ms = pdf["ms"].to_numpy()
        return ms[own], stack[own], ms[~own], stack[~own]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        ms, stack, old, frames_before = parts(pdf)
        first_cut = _cuts(ms, stack, change_ratio, max_hold_ms)
        n = len(ms)
        # from the last row backwards: where a slide begun at a row of this block leaves it
        leaves: list[tuple[int, int]] = [(0, 0)] * n
        for i in range(n - 1, -1, -1):
            cut = first_cut(ms[i], stack[i], i + 1)
            leaves[i] = (int(ms[i]), 0) if cut >= n else (leaves[cut][0], leaves[cut][1] + 1)
        out = [(None, *leaves[0])]
        for time, frame in zip(old, frames_before):
            cut = first_cut(time, frame, 0)
            out.append((int(time), int(time), 0) if cut >= n else (int(time), leaves[cut][0], leaves[cut][1] + 1))
        # a slide that has been held too long by the first row: any older beginning
        table = pd.DataFrame(out, columns=["entry", "leave", "cuts"]).astype({"entry": "Int64"})
        return table.assign(blk=int(pdf[ordered.BLOCK].iat[0]), key=pdf[key].iat[0])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, state = [], None
        for blk, part in pdf.sort_values("blk").groupby("blk", sort=True):
            fresh = part[part["entry"].isna()].iloc[0]
            if state is None:
                state = (int(fresh.leave), int(fresh.cuts))
                continue
            ref, grp = state
            out.append((int(blk), fresh.key, ref, grp))
            known = part[part["entry"] == ref]
            # no row of this block can belong to a slide that began before its stretch
            step = known.iloc[0] if len(known) else None
            state = (int(step.leave), grp + int(step.cuts)) if step is not None else (int(fresh.leave), grp + 1 + int(fresh.cuts))
        return pd.DataFrame(out, columns=["blk", "key", "ref", "grp"])

    summary = rows.groupBy(ordered.BLOCK, key).applyInPandas(summarise, "entry long, leave long, cuts long, blk int, key string")
    entries = summary.groupBy("key").applyInPandas(chain, "blk int, key string, ref long, grp long")
    entries = entries.select(F.col("blk").alias(ordered.BLOCK), F.col("key").alias(key), "ref", "grp")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        ms, stack, old, frames_before = parts(pdf)
        first_cut = _cuts(ms, stack, change_ratio, max_hold_ms)
        group = np.zeros(len(ms), dtype="int64")
        ref, grp, at = pdf["ref"].iat[0], pdf["grp"].iat[0], 0
        if pd.isna(ref):
            grp = 0  # the course begins here
            cut = first_cut(ms[0], stack[0], 1)
        else:
            where = np.flatnonzero(old == int(ref))
            cut = first_cut(int(ref), frames_before[where[0]], 0) if len(where) else 0
        grp = int(grp)
        while True:
            group[at:cut] = grp
            if cut >= len(ms):
                break
            at, grp = cut, grp + 1
            cut = first_cut(ms[at], stack[at], at + 1)
        return pd.DataFrame({key: pdf[key].iat[0], "ms": ms, "grp": group})

    # at most one entry per block
    numbered = rows.join(F.broadcast(entries), [ordered.BLOCK, key], "left").groupBy(ordered.BLOCK, key).applyInPandas(
        number, "video_id string, ms long, grp long"
    )
    return numbered if max_groups is None else numbered.filter(F.col("grp") < max_groups)


def slides_of_groups(grouped: DataFrame, durations: DataFrame) -> DataFrame:
    """One row per slide: it lasts until the next slide, the last one until the course ends."""
    starts = grouped.groupBy("video_id", "grp").agg(F.min("ms").alias("start_ms"))
    following = starts.select("video_id", (F.col("grp") - 1).alias("grp"), F.col("start_ms").alias("_next"))
    return (
        starts.join(following, ["video_id", "grp"], "left")
        .join(durations, "video_id", "left")
        .withColumn(
            "end_ms",
            F.coalesce("_next", F.greatest(F.coalesce("duration_ms", F.lit(0)), F.col("start_ms") + 1000)),
        )
        .drop("_next", "duration_ms")
    )


def representative_ms(start: Column, end: Column) -> Column:
    """The middle of a slide, since its first frame may still be drawing."""
    return F.when(end <= start, start).otherwise(F.floor((start + end) / 2).cast("long"))


def representative_frames(grouped: DataFrame, slides: DataFrame) -> DataFrame:
    """The sampled frame of each slide nearest to its middle; ties go to the earlier frame."""
    rep = representative_ms(F.col("start_ms"), F.col("end_ms"))
    return (
        grouped.join(slides.select("video_id", "grp", rep.alias("rep_ms")), ["video_id", "grp"])
        .groupBy("video_id", "grp", "rep_ms")
        .agg(F.min_by("ms", F.struct(F.abs(F.col("ms") - F.col("rep_ms")), F.col("ms"))).alias("frame_ms"))
    )


def silence_pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Pair the n-th silence start with the n-th end; a missing end is one second later."""
    e = ends.select("video_id", "pos", F.col("at").alias("_end"))
    return starts.join(e, ["video_id", "pos"], "left").select(
        "video_id", "pos", F.col("at").alias("start_ms"),
        F.coalesce("_end", F.col("at") + 1000).alias("end_ms"),
    )


_NEVER = 1 << 60


def split_points(
    courses: DataFrame, silences: DataFrame, *, chunk_ms: int, overlap_ms: int = C.SPLIT_OVERLAP_MS
) -> DataFrame:
    """Cut long audio near every multiple of ``chunk_ms``, in the middle of a near silence if any.

    One row per span: video_id, start_ms, end_ms. Which points stay is a resetting fold over blocks, so a recording of
    any length is spread and nothing is gathered.
    """
    window = max(C.SPLIT_MIN_WINDOW_MS, chunk_ms // 6)
    long = courses.filter(F.col("duration_ms") > chunk_ms)
    targets = long.select(
        "video_id",
        F.explode(F.sequence(F.lit(chunk_ms), F.col("duration_ms") - 1, F.lit(chunk_ms))).alias("target"),
    )
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    own = intervals.bin_of(F.col("_c"), window)
    cands = silences.select("video_id", middle.alias("_c")).distinct().select(
        "video_id", "_c", F.explode(F.array(own - 1, own, own + 1)).alias("_bin")
    )
    near = (
        targets.withColumn("_bin", intervals.bin_of(F.col("target"), window))
        .join(cands, ["video_id", "_bin"])
        .filter(F.abs(F.col("_c") - F.col("target")) <= window)
        .groupBy("video_id", "target")
        .agg(F.min(F.struct(F.abs(F.col("_c") - F.col("target")).alias("d"), F.col("_c").alias("c"))).alias("_n"))
    )
    points = targets.join(near, ["video_id", "target"], "left").select(
        "video_id", "target", F.coalesce(F.col("_n.c"), F.col("target").cast("long")).alias("point")
    )
    # points do not decrease from target to target; a run that may only be as long as the gap begins at every point that stays
    runs = ordered.cut_runs(
        points, "video_id", ["target"], start="point", end="point", gap_ms=_NEVER, max_span=C.SPLIT_MIN_GAP_MS
    )
    kept = runs.groupBy("video_id", "run").agg(F.min("point").alias("end_ms"))
    starts = kept.select("video_id", (F.col("run") + 1).alias("run"), F.greatest(F.lit(0), F.col("end_ms") - overlap_ms).alias("start_ms"))
    spans = (
        starts.join(kept, ["video_id", "run"], "full")
        .join(long.select("video_id", "duration_ms"), "video_id")
        .select(
            "video_id",
            F.coalesce("start_ms", F.lit(0).cast("long")).alias("start_ms"),
            F.least("duration_ms", "end_ms").alias("end_ms"),
        )
        .filter(F.col("end_ms") - F.col("start_ms") > C.SPLIT_MIN_SPAN_MS)
    )
    short = courses.filter(F.col("duration_ms") <= chunk_ms).select(
        "video_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms")
    )
    return spans.unionByName(short)


def ocr_text(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Recognised lines of one image -> text; uncertain lines are dropped, an unknown score stays."""
    good = lines.filter(F.col("score").isNull() | (F.col("score") >= C.OCR_MIN_SCORE))
    stripped = good.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    return stripped.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col("line").alias("t")))),
                lambda x: x["t"],
            ),
            "\n",
        ).alias("ocr_text")
    )


def proxy_rule(video: Column, audio: Column, container: Column) -> tuple[Column, Column]:
    """(must be rebuilt, reason) for browsers."""
    bad_video = ~video.isin(*C.GOOD_VIDEO_CODECS)
    bad_audio = audio.isNotNull() & ~audio.isin(*C.GOOD_AUDIO_CODECS)
    bad_box = (F.coalesce(container, F.lit("")) != "") & ~F.contains(container, F.lit("mp4"))
    reason = (
        F.when(video.isNull(), F.lit("no video"))
        .when(bad_video, F.concat(F.lit("video codec "), video))
        .when(bad_audio, F.concat(F.lit("audio codec "), audio))
        .when(bad_box, F.concat(F.lit("container "), container))
        .otherwise(F.lit("compatible"))
    )
    return video.isNotNull() & (bad_video | bad_audio | bad_box), reason


def triage(code: Column, http: Column) -> Column:
    """What to do with a speech-service response."""
    return (
        F.when(code == C.CODE_OK, "ok")
        .when(code == C.CODE_NO_SPEECH, "no_speech")
        .when(code.isin(*C.CODES_PROCESSING), "processing")
        .when(http.isin(*C.HTTP_RETRYABLE) | code.startswith("5"), "transient")
        .when(code.startswith("4") | (http >= 400), "fatal")
        .when(code == "", "transient")
        .otherwise("fatal")
    )


def failure_hint(code: Column, message: Column) -> Column:
    low = F.lower(F.trim(F.concat_ws(" ", code, message)))
    out = F.lit("")
    for words, hint in reversed(C.FAILURE_HINTS):
        out = F.when(low.rlike("|".join(words)), hint).otherwise(out)
    return out


def reusable_slides(slides: DataFrame, ocr_on: bool = True) -> DataFrame:
    """Per course: may existing slides be reused? Only if OCR is off or some slide has text."""
    has_text = F.bool_or(F.coalesce("ocr_text", F.lit("")) != "")
    return slides.groupBy("video_id").agg((has_text if ocr_on else F.lit(True)).alias("reusable"))
