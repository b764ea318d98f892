"""Transcript, slide and media queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text, vectors
from lectern.operators import intervals, media, ordered, pipeline, segments as seg
from lectern.plans import adapters as A
from lectern.plans.registry import query
from lectern.session import settle
from lectern.sources import speech, subtitles

# ------------------------------------------------------------------ chunks and chapters


@query("chunk_segments", "chunk_id string, video_id string, idx long, start_ms long, end_ms long, n_segments long",
       "SELECT * FROM v_chunks")
def chunk_segments(t):
    return A.transcript_chunks(t)


@query("chunk_text", "chunk_id string, text string", "SELECT chunk_id, text FROM v_chunks")
def chunk_text(t):
    return A.transcript_chunks(t)


@query("chapter_segments", "chapter_id string, video_id string, idx long, start_ms long, end_ms long, n_chunks long",
       "SELECT * FROM v_chapters")
def chapter_segments(t):
    return A.transcript_chapters(t)


@query("chunk_ids", "video_id string, seg_id long, idx long, segment_key string", """
SELECT video_id, seg_id, idx, video_id || '-c' || printf('%04d', idx) AS segment_key
FROM v_seg_idx""")
def chunk_ids(t):
    return A.numbered_segments(t).withColumn(
        "segment_key", F.concat_ws("-c", "video_id", seg.padded(F.col("idx"), 4))
    )


@query("parent_attach", "chunk_id string, parent_id string", """
SELECT c.chunk_id, c.video_id || '-ch' || printf('%03d', r.run) AS parent_id
FROM v_chunks c LEFT JOIN v_chapter_runs r ON r.video_id = c.video_id AND r.rn = c.idx""")
def parent_attach(t):
    chunks = A.transcript_chunks(t)
    return seg.with_parents(chunks, seg.chapter_runs(chunks, gap_ms=60_000, max_span=600_000))


# ------------------------------------------------------------------ stitching and splitting

_UTTERANCES = """
SELECT video_id, seg_id AS pos, start_ms // 86400 AS span_no, start_ms - (start_ms // 86400) * 86400 AS start_ms,
       end_ms - (start_ms // 86400) * 86400 AS end_ms, (start_ms // 86400) * 86400 AS span_start, text FROM v_segments
UNION ALL
SELECT video_id, seg_id, start_ms // 86400 + 1, start_ms - (start_ms // 86400) * 86400 - 64800,
       end_ms - (start_ms // 86400) * 86400 - 64800, (start_ms // 86400) * 86400 + 64800, text
FROM v_segments WHERE start_ms - (start_ms // 86400) * 86400 >= 64800"""


def utterances(t):
    """sentences of day-long spans; the last quarter of a day is recognised again in the next span"""
    s = A.segments(t)
    day = F.floor(F.col("start_ms") / 86400)
    inside = F.col("start_ms") - day * 86400

    def span(number, begin):
        return s.select(
            "video_id", F.col("seg_id").alias("pos"), number.alias("span_no"),
            (F.col("start_ms") - begin).alias("start_ms"), (F.col("end_ms") - begin).alias("end_ms"),
            begin.alias("span_start"), "text", "speaker", inside.alias("_in"),
        )

    first = span(day, day * 86400)
    again = span(day + 1, day * 86400 + 64800).filter("_in >= 64800")
    return first.unionByName(again).drop("_in")


@query("stitch_overlaps", "video_id string, span_no long, pos long, start_ms long, end_ms long", f"""
SELECT video_id, span_no, pos, abs_start AS start_ms, abs_end AS end_ms FROM (
  SELECT *, max(abs_end) OVER (PARTITION BY video_id ORDER BY span_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM (SELECT *, span_start + start_ms AS abs_start, span_start + end_ms AS abs_end FROM ({_UTTERANCES})))
WHERE latest IS NULL OR abs_end > latest""")
def stitch_overlaps(t):
    return seg.stitch(utterances(t))


_SILENCES = """
SELECT * FROM (SELECT video_id, max(end_ms) OVER w - first_ms AS start_ms, start_ms - first_ms AS end_ms
  FROM (SELECT *, min(start_ms) OVER (PARTITION BY video_id) AS first_ms FROM v_segments)
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE start_ms < end_ms"""


def lengths(t):
    return A.segments(t).groupBy("video_id").agg(
        F.min("start_ms").alias("first_ms"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms")
    )


def silences(t):
    order = ["start_ms", "seg_id"]
    s = ordered.prefix(
        ordered.blocks(A.segments(t).select("video_id", "start_ms", "end_ms", "seg_id"), ["video_id"], order),
        ["video_id"], order, {"_quiet_from": ("max", F.col("end_ms"))},
    )
    return (
        s.join(lengths(t), "video_id")
        .filter(F.col("_quiet_from") < F.col("start_ms"))
        .select("video_id", (F.col("_quiet_from") - F.col("first_ms")).alias("start_ms"), (F.col("start_ms") - F.col("first_ms")).alias("end_ms"))
    )


@query("split_points", "video_id string, start_ms long, end_ms long", f"""
WITH sil AS (SELECT video_id, (start_ms + end_ms) // 2 AS c FROM ({_SILENCES})),
len AS (SELECT video_id, max(end_ms) - min(start_ms) AS duration_ms FROM v_segments GROUP BY video_id),
tgt AS (SELECT video_id, unnest(range(120000, duration_ms, 120000)) AS target FROM len),
near AS (SELECT g.video_id, g.target, s.c, row_number() OVER (PARTITION BY g.video_id, g.target ORDER BY abs(s.c - g.target), s.c) AS rn
         FROM tgt g JOIN sil s ON s.video_id = g.video_id AND abs(s.c - g.target) <= 20000),
pts AS (SELECT g.video_id, coalesce(n.c, g.target) AS p FROM tgt g LEFT JOIN near n ON n.video_id = g.video_id AND n.target = g.target AND n.rn = 1
        UNION ALL SELECT video_id, 0 FROM len),
spans AS (SELECT p.video_id, p.p, coalesce(lead(p.p) OVER (PARTITION BY p.video_id ORDER BY p.p), l.duration_ms) AS nxt, l.duration_ms
          FROM pts p JOIN len l ON l.video_id = p.video_id)
---
SELECT video_id, CASE WHEN p > 0 THEN greatest(0, p - 1000) ELSE 0 END AS start_ms, least(duration_ms, nxt) AS end_ms
FROM spans WHERE least(duration_ms, nxt) - CASE WHEN p > 0 THEN greatest(0, p - 1000) ELSE 0 END > 5000 OR duration_ms <= 120000""")
def split_points(t):
    return media.split_points(lengths(t).drop("first_ms"), silences(t), chunk_ms=120_000)


@query("silence_pairs", "video_id string, pos long, start_ms long, end_ms long", """
WITH st AS (SELECT video_id, start_ms, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seg_id) - 1 AS pos FROM v_segments WHERE text LIKE 'view %'),
en AS (SELECT video_id, end_ms, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seg_id) - 1 AS pos FROM v_segments WHERE text LIKE 'click %')
---
SELECT st.video_id, st.pos, st.start_ms, coalesce(en.end_ms, st.start_ms + 1000) AS end_ms
FROM st LEFT JOIN en ON en.video_id = st.video_id AND en.pos = st.pos""")
def silence_pairs(t):
    order = ["start_ms", "seg_id"]

    def nth(kind, at):
        rows = A.segments(t).filter(F.col("text").startswith(kind)).select("video_id", "start_ms", "seg_id", F.col(at).alias("at"))
        return ordered.prefix(ordered.blocks(rows, ["video_id"], order), ["video_id"], order, {"pos": ("count", F.lit(1))})

    return media.silence_pairs(nth("view ", "start_ms"), nth("click ", "end_ms"))


# ------------------------------------------------------------------ slides


@query("slide_overlap_join", "chunk_id string, n_slides long, slide_idxs string, ocr_text string", """
SELECT c.chunk_id, count(s.slide_id) AS n_slides, coalesce(string_agg(CAST(s.slide_id AS VARCHAR), ',' ORDER BY s.slide_id), '') AS slide_idxs,
       coalesce(string_agg(s.ocr_text, chr(10) ORDER BY s.slide_id), '') AS ocr_text
FROM v_chunks c LEFT JOIN v_slides s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms
GROUP BY c.chunk_id""")
def slide_overlap_join(t):
    return seg.attach_slides(A.transcript_chunks(t), A.slides(t)).select(
        "chunk_id", F.size("slide_idxs").alias("n_slides"),
        F.array_join(F.col("slide_idxs").cast("array<string>"), ",").alias("slide_idxs"), "ocr_text",
    )


@query("slide_at", "seg_id long, at_ms long, slide_id long, ocr_text string", """
SELECT p.seg_id, p.start_ms AS at_ms, s.slide_id, s.ocr_text
FROM v_segments p JOIN v_slides s ON s.video_id = p.video_id AND s.start_ms <= p.start_ms AND s.end_ms >= p.start_ms""")
def slide_at(t):
    points = A.segments(t).select("video_id", "seg_id", F.col("start_ms").alias("at_ms"))
    return intervals.stab_join(points, A.slides(t), ["video_id"], at="at_ms", span=("start_ms", "end_ms"))


@query("refresh_slide_text", "chunk_id string, ocr_text string", """
WITH linked AS (SELECT c.chunk_id, s.slide_id, s.ocr_text, row_number() OVER (PARTITION BY c.chunk_id ORDER BY s.slide_id) AS pos
  FROM v_chunks c JOIN v_slides s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms)
---
SELECT chunk_id, ocr_text FROM (
  SELECT chunk_id, string_agg(ocr_text, chr(10) ORDER BY pos) AS old_text,
         string_agg(CASE WHEN slide_id % 2 = 0 THEN replace(ocr_text, 'slide', 'Slide') ELSE ocr_text END, chr(10) ORDER BY pos) AS ocr_text
  FROM linked GROUP BY chunk_id) WHERE old_text <> ocr_text""")
def refresh_slide_text(t):
    slides = A.slides(t)
    old = seg.attach_slides(A.transcript_chunks(t), slides)
    better = slides.withColumn(
        "ocr_text",
        F.when(F.col("slide_id") % 2 == 0, F.replace("ocr_text", F.lit("slide"), F.lit("Slide"))).otherwise(F.col("ocr_text")),
    )
    return seg.refresh_slide_text(old, better)


@query("ocr_lines", "slide_id long, ocr_text string", """
SELECT slide_id, string_agg(line, chr(10) ORDER BY seg_id) AS ocr_text FROM (
  SELECT event_id // 10 AS slide_id, event_id AS seg_id, trim(event_type || ' ') AS line,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END AS score FROM events)
WHERE (score IS NULL OR score >= 0.5) AND line <> '' GROUP BY slide_id""")
def ocr_lines(t):
    n = F.col("event_id")
    lines = t.events.select(
        F.floor(n / 10).alias("slide_id"), n.alias("seg_id"), F.concat("event_type", F.lit(" ")).alias("line"),
        F.when(n % 11 == 0, F.lit(None)).otherwise((n % 10) / 10.0).alias("score"),
    )
    return media.ocr_text(lines, ["slide_id"], "seg_id")


@query("slide_reuse", "video_id string, reusable boolean", """
SELECT video_id, bool_or(ocr_text <> '') AS reusable FROM (
  SELECT video_id, CASE WHEN video_id LIKE '%7' THEN '' ELSE ocr_text END AS ocr_text FROM v_slides) GROUP BY video_id""")
def slide_reuse(t):
    blanked = A.slides(t).withColumn("ocr_text", F.when(F.col("video_id").endswith("7"), "").otherwise(F.col("ocr_text")))
    return media.reusable_slides(blanked)


@query("media_rule", "event_id long, rebuild boolean, reason string", """
SELECT event_id, video IS NOT NULL AND (video NOT IN ('h264', 'vp8', 'vp9', 'av1') OR (audio IS NOT NULL AND audio NOT IN ('aac', 'mp3', 'opus', 'vorbis', 'flac')) OR box NOT LIKE '%mp4%') AS rebuild,
       CASE WHEN video IS NULL THEN 'no video' WHEN video NOT IN ('h264', 'vp8', 'vp9', 'av1') THEN 'video codec ' || video
            WHEN audio IS NOT NULL AND audio NOT IN ('aac', 'mp3', 'opus', 'vorbis', 'flac') THEN 'audio codec ' || audio
            WHEN box NOT LIKE '%mp4%' THEN 'container ' || box ELSE 'compatible' END AS reason
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'h264' WHEN 'click' THEN 'hevc' WHEN 'error' THEN NULL ELSE 'vp9' END AS video,
             CASE event_id % 3 WHEN 0 THEN 'aac' WHEN 1 THEN 'ac3' END AS audio,
             CASE WHEN event_id % 2 = 0 THEN 'mov,mp4' ELSE 'matroska' END AS box FROM events)""")
def media_rule(t):
    n = F.col("event_id")
    kind = F.col("event_type")
    video = F.when(kind == "view", "h264").when(kind == "click", "hevc").when(kind == "error", F.lit(None)).otherwise("vp9")
    audio = F.when(n % 3 == 0, "aac").when(n % 3 == 1, "ac3")
    probe = t.events.select("event_id", video.alias("video"), audio.alias("audio"), F.when(n % 2 == 0, "mov,mp4").otherwise("matroska").alias("box"))
    rebuild, reason = media.proxy_rule(F.col("video"), F.col("audio"), F.col("box"))
    return probe.select("event_id", rebuild.alias("rebuild"), reason.alias("reason"))


@query("call_triage", "event_id long, outcome string, hint string", """
SELECT event_id, CASE WHEN code = '20000000' THEN 'ok' WHEN code = '20000003' THEN 'no_speech' WHEN code IN ('20000001', '20000002') THEN 'processing'
    WHEN http IN (408, 425, 429, 500, 502, 503, 504) OR code LIKE '5%' THEN 'transient' WHEN code LIKE '4%' OR http >= 400 THEN 'fatal'
    WHEN code = '' THEN 'transient' ELSE 'fatal' END AS outcome,
  CASE WHEN regexp_matches(m, 'error params|invalid param|param') THEN 'bad_request' WHEN regexp_matches(m, 'no permission|not granted|unauthorized|auth|forbidden') THEN 'no_access'
    WHEN regexp_matches(m, 'quota|exceed|limit|qps') THEN 'over_quota' WHEN regexp_matches(m, 'not found|no such') THEN 'missing_resource' ELSE '' END AS hint
FROM (SELECT event_id, code, http, lower(trim(code || ' ' || message)) AS m FROM (
  SELECT event_id, CASE event_id % 9 WHEN 0 THEN '20000000' WHEN 1 THEN '20000003' WHEN 2 THEN '20000001' WHEN 3 THEN '45000001' WHEN 4 THEN '55000001' WHEN 5 THEN '' ELSE '30000000' END AS code,
         CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 404 ELSE 200 END AS http,
         CASE event_type WHEN 'view' THEN 'Invalid Param' WHEN 'click' THEN 'Unauthorized key' WHEN 'error' THEN 'QPS exceed' WHEN 'signup' THEN 'No such resource' ELSE event_type END AS message FROM events)) AS log""")
def call_triage(t):
    n = F.col("event_id")
    code = F.when(n % 9 == 0, "20000000").when(n % 9 == 1, "20000003").when(n % 9 == 2, "20000001").when(n % 9 == 3, "45000001").when(n % 9 == 4, "55000001").when(n % 9 == 5, "").otherwise("30000000")
    http = F.when(n % 4 == 1, 429).when(n % 4 == 2, 404).otherwise(200)
    kind = F.col("event_type")
    message = F.when(kind == "view", "Invalid Param").when(kind == "click", "Unauthorized key").when(kind == "error", "QPS exceed").when(kind == "signup", "No such resource").otherwise(kind)
    log = t.events.select("event_id", code.alias("code"), http.alias("http"), message.alias("message"))
    return log.select("event_id", media.triage(F.col("code"), F.col("http")).alias("outcome"), media.failure_hint(F.col("code"), F.col("message")).alias("hint"))


# ------------------------------------------------------------------ times


@query("time_labels", "seg_id long, label string, vtt string", """
SELECT seg_id, CASE WHEN ms // 3600000 > 0 THEN printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%02d:%02d', ms // 60000, ms // 1000 % 60) END AS label,
       printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt
FROM (SELECT event_id AS seg_id, greatest(0, CAST(floor((value - 5) * 20000) AS BIGINT)) AS ms FROM events)""")
def time_labels(t):
    ms = F.floor((F.col("value") - 5) * 20000).cast("long")
    return t.events.select(F.col("event_id").alias("seg_id"), clock.clock_label(ms).alias("label"), clock.vtt_stamp(ms).alias("vtt"))


@query("vtt_times", "seg_id long, start_stamp string, end_stamp string", """
SELECT seg_id, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS start_stamp,
       printf('%02d:%02d:%02d.%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS end_stamp FROM v_segments""")
def vtt_times(t):
    return A.segments(t).select("seg_id", clock.vtt_stamp(F.col("start_ms")).alias("start_stamp"), clock.vtt_stamp(F.col("end_ms")).alias("end_stamp"))


@query("parse_times", "seg_id long, label string, ms long", """
SELECT seg_id, label, CASE WHEN len(p) = 3 THEN (CAST(p[1] AS BIGINT) * 3600 + CAST(p[2] AS BIGINT) * 60 + CAST(p[3] AS BIGINT)) * 1000 ELSE (CAST(p[1] AS BIGINT) * 60 + CAST(p[2] AS BIGINT)) * 1000 END AS ms
FROM (SELECT *, string_split(label, ':') AS p FROM (
  SELECT event_id AS seg_id, CASE WHEN event_id % 2 = 0 THEN printf('%02d:%02d:%02d', event_id % 24, event_id % 60, event_id % 59) ELSE printf('%02d:%02d', event_id % 60, event_id % 59) END AS label FROM events))""")
def parse_times(t):
    n = F.col("event_id")
    label = F.when(n % 2 == 0, F.format_string("%02d:%02d:%02d", n % 24, n % 60, n % 59)).otherwise(F.format_string("%02d:%02d", n % 60, n % 59))
    return t.events.select(n.alias("seg_id"), label.alias("label")).withColumn("ms", clock.parse_clock(F.col("label")))


_CUES = """
SELECT video_id, seg_id, start_ms, CASE WHEN text LIKE 'error %' THEN ' ' ELSE replace(text, '"k": ', '-->') END AS text,
       end_ms - 100 AS end_ms FROM v_segments"""


@query("webvtt_export", "video_id string, seg_id long, cue string", f"""
SELECT video_id, seg_id, printf('%02d:%02d:%02d.%03d --> ', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000)
   || printf('%02d:%02d:%02d.%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) || chr(10) || replace(text, '-->', '→') || chr(10) AS cue
FROM (SELECT *, CASE WHEN end_ms <= start_ms THEN start_ms + 1500 ELSE end_ms END AS e FROM ({_CUES})) WHERE trim(text) <> ''""")
def webvtt_export(t):
    cues = A.segments(t).withColumn("end_ms", F.col("end_ms") - 100).withColumn(
        "text", F.when(F.col("text").startswith("error "), " ").otherwise(F.replace("text", F.lit('"k": '), F.lit("-->")))
    )
    return subtitles.cues(cues)


# ------------------------------------------------------------------ nearest and tolerance

_POINTS = """
SELECT seg_id AS pid, video_id, start_ms + 20000 * (seg_id % 7 - 3) AS at_ms FROM v_segments"""


def points(t):
    shift = 20000 * (F.col("seg_id") % 7 - 3)
    return A.segments(t).select(
        F.col("seg_id").alias("pid"), "video_id", (F.col("start_ms") + shift).alias("at_ms")
    )


@query("nearest_chunk", "pid long, at_ms long, idx long, distance long", f"""
SELECT pid, at_ms, idx, d AS distance FROM (
  SELECT p.pid, p.at_ms, c.idx, CASE WHEN c.start_ms <= p.at_ms AND p.at_ms <= c.end_ms THEN 0 ELSE abs(c.start_ms - p.at_ms) END AS d,
         row_number() OVER (PARTITION BY p.pid ORDER BY d, c.idx) AS rn
  FROM ({_POINTS}) p LEFT JOIN v_chunks c ON c.video_id = p.video_id) WHERE rn = 1""")
def nearest_chunk(t):
    return intervals.nearest_span(
        points(t), A.transcript_chunks(t), "video_id", point_id=["pid"], at="at_ms", span=("start_ms", "end_ms"), idx="idx"
    )


@query("anchor_check", "pid long, at_ms long", f"""
SELECT pid, at_ms FROM ({_POINTS}) p WHERE EXISTS (
  SELECT 1 FROM (SELECT video_id, start_ms FROM v_chunks UNION SELECT video_id, start_ms FROM v_chapters) a
  WHERE a.video_id = p.video_id AND abs(a.start_ms - p.at_ms) <= 15000)""")
def anchor_check(t):
    return intervals.tolerance_semi(
        points(t), seg.time_anchors(A.transcript_chapters(t), A.transcript_chunks(t)), ["video_id"],
        at="at_ms", anchor="start_ms", tolerance=C.GUIDE_TOLERANCE_MS,
    )


# ------------------------------------------------------------------ frames

_FRAMES = """
SELECT 'label' || label AS video_id, vec_id * 2000 AS ms, embedding,
       list_transform(embedding, lambda x: 128.0 + 36.0 * CAST(x AS DOUBLE)) AS gray FROM embeddings"""


def frames(t):
    """vectors as sampled frames, one course per label"""
    return t.embeddings.select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("video_id"),
        (F.col("vec_id") * 2000).alias("ms"),
        "embedding",
        F.transform("embedding", lambda x: F.lit(128.0) + F.lit(36.0) * x.cast("double")).alias("gray"),
    )


_DIFF = "list_sum(list_transform(list_zip(a.gray, b.gray), lambda p: abs(p[1] - p[2]))) / len(a.gray) / 255.0"

_GROUPS = f"""
WITH fr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ms) AS rn FROM ({_FRAMES})),
walk AS (
  SELECT video_id, rn, ms, rn AS ref, CAST(0 AS BIGINT) AS grp FROM fr WHERE rn = 1
  UNION ALL
  SELECT b.video_id, b.rn, b.ms, CASE WHEN cut THEN b.rn ELSE b.ref END, CASE WHEN cut THEN b.grp + 1 ELSE b.grp END
  FROM (SELECT b.video_id, b.rn, b.ms, w.ref, w.grp, ({_DIFF}) > 0.02 OR b.ms - a.ms > 120000 AS cut
        FROM walk w JOIN fr b ON b.video_id = w.video_id AND b.rn = w.rn + 1 JOIN fr a ON a.video_id = w.video_id AND a.rn = w.ref) b),
slides AS (SELECT video_id, grp, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY grp), greatest(last_ms + 2000, start_ms + 1000)) AS end_ms
  FROM (SELECT video_id, grp, min(ms) AS start_ms, max(max(ms)) OVER (PARTITION BY video_id) AS last_ms FROM walk GROUP BY video_id, grp))
---
"""


def frame_slides(t):
    f = frames(t)
    grouped = media.frame_groups(f)
    ends = f.groupBy("video_id").agg((F.max("ms") + 2000).alias("duration_ms"))
    return grouped, media.slides_of_groups(grouped, ends)


@query("frame_groups", "video_id string, grp long, start_ms long, end_ms long", _GROUPS + "SELECT * FROM slides")
def frame_groups(t):
    return frame_slides(t)[1]


@query("representative_frame", "video_id string, grp long, rep_ms long, frame_ms long", _GROUPS + """
SELECT video_id, grp, rep_ms, ms AS frame_ms FROM (
  SELECT s.video_id, s.grp, (s.start_ms + s.end_ms) // 2 AS rep_ms, w.ms, row_number() OVER (PARTITION BY s.video_id, s.grp ORDER BY abs(w.ms - (s.start_ms + s.end_ms) // 2), w.ms) AS rn
  FROM slides s JOIN walk w ON w.video_id = s.video_id AND w.grp = s.grp) WHERE rn = 1""")
def representative_frame(t):
    grouped, slides = frame_slides(t)
    return media.representative_frames(grouped, slides)


def _adjacent(t, *cols):
    """each frame with the one before it in its course, which may be of any length"""
    f = ordered.blocks(frames(t).select("video_id", "ms", *cols), ["video_id"], ["ms"])
    specs = {f"{c}_before": ("last", F.col(c)) for c in cols}
    return ordered.prefix(f, ["video_id"], ["ms"], specs).filter(F.col(f"{cols[0]}_before").isNotNull())


@query("frame_diff", "video_id string, ms long, diff double", f"""
SELECT b.video_id, b.ms, {_DIFF} AS diff FROM (
  SELECT video_id, ms, gray, lag(gray) OVER (PARTITION BY video_id ORDER BY ms) AS before FROM ({_FRAMES})) b,
  LATERAL (SELECT b.before AS gray) a WHERE b.before IS NOT NULL""")
def frame_diff(t):
    return _adjacent(t, "gray").withColumn("diff", vectors.mean_abs_diff(F.col("gray"), F.col("gray_before")))


_HASH = """
SELECT video_id, ms, bits, list_aggregate(list_transform(range(0, 16), lambda i:
  '0123456789abcdef'[1 + 8 * bits[4 * i + 1] + 4 * bits[4 * i + 2] + 2 * bits[4 * i + 3] + bits[4 * i + 4]]), 'string_agg', '') AS phash
FROM (SELECT video_id, ms, list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > list_sum(CAST(embedding AS DOUBLE[])) / len(embedding) THEN 1 ELSE 0 END) AS bits FROM ({}))"""


@query("average_hash_pairs", "video_id string, ms long, phash string, distance long", f"""
SELECT video_id, ms, phash, list_sum(list_transform(list_zip(bits, before), lambda p: abs(p[1] - p[2]))) AS distance FROM (
  SELECT *, lag(bits) OVER (PARTITION BY video_id ORDER BY ms) AS before FROM ({_HASH.format(_FRAMES)})) WHERE before IS NOT NULL""")
def average_hash_pairs(t):
    hashed = frames(t).select("video_id", "ms", vectors.average_hash(F.col("embedding")).alias("h"))
    blocked = ordered.blocks(hashed, ["video_id"], ["ms"])
    return (
        ordered.prefix(blocked, ["video_id"], ["ms"], {"before": ("last", F.col("h"))}).filter("before IS NOT NULL")
        .select("video_id", "ms", F.lpad(F.lower(F.hex("h")), 16, "0").alias("phash"), vectors.hamming(F.col("h"), F.col("before")).alias("distance"))
    )


@query("compact_lines", "doc_id long, compact string", """
SELECT doc_id, CASE WHEN length(c) <= 400 THEN c ELSE c[1:400] || '…' END AS compact FROM (
  SELECT doc_id, coalesce(list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ' / '), '') AS c FROM documents)""")
def compact_lines(t):
    return t.documents.select("doc_id", text.compact_lines(F.col("text")).alias("compact"))


# ------------------------------------------------------------------ recognition results and the whole pipeline


@query("asr_utterances", "user_id long, pos long, start_ms long, end_ms long, text string, speaker string, n_words long", """
SELECT user_id, pos, event_id * 10 AS start_ms, event_id * 10 + 5 AS end_ms, trim(event_type) AS text,
       CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS VARCHAR) END AS speaker, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id // 50 ORDER BY event_id) - 1 AS pos FROM events) WHERE event_type <> 'error'""")
def asr_utterances(t):
    n = F.col("event_id")
    words = F.array(
        F.struct(F.lit("a").alias("text"), F.when(n % 4 == 0, -1).otherwise(n * 10).alias("start_time"), (n * 10 + 2).alias("end_time"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit("b").alias("text"), (n * 10 + 2).alias("start_time"), (n * 10 + 5).alias("end_time"), F.lit(0.8).alias("confidence")),
    )
    u = F.struct(
        F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"),
        (n * 10).alias("start_time"), (n * 10 + 5).alias("end_time"),
        F.struct(F.when(n % 2 == 0, (n % 3).cast("string")).alias("speaker")).alias("additions"), words.alias("words"),
    )
    # a reply holds the sentences of one stretch of fifty events
    per = t.events.groupBy("user_id", F.floor(n / 50).alias("d")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), u.alias("u")))).alias("us"))
    replies = per.select("user_id", "d", F.to_json(F.struct(F.struct(F.transform("us", lambda x: x["u"]).alias("utterances")).alias("result"))).alias("json"))
    return speech.utterances(replies, ["user_id", "d"]).withColumn("n_words", F.size("words"))


_STRUCTURED = f"""
WITH latest AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY span_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM (SELECT *, span_start + start_ms AS s, span_start + end_ms AS e FROM ({_UTTERANCES}))),
sg AS (SELECT video_id, pos, s AS start_ms, e AS end_ms, CASE WHEN text LIKE 'error%' THEN text ELSE upper(string_split(text, ' ')[1]) || text[position(' ' IN text):] END AS text, CAST(pos % 4 AS VARCHAR) AS speaker,
  row_number() OVER (PARTITION BY video_id ORDER BY s, pos) - 1 AS idx FROM latest WHERE lt IS NULL OR e > lt),
rn AS (SELECT video_id, idx, start_ms, end_ms, start_ms AS rs, CAST(0 AS BIGINT) AS run FROM sg WHERE idx = 0 UNION ALL
  SELECT g.video_id, g.idx, g.start_ms, g.end_ms, CASE WHEN cut THEN g.start_ms ELSE g.rs END, CASE WHEN cut THEN g.run + 1 ELSE g.run END
  FROM (SELECT g.*, r.rs, r.run, (g.end_ms - r.rs >= 30000 AND g.start_ms - r.end_ms >= 1500) OR g.end_ms - r.rs >= 90000 AS cut FROM rn r JOIN sg g ON g.video_id = r.video_id AND g.idx = r.idx + 1) g),
ck AS (SELECT s.video_id, r.run AS idx, min(s.start_ms) AS start_ms, arg_max(s.end_ms, s.idx) AS end_ms, string_agg(CASE WHEN speaker IN ('0', '1') THEN text ELSE '[' || speaker || '] ' || text END, chr(10) ORDER BY s.idx) AS text
  FROM sg s JOIN rn r ON r.video_id = s.video_id AND r.idx = s.idx GROUP BY s.video_id, r.run),
cr AS (SELECT video_id, idx, start_ms, end_ms, start_ms AS rs, CAST(0 AS BIGINT) AS run FROM ck WHERE idx = 0 UNION ALL
  SELECT g.video_id, g.idx, g.start_ms, g.end_ms, CASE WHEN cut THEN g.start_ms ELSE g.rs END, CASE WHEN cut THEN g.run + 1 ELSE g.run END
  FROM (SELECT g.*, r.rs, r.run, g.start_ms - r.end_ms >= 60000 OR g.end_ms - r.rs >= 600000 AS cut FROM cr r JOIN ck g ON g.video_id = r.video_id AND g.idx = r.idx + 1) g),
sl AS (SELECT c.video_id, c.idx, count(s.slide_id) AS n FROM ck c LEFT JOIN v_slides s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms GROUP BY c.video_id, c.idx)
---
"""


def type_rules(t):
    """every kind of event but errors is written in capitals"""
    kinds = t.events.filter("event_type <> 'error'").select("event_type").distinct()
    return kinds.select(
        F.lit("").alias("video_id"), F.array("event_type").alias("wrong"), F.upper("event_type").alias("right"),
        F.lit("").alias("reason"), F.ascii("event_type").cast("long").alias("ord"),
    )


@query("structure_transcripts", "chunk_id string, parent_id string, start_ms long, end_ms long, n_slides long, text string", _STRUCTURED + """
SELECT c.video_id || '-c' || printf('%04d', c.idx) AS chunk_id, c.video_id || '-ch' || printf('%03d', cr.run) AS parent_id, c.start_ms, c.end_ms, sl.n AS n_slides, c.text
FROM ck c JOIN cr ON cr.video_id = c.video_id AND cr.idx = c.idx JOIN sl ON sl.video_id = c.video_id AND sl.idx = c.idx""")
def structure_transcripts(t):
    s = pipeline.structure(utterances(t), type_rules(t), A.slides(t), chapter_gap_ms=60_000, chapter_max_ms=600_000)
    return s.chunks.withColumn("n_slides", F.size("slide_idxs"))


@query("restructure_transcripts", "id string, change string, title string, summary string", _STRUCTURED + """
SELECT video_id || '-c' || printf('%04d', idx) AS id, CASE WHEN fresh THEN 'changed' ELSE 'kept' END AS change,
  CASE WHEN fresh THEN '' ELSE 'Teil ' || idx END AS title, CASE WHEN fresh THEN '' ELSE 'ab ' || start_ms END AS summary
FROM (SELECT c.*, (SELECT bool_or(s.text LIKE 'PURCHASE%') FROM sg s JOIN rn r ON r.video_id = s.video_id AND r.idx = s.idx WHERE r.video_id = c.video_id AND r.run = c.idx) AS fresh FROM ck c)
UNION ALL SELECT video_id || '-ch' || printf('%03d', run), 'chapter', 'Kapitel ' || run, 'ab ' || min(start_ms) FROM cr GROUP BY video_id, run""")
def restructure_transcripts(t):
    """Courses built before one rule was known are built again: titles stay where the text does."""
    spans, slides, limits = utterances(t), A.slides(t), {"chapter_gap_ms": 60_000, "chapter_max_ms": 600_000}
    label = F.concat(F.lit("ab "), F.col("start_ms").cast("string")).alias("summary")

    def titled(rows, word, *columns):
        return settle(rows.select("video_id", *columns, F.concat(F.lit(word), F.col("idx").cast("string")).alias("title"), label))

    before = pipeline.structure(spans, type_rules(t).filter("wrong[0] <> 'purchase'"), slides, **limits)
    now = pipeline.structure(
        spans, type_rules(t), slides, **limits,
        old_chunks=titled(before.chunks, "Teil ", "chunk_id", "text"), old_chapters=titled(before.chapters, "Kapitel ", "chapter_id"),
    )
    chunks = now.chunks.join(now.changes, ["video_id", "chunk_id"])
    return chunks.select(F.col("chunk_id").alias("id"), "change", "title", "summary").unionByName(
        now.chapters.select(F.col("chapter_id").alias("id"), F.lit("chapter").alias("change"), "title", "summary")
    )


@query("refresh_ocr", "chunk_id string, ocr_text string", """
WITH linked AS (SELECT c.chunk_id, s.slide_id, s.ocr_text FROM v_chunks c JOIN v_slides s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms)
---
SELECT chunk_id, string_agg(replace(ocr_text, 'view', 'VIEW'), chr(10) ORDER BY slide_id) AS ocr_text FROM linked GROUP BY chunk_id""")
def refresh_ocr(t):
    slides = A.slides(t)
    return pipeline.refresh_ocr(seg.attach_slides(A.transcript_chunks(t), slides), slides, type_rules(t))
