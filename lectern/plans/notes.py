"""Reply, notes, quiz and hook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import replies as RP, text as X
from lectern.operators import context as CX, ledger, notes as N, quiz as Q, retrieval as R
from lectern.plans import adapters as A, glossary as GP, hooks, shelves
from lectern.plans.context import label_sql
from lectern.plans.registry import query
from lectern.plans.views import VIEWS
from lectern.session import work_path, written

# ------------------------------------------------------------------ replies
# Every message becomes a model reply: its words in odd places are the title and terms, those in even places the summary.

VIEWS["r_json"] = r"""
SELECT id, w1, w2, '{"title": " ' || w1 || ' ", "summary": "' || w2 || '", "key_points": ["' || w1 || '", " "], "concepts": [{"term": "' || w1 || '", "definition": "' || w2 || '"}, {"term": "' || w2 || '"}], "outline": [{"chapter": "' || w1 || '", "points": ["' || w2 || '", "z"]}, {"points": ["q"]}]}' AS j
FROM (SELECT id, coalesce(nullif(array_to_string(f[1:len(f):2], ' '), ''), 'one') AS w1, coalesce(nullif(array_to_string(f[2:len(f):2], ' '), ''), 'two') AS w2 FROM (SELECT id, regexp_extract_all(content, '[A-Za-z]+') AS f FROM v_messages))"""


def halves(content, first, second):
    """The words in odd and in even places of a text, or the given ones."""
    words = F.regexp_extract_all(content, F.lit("[A-Za-z]+"), F.lit(0))
    part = lambda odd, other: F.coalesce(F.nullif(F.array_join(F.filter(words, lambda _, i: i % 2 == odd), " "), F.lit("")), F.lit(other))
    return part(0, first), part(1, second)


def built(t):
    w1, w2 = halves("content", "one", "two")
    w = A.messages(t).select("id", w1.alias("w1"), w2.alias("w2"))
    pieces = [
        F.lit('{"title": " '), "w1", F.lit(' ", "summary": "'), "w2", F.lit('", "key_points": ["'), "w1", F.lit('", " "], "concepts": [{"term": "'), "w1",
        F.lit('", "definition": "'), "w2", F.lit('"}, {"term": "'), "w2", F.lit('"}], "outline": [{"chapter": "'), "w1", F.lit('", "points": ["'), "w2",
        F.lit('", "z"]}, {"points": ["q"]}]}'),
    ]
    return w.withColumn("j", F.concat(*pieces))


@query("json_salvage", "id long, found string", """
SELECT id, CASE id % 5 WHEN 4 THEN NULL WHEN 3 THEN '[' || j || ']' ELSE j END AS found FROM r_json""")
def json_salvage(t):
    n = F.col("id") % 5
    raw = (
        F.when(n == 0, F.concat(F.lit("Sure:\n```json\n"), "j", F.lit("\n```\nbye {x}")))
        .when(n == 1, F.col("j")).when(n == 2, F.concat(F.lit("Answer: "), "j", F.lit(" done")))
        .when(n == 3, F.concat(F.lit("["), "j", F.lit("]")))
        .otherwise(F.concat(F.lit("nothing {"), "w1"))
    )
    return built(t).select("id", RP.salvage_json(raw).alias("found"))


@query("summary_replies", "id long, title string, summary string, n_concepts long, chapter string, course string", """
SELECT id, w1[1:40] AS title, w2 AS summary, 1 AS n_concepts, w2 || chr(10) || chr(10) || '要点：' || chr(10) || '- ' || w1 AS chapter, w2 || chr(10) || chr(10) || '大纲：' || chr(10) || '- ' || w1 || '：' || w2 || '；z' AS course FROM r_json""")
def summary_replies(t):
    n = F.col("id") % 4
    wrapped = (
        F.when(n == 0, F.concat(F.lit("["), "j", F.lit("]")))
        .when(n == 1, F.concat(F.lit('[1, "{no}", [2], '), "j", F.lit(', {"title": "second"}]'))).otherwise(F.col("j"))
    )
    obj = built(t).select("id", RP.as_object(RP.salvage_json(wrapped)).alias("o"))
    s = RP.summary_fields(F.col("o"))
    return obj.select("id", s["title"].alias("title"), s["summary"].alias("summary"), F.size(s["concepts"]).alias("n_concepts"), RP.chapter_summary(F.col("o")).alias("chapter"), RP.course_summary(F.col("o")).alias("course"))


@query("reply_usage", "event_id long, prompt long, completion long, cached long", """
SELECT event_id, prompt_tokens AS prompt, completion_tokens AS completion, CASE event_id % 4 WHEN 3 THEN 0 ELSE cached_tokens END AS cached FROM v_calls""")
def reply_usage(t):
    n = F.col("event_id") % 4
    cached = F.col("cached_tokens").cast("string")
    extra = (
        F.when(n == 0, F.concat(F.lit(', "prompt_cache_hit_tokens": '), cached))
        .when(n == 1, F.concat(F.lit(', "cached_tokens": '), cached))
        .when(n == 2, F.concat(F.lit(', "cached_tokens": 0, "prompt_tokens_details": {"cached_tokens": '), cached, F.lit("}"))).otherwise("")
    )
    raw = F.concat(F.lit('{"prompt_tokens": '), F.col("prompt_tokens").cast("string"), F.lit(', "completion_tokens": '), F.col("completion_tokens").cast("string"), extra, F.lit("}"))
    return A.calls(t).select("event_id", RP.usage_fields(raw).alias("u")).select("event_id", "u.prompt", "u.completion", "u.cached")


@query("reply_flags", "event_id long, truncated boolean", "SELECT event_id, event_id % 6 = 0 AS truncated FROM events")
def reply_flags(t):
    reason = F.when(F.col("event_id") % 6 == 0, "length").when(F.col("event_id") % 6 == 1, F.lit(None)).otherwise("stop")
    return t.events.select("event_id", RP.truncated(reason).alias("truncated"))


@query("priced_replies", "event_id long, kind string, prompt_tokens long, cost double:9", """
SELECT event_id, 'ask' AS kind, prompt_tokens, cost FROM v_usage""")
def priced_replies(t):
    calls = A.calls(t)
    raw = F.to_json(F.struct("prompt_tokens", "cached_tokens", "completion_tokens"))
    parsed = calls.select("event_id", F.col("at"), "model", RP.usage_fields(raw).alias("u")).select(
        "event_id", "at", "model", F.lit("ask").alias("kind"), F.col("u.prompt").alias("prompt_tokens"),
        F.col("u.cached").alias("cached_tokens"), F.col("u.completion").alias("completion_tokens"),
    )
    return ledger.price_calls(parsed)


@query("reply_deltas", "reply_id long, text string, finish_reason string, total_tokens long", r"""
SELECT id AS reply_id, trim(content, chr(10) || ' ') AS text, CASE WHEN id % 4 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, len(string_split(content, ' ')) - 1 AS total_tokens FROM v_messages""")
def reply_deltas(t):
    from lectern.streaming import jobs

    return jobs.gather_deltas(deltas(A.messages(t)))


def deltas(messages):
    """messages word by word, as a model would stream them"""
    words = F.split("content", " ")
    parts = messages.select(
        F.col("id").alias("reply_id"), "id", F.timestamp_seconds("created_s").alias("at"),
        F.posexplode(words).alias("seq", "w"), F.size(words).alias("n"),
    )
    last = F.col("seq") == F.col("n") - 1
    return parts.select(
        "reply_id", "at", "seq", F.when(last, F.col("w")).otherwise(F.concat("w", F.lit(" "))).alias("delta"),
        F.when(last & (F.col("id") % 4 == 0), "length").alias("finish_reason"),
        F.when(F.col("seq") % 3 != 1, F.col("seq")).alias("_u"), "n",
    ).withColumn("total_tokens", F.when(last, F.col("seq")).otherwise(F.col("_u")).cast("long"))


_DEGRADED = """
SELECT video_id, n > 0 AND (s = 0 OR f >= greatest(3, s // 2 + 1)) AS degraded FROM (
  SELECT video_id, count(*) AS n, count(*) FILTER (idx % 2 = 0 OR CAST(video_id[4:] AS BIGINT) % 2 = 0) AS s, count(*) FILTER (idx % 4 = 0 OR (CAST(video_id[4:] AS BIGINT) % 4 = 0 AND idx % 5 <> 0)) AS f FROM v_doc_chapters GROUP BY video_id)"""


@query("degrade_flag", "video_id string, degraded boolean", _DEGRADED)
def degrade_flag(t):
    course, n = F.substring("video_id", 4, 10).cast("long"), F.col("idx")
    c = A.doc_chapters(t).groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if((n % 2 == 0) | (course % 2 == 0)).alias("s"),
        F.count_if((n % 4 == 0) | ((course % 4 == 0) & (n % 5 != 0))).alias("f"),
    )
    return c.select("video_id", RP.degraded(F.col("n"), F.col("s"), F.col("f")).alias("degraded"))


@query("failure_note", "video_id string, note string", """
SELECT video_id, CASE WHEN c = 0 AND h = 0 AND NOT v THEN '' ELSE '摘要生成部分失败（' || concat_ws('、', CASE WHEN c > 0 THEN c || ' 个片段' END, CASE WHEN h > 0 THEN h || ' 个章节' END, CASE WHEN v THEN '全课摘要' END) || '），转写与检索不受影响。可重跑入库补齐。' END AS note
FROM (SELECT video_id, count(*) FILTER (length(text) > 20000) AS c, count(*) FILTER (length(text) > 25000) AS h, max(length(text)) > 30000 AS v FROM v_docs GROUP BY video_id)""")
def failure_note(t):
    n = F.length("text")
    c = A.docs(t).groupBy("video_id").agg(F.count_if(n > 20000).alias("c"), F.count_if(n > 25000).alias("h"), (F.max(n) > 30000).alias("v"))
    return c.select("video_id", RP.failure_note(F.col("c"), F.col("h"), F.col("v")).alias("note"))


# ------------------------------------------------------------------ guides
# A guide per message: its lines, every second one followed by a time line.

VIEWS["g_lines"] = r"""
SELECT id AS gid, video_id, 2 * i AS pos, rtrim(line) AS line, CAST(NULL AS BIGINT) AS t1, CAST(NULL AS BIGINT) AS t2 FROM (SELECT id, video_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT id, video_id, string_split(content, chr(10)) AS ls FROM v_messages))
UNION ALL SELECT id, video_id, 2 * i + 1, NULL, (id + i * 13) % 200, (id * 7 + i) % 200 FROM (SELECT id, video_id, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, video_id, string_split(content, chr(10)) AS ls FROM v_messages)) WHERE i % 2 = 0"""


def guides(t):
    n = F.col("id")

    def line(x, i):
        k = i + 1
        m1, m2 = (n + k * 13) % 200, (n * 7 + k) % 200
        cite = F.concat(F.lit("\n> **时间 "), F.format_string("%02d:30", m1), F.lit("、"), F.format_string("%02d:05", m2), F.lit("**"))
        return F.when(k % 2 == 0, F.concat(x, cite)).otherwise(x)

    body = F.array_join(F.transform(F.split("content", "\n"), line), "\n")
    return A.messages(t).select(n.alias("gid"), "video_id", F.concat(F.lit("## 学习导读\n"), body).alias("text"))


def _anchors(t):
    d = A.docs(t).select("video_id", "start_ms")
    return d.unionByName(A.doc_chapters(t).select("video_id", "start_ms")).distinct()


_GUIDES = """
WITH b AS (SELECT *, count(t1) OVER (PARTITION BY gid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM g_lines),
tm AS (SELECT gid, video_id, block, 0 AS k, t1 AS m, 30 AS s FROM b WHERE t1 IS NOT NULL UNION ALL SELECT gid, video_id, block, 1, t2, 5 FROM b WHERE t1 IS NOT NULL),
ok AS (SELECT gid, block, string_agg(printf('%02d:%02d', m, s), '、' ORDER BY k) AS valid FROM tm WHERE EXISTS (SELECT 1 FROM v_docs d WHERE d.video_id = tm.video_id AND abs(d.start_ms - (m * 60 + s) * 1000) <= 15000) GROUP BY gid, block),
bl AS (SELECT b.gid, b.block, max(ok.valid) AS valid, string_agg(b.line, chr(10) ORDER BY pos) AS body FROM b LEFT JOIN ok ON ok.gid = b.gid AND ok.block = b.block GROUP BY b.gid, b.block HAVING count(b.t1) > 0)
---
SELECT gid, coalesce(string_agg(trim(CASE WHEN body IS NULL THEN '' ELSE body || chr(10) END || '> 时间 ' || valid, chr(10) || ' '), chr(10) || chr(10) ORDER BY block) FILTER (valid IS NOT NULL), '') AS text, count(valid) AS kept, count(block) FILTER (valid IS NULL) AS dropped FROM (SELECT DISTINCT gid FROM g_lines) g LEFT JOIN bl USING (gid) GROUP BY gid"""


@query("guide_verify", "gid long, text string, kept long, dropped long", _GUIDES)
def guide_verify(t):
    return N.verify_guides(guides(t), _anchors(t))


@query("unverified_terms", "gid long, term string", r"""
WITH g AS (SELECT id AS gid, video_id, content || ' `zzq term`' AS text FROM v_messages),
tr AS (SELECT DISTINCT gid, video_id, term FROM (SELECT gid, video_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.$\[\]]{2,}'), lambda w: length(w) >= 4)) AS term FROM g UNION ALL SELECT gid, video_id, trim(unnest(regexp_extract_all(text, '`([^`]+)`', 1))) FROM g)),
mat AS (SELECT video_id, lower(string_agg(text, chr(10))) AS m FROM v_docs GROUP BY video_id)
---
SELECT gid, term FROM tr JOIN mat ON mat.video_id = tr.video_id WHERE NOT contains(m, lower(term))""")
def unverified_terms(t):
    g = A.messages(t).select(F.col("id").alias("gid"), "video_id", F.concat("content", F.lit(" `zzq term`")).alias("text"))
    return N.unverified_terms(g, A.docs(t).select("video_id", "text"))


# ------------------------------------------------------------------ terms and roll-ups

_CONCEPTS = r"""
SELECT video_id, CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS source, CASE WHEN i % 3 = 0 THEN 0 ELSE idx END AS idx, CASE WHEN i % 3 = 0 THEN idx * 1000 + i ELSE i END AS pos, w AS term, line AS definition, CASE WHEN i % 3 = 0 THEN NULL ELSE start_ms END AS start_ms
FROM (SELECT *, unnest(regexp_extract_all(line, '[A-Za-z]{4,}')) AS w FROM (SELECT video_id, idx, start_ms, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT video_id, idx, start_ms, string_split(text, chr(10)) AS ls FROM v_docs)))"""


def concepts(t):
    rows = A.docs(t).select("video_id", "idx", "start_ms", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = F.col("i") + 1
    whole = k % 3 == 0
    return rows.select(
        "video_id", F.when(whole, 1).otherwise(0).alias("source"), F.when(whole, F.lit(0)).otherwise(F.col("idx")).cast("long").alias("idx"),
        F.when(whole, F.col("idx") * 1000 + k).otherwise(k).cast("long").alias("pos"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("term"),
        F.col("line").alias("definition"), F.when(~whole, F.col("start_ms")).alias("start_ms"),
    )


@query("concept_merge", "video_id string, term string, definition string, start_ms long", f"""
SELECT video_id, term, definition, start_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id, term ORDER BY source, idx, pos) AS rn FROM ({_CONCEPTS})) WHERE rn = 1""")
def concept_merge(t):
    return N.merge_concepts(concepts(t))


@query("concept_export", "video_id string, line string", f"""
SELECT video_id, '- **' || term || '**（' || {label_sql('coalesce(start_ms, 0)')} || '）：' || definition AS line FROM (SELECT *, row_number() OVER (PARTITION BY video_id, term ORDER BY source, idx, pos) AS rn FROM ({_CONCEPTS})) WHERE rn = 1""")
def concept_export(t):
    return N.concept_lines(N.merge_concepts(concepts(t)))


_TERMS = r"""
SELECT * FROM (SELECT video_id, term, definition[1:200] AS definition, row_number() OVER (PARTITION BY video_id ORDER BY idx, pos) - 1 AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, term ORDER BY idx, pos) AS rn FROM (
    SELECT video_id, idx, i AS pos, trim(line[1:position(' ' IN line) - 1], ' -•*') AS term, trim(line[position(' ' IN line) + 1:]) AS definition
    FROM (SELECT video_id, idx, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT video_id, idx, string_split(text, chr(10)) AS ls FROM v_docs)) WHERE position(' ' IN line) > 0)
  WHERE length(term) BETWEEN 2 AND 20 AND definition <> '') WHERE rn = 1) WHERE rank < 60"""


def termed(t):
    rows = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), "^([^ ]*) ", "$1："))
    return A.docs(t).select("video_id", "idx", F.array_join(rows, "\n").alias("summary"))


@query("term_table", "video_id string, term string, definition string, rank long", _TERMS)
def term_table(t):
    return N.term_table(termed(t))


@query("rollup_text", "video_id string, parent_id string, body string", f"""
SELECT video_id, parent_id, string_agg('- [' || {label_sql('start_ms')} || '] ' || CASE WHEN title <> '' THEN title ELSE {label_sql('start_ms')} END || '：' || CASE WHEN summary <> '' THEN summary WHEN length(text) <= 200 THEN text ELSE text[1:200] || '…' END, chr(10) ORDER BY idx) AS body FROM v_docs GROUP BY video_id, parent_id""")
def rollup_text(t):
    return N.chapter_bodies(A.docs(t))


@query("course_rollup", "video_id string, idx long, line string", f"""
SELECT video_id, -1 AS idx, '课程原名：' || title || chr(10) || '总时长：' || {label_sql('CAST(duration_ms AS BIGINT)')} AS line FROM v_courses
UNION ALL SELECT video_id, idx, chr(10) || '## ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || ' [' || {label_sql('start_ms')} || '-' || {label_sql('end_ms')} || ']' || chr(10) || CASE WHEN summary = '' THEN '（无摘要）' ELSE summary END FROM v_doc_chapters""")
def course_rollup(t):
    return N.course_bodies(A.courses(t), A.doc_chapters(t)).orderBy("video_id", "idx")


_NOTES = f"""
WITH nt AS (SELECT parent_id, arg_min(text, idx) AS note FROM v_docs GROUP BY parent_id),
ch AS (SELECT *, CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END AS ttl FROM v_doc_chapters)
---
SELECT c.video_id, 0 AS part, 0 AS idx, '# ' || c.title || chr(10) || chr(10) || '> 总时长 ' || {label_sql('CAST(c.duration_ms AS BIGINT)')} || '　·　' || (SELECT count(*) FROM ch WHERE ch.video_id = c.video_id) || ' 章' AS text FROM v_courses c
UNION ALL SELECT video_id, 1, idx, '| ' || ttl || ' | ' || {label_sql('start_ms')} || ' | ' || trim(summary) || ' |' FROM ch
UNION ALL SELECT video_id, 2, idx, chr(10) || '---' || chr(10) || chr(10) || '## ' || (idx + 1) || '. ' || ttl || chr(10) || chr(10) || '`' || {label_sql('start_ms')} || ' - ' || {label_sql('end_ms')} || '`' || chr(10) || chr(10) || trim(note, chr(10) || ' ') FROM ch JOIN nt ON nt.parent_id = ch.chapter_id
UNION ALL SELECT video_id, 3, rank, '| ' || term || ' | ' || definition || ' |' FROM ({_TERMS})"""


@query("notes_document", "video_id string, part long, idx long, text string", _NOTES)
def notes_document(t):
    # chapters are told apart by number; those that share a name have the first text under that name as their note
    chapters = A.numbered_chapters(t)[0]
    notes = A.docs(t).groupBy(F.col("parent_id").alias("name")).agg(F.min_by("text", "idx").alias("_t"))
    titled = chapters.select("chapter_id", "name", X.chapter_title(F.col("title"), F.col("idx")).alias("_h")).join(notes, "name")
    notes = titled.select("chapter_id", F.concat(F.lit("## "), "_h", F.lit("\n\n"), "_t").alias("note"))
    return N.document_rows(A.courses(t), chapters, notes, N.term_table(termed(t)))


# Every course is written twice; where most chapters of the second run failed, the first document stays.
VIEWS["n_plain"] = _NOTES.replace("\n---\n", "\n")
VIEWS["n_degraded"] = _DEGRADED


@query("notes_stored", "version string, video_id string, part long, idx long, text string", """
SELECT 'now' AS version, n.video_id, part, idx, CASE WHEN d.degraded THEN text ELSE text || ' (2)' END AS text FROM n_plain n LEFT JOIN n_degraded d ON d.video_id = n.video_id
UNION ALL SELECT 'previous', n.video_id, part, idx, text FROM n_plain n LEFT JOIN n_degraded d ON d.video_id = n.video_id WHERE d.degraded IS NOT TRUE""")
def notes_stored(t):
    folder, first = work_path(t.spark, "notes"), written(notes_document(t), "first")
    N.write_documents(first, folder, degrade_flag(t))
    N.write_documents(first.withColumn("text", F.concat("text", F.lit(" (2)"))), folder, degrade_flag(t))
    versions = [N.read_documents(t.spark, folder, v).withColumn("version", F.lit(v)) for v in ("now", "previous")]
    return versions[0].unionByName(versions[1])


# The document with its last guide and the terms to confirm; the note of a chapter is all its chunks.
VIEWS["n_guides"] = _GUIDES.replace("\n---\n", "\n")
VIEWS["n_rows"] = rf"""
SELECT c.video_id, 0 AS part, 0 AS idx, '# ' || c.title || chr(10) || chr(10) || '> 总时长 ' || {label_sql('CAST(c.duration_ms AS BIGINT)')} || '　·　' || (SELECT count(*) FROM v_doc_chapters h WHERE h.video_id = c.video_id) || ' 章' AS text FROM v_courses c
UNION ALL SELECT video_id, 0, 1, chr(10) || '## 学习导读' || chr(10) || chr(10) || text FROM (SELECT m.video_id, arg_max(g.text, g.gid) AS text, arg_max(g.kept, g.gid) AS kept FROM n_guides g JOIN v_messages m ON m.id = g.gid GROUP BY m.video_id)
  WHERE kept > 0 AND video_id IN (SELECT video_id FROM v_doc_chapters)
UNION ALL SELECT video_id, 1, idx, '| ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || ' | ' || {label_sql('start_ms')} || ' | ' || trim(summary) || ' |' FROM v_doc_chapters
UNION ALL SELECT video_id, 2, idx, chr(10) || '---' || chr(10) || chr(10) || '## ' || (idx + 1) || '. ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || chr(10) || chr(10) || '`' || {label_sql('start_ms')} || ' - ' || {label_sql('end_ms')} || '`' || chr(10) || chr(10) || regexp_replace(note, '^\s+|\s+$', '', 'g')
  FROM v_doc_chapters h JOIN (SELECT parent_id, string_agg(text, chr(10) ORDER BY idx) AS note FROM v_docs GROUP BY parent_id) n ON n.parent_id = h.chapter_id
UNION ALL SELECT video_id, 3, rank, '| ' || term || ' | ' || definition || ' |' FROM ({_TERMS})"""
# rows stand apart, so that no term spans two of them
VIEWS["n_text"] = "SELECT video_id AS page_id, string_agg(text, chr(10) || '¦' || chr(10) ORDER BY part, idx) AS body FROM n_rows GROUP BY video_id"
VIEWS["n_found"] = f"WITH f AS ({GP._FLAGS.replace('v_page_text', 'n_text')}) SELECT page_id AS video_id, term, kind, n FROM f WHERE kind <> 'listed' OR NOT EXISTS (SELECT 1 FROM f o WHERE o.page_id = f.page_id AND o.kind <> 'listed' AND contains(o.term, f.term))"


@query("notes_complete", "video_id string, part long, idx long, text string", """
SELECT * FROM n_rows
UNION ALL SELECT DISTINCT video_id, 4, 0, chr(10) || '## 待人工确认的术语' || chr(10) || chr(10) || '> 以下术语**未做自动替换**：它们可能是转写听错，也可能本来就是对的。' || chr(10) || chr(10) || '| 术语 | 类型 | 说明 | 出现次数 |' || chr(10) || '|---|---|---|---|' FROM n_found
UNION ALL SELECT video_id, 4, row_number() OVER (PARTITION BY video_id ORDER BY k, term), '| `' || replace(term, '|', '\\|') || '` | ' || ['转写噪音', '疑为听错', '拼写不一致', '已标记'][k] || ' | '
  || ['疑似转写噪音，请对照视频确认原词', '被当成专有名词引用，请确认是否为听错的词', '同一实体两种拼写，必有一处是错的', '术语表标记为待确认'][k] || ' | ' || n || ' |'
  FROM (SELECT *, list_position(['spaced_letters', 'quoted_phrase', 'inconsistent', 'listed'], kind) AS k FROM n_found)""")
def notes_complete(t):
    last = A.messages(t).select(F.col("id").alias("gid"), "video_id").join(N.verify_guides(guides(t), _anchors(t)), "gid")
    last = last.groupBy("video_id").agg(F.max_by("text", "gid").alias("text"), F.max_by("kept", "gid").alias("kept"))
    whole = CX.joined(A.docs(t), ["parent_id"], ["idx"], "text", "\n", "note").withColumnRenamed("parent_id", "chapter_id")
    # a note is read where it is gathered: under the chapters that share its name it stands only in the result
    whole, chapters = written(whole, "notes", long_rows=True), written(A.doc_chapters(t), "chapters")
    around = written(N.around_sections(A.courses(t), chapters, N.term_table(termed(t)), last), "around")
    texts = around.withColumn("piece", F.lit(0)).withColumn("times", F.lit(1).cast("long")).unionByName(N.section_texts(chapters, whole))
    document = around.unionByName(N.sections(chapters, whole))
    return N.with_findings(document, GP.suspects(t), written(texts, "texts", long_rows=True))


# ------------------------------------------------------------------ quizzes
# A quiz per session; a question per message; some options are blank, some answers out of range.

VIEWS["q_items"] = r"""
SELECT session_id AS quiz_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n0, array_to_string(f[1:len(f):2], ' ') AS stem, ['a', 'B ', 'c', 'd', 'e'][id % 5 + 1] AS answer, id % 4 AS odd, coalesce(nullif(array_to_string(f[2:len(f):2], ' '), ''), 'x') AS w2
FROM (SELECT session_id, id, regexp_extract_all(content, '[A-Za-z]+') AS f FROM v_messages)"""
VIEWS["q_good"] = """
SELECT quiz_id, id, stem, upper(trim(answer)) AS answer, odd, w2, 'q' || row_number() OVER (PARTITION BY quiz_id ORDER BY n0) AS qid, row_number() OVER (PARTITION BY quiz_id ORDER BY n0) AS rn
FROM q_items WHERE stem <> '' AND odd <> 3 AND answer <> 'e'"""


def generated(t):
    stem, w2 = halves("content", "", "x")
    m = A.messages(t)
    n = F.col("id")
    choice = F.element_at(F.array(*[F.lit(x) for x in ("a", "B ", "c", "d", "e")]), (n % 5 + 1).cast("int"))
    options = F.create_map(F.lit("A"), F.concat(F.lit(" "), w2), F.lit("B"), F.lit("b"), F.lit("C"), F.lit("c"), F.lit("D"), F.when(n % 4 == 3, " ").otherwise("d"))
    q = F.struct(
        F.lit("x").alias("id"), stem.alias("stem"), options.alias("options"), choice.alias("answer"),
        F.lit(None).cast("string").alias("explanation"), F.when(n % 3 == 0, "-5").when(n % 3 == 1, "oops").otherwise(F.lit("7000")).alias("start_ms"),
    )
    # a session is one conversation; its questions are one model reply
    return m.groupBy(F.col("session_id").alias("quiz_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.to_json(q).alias("q")))), lambda x: F.from_json(x["q"], Q.QUESTION)).alias("raw")
    ).withColumn("asked", F.when(F.col("quiz_id") % 2 == 0, 4).otherwise(F.lit(None)).cast("int"))


@query("quiz_validate", "quiz_id long, n_questions long, ok boolean", """
SELECT quiz_id, least(n, w) AS n_questions, least(n, w) >= 3 AS ok FROM (
  SELECT i.quiz_id, CASE WHEN i.quiz_id % 2 = 0 THEN 4 ELSE 8 END AS w, count(g.qid) AS n FROM (SELECT DISTINCT quiz_id FROM q_items) i LEFT JOIN q_good g ON g.quiz_id = i.quiz_id GROUP BY i.quiz_id)""")
def quiz_validate(t):
    return Q.validate(generated(t)).withColumn("n_questions", F.size("questions"))


@query("quiz_publish", "quiz_id long, qid string, stem string, opt_a string, start_ms long", """
SELECT quiz_id, qid, stem, w2 AS opt_a, CASE id % 3 WHEN 2 THEN 7000 ELSE 0 END AS start_ms FROM q_good WHERE rn <= CASE WHEN quiz_id % 2 = 0 THEN 4 ELSE 8 END""")
def quiz_publish(t):
    q = Q.validate(generated(t)).select("quiz_id", F.explode(Q.public(F.col("questions"))).alias("q"))
    return q.select("quiz_id", F.col("q.id").alias("qid"), "q.stem", F.col("q.options")["A"].alias("opt_a"), "q.start_ms")


_DETAILS = """
SELECT quiz_id, qid, answer, CASE rn % 3 WHEN 0 THEN '' WHEN 1 THEN answer ELSE 'A' END AS chosen, CASE rn % 3 WHEN 0 THEN '' WHEN 1 THEN answer ELSE 'A' END = answer AS correct
FROM q_good WHERE rn <= CASE WHEN quiz_id % 2 = 0 THEN 4 ELSE 8 END"""


def graded(t):
    quizzes = Q.validate(generated(t))
    pub = quizzes.select("quiz_id", F.posexplode("questions").alias("i", "q"))
    k = (F.col("i") + 1) % 3
    answers = pub.filter(k != 0).select("quiz_id", F.col("q.id").alias("id"), F.when(k == 1, F.concat(F.lit(" "), F.lower("q.answer"))).otherwise("a").alias("choice"))
    return Q.grade_details(quizzes, answers)


@query("quiz_grade", "quiz_id long, qid string, chosen string, answer string, correct boolean", _DETAILS)
def quiz_grade(t):
    return graded(t).withColumnRenamed("id", "qid")


@query("quiz_score", "quiz_id long, total long, correct_n long, score double", f"""
SELECT quiz_id, count(*) AS total, count(*) FILTER (correct) AS correct_n, round(count(*) FILTER (correct) / count(*) * 100, 1) AS score FROM ({_DETAILS}) GROUP BY quiz_id""")
def quiz_score(t):
    return Q.grade(graded(t))


@query("quiz_flow", "ok boolean, n_quizzes long, n_questions long, n_correct long", f"""
SELECT v.w <= v.n AS ok, count(*) AS n_quizzes, sum(n) AS n_questions, coalesce(sum(c), 0) AS n_correct FROM (
  SELECT i.quiz_id, least(count(g.qid), CASE WHEN i.quiz_id % 2 = 0 THEN 4 ELSE 8 END) AS n, 3 AS w FROM (SELECT DISTINCT quiz_id FROM q_items) i LEFT JOIN q_good g ON g.quiz_id = i.quiz_id GROUP BY i.quiz_id) v
LEFT JOIN (SELECT quiz_id, count(*) FILTER (correct) AS c FROM ({_DETAILS}) GROUP BY quiz_id) s ON s.quiz_id = v.quiz_id GROUP BY 1""")
def quiz_flow(t):
    v = Q.validate(generated(t)).withColumn("n", F.size("questions"))
    return v.join(Q.grade(graded(t)), "quiz_id", "left").groupBy("ok").agg(
        F.count("*").alias("n_quizzes"), F.sum("n").alias("n_questions"), F.coalesce(F.sum("correct_n"), F.lit(0)).alias("n_correct")
    )


@query("quiz_store", "quiz_id long, question_count long, parsed boolean", """
SELECT i.quiz_id, CASE WHEN i.quiz_id % 7 = 0 THEN 0 ELSE least(count(g.qid), CASE WHEN i.quiz_id % 2 = 0 THEN 4 ELSE 8 END) END AS question_count, i.quiz_id % 7 <> 0 AS parsed
FROM (SELECT DISTINCT quiz_id FROM q_items) i LEFT JOIN q_good g ON g.quiz_id = i.quiz_id GROUP BY i.quiz_id""")
def quiz_store(t):
    from lectern.operators import library as L

    v = Q.validate(generated(t))
    payload = F.when(F.col("quiz_id") % 7 == 0, "{bad").otherwise(F.to_json(F.struct("quiz_id", "questions")))
    new = v.select("quiz_id", payload.alias("payload"), F.lit(2).alias("v"))
    old = v.select("quiz_id", F.lit("{}").alias("payload"), F.lit(1).alias("v"))
    kept = L.upsert(old, new, ["quiz_id"], "v")
    body = F.from_json("payload", f"quiz_id bigint, questions array<{Q.QUESTION}>")
    n = F.when(body["quiz_id"].isNull(), 0).otherwise(F.coalesce(F.size(body["questions"]), F.lit(0)))
    return kept.select("quiz_id", n.alias("question_count"), F.try_parse_json("payload").isNotNull().alias("parsed"))


# ------------------------------------------------------------------ hooks


@query("embed_hook", "chunk_id string, dim long, length_sq double, first double", """
SELECT chunk_id, 2 AS dim, 1 AS length_sq, CASE WHEN length(text) % 2 = 0 THEN 0.6 ELSE 0 END AS first FROM v_docs""")
def embed_hook(t):
    from lectern.functions import vectors

    v = A.docs(t).select("chunk_id", hooks.embedder(hooks.parity)(F.col("text")).alias("vec"))
    return v.select("chunk_id", F.size("vec").alias("dim"), vectors.dot(F.col("vec"), F.col("vec")).alias("length_sq"), F.get("vec", F.lit(0)).alias("first"))


@query("rerank_hook", "qid long, chunk_id string, rank long", """
WITH h AS (SELECT * FROM (SELECT qid, chunk_id, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS old FROM v_vector_hits) WHERE old < 12)
---
SELECT h.qid, h.chunk_id, row_number() OVER (PARTITION BY h.qid ORDER BY h.qid % 5 = 0, CASE WHEN h.qid % 5 <> 0 THEN length(d.text) % 89 END DESC, old) - 1 AS rank FROM h JOIN v_docs d ON d.chunk_id = h.chunk_id""")
def rerank_hook(t):
    hits = R.vector_hits(shelves.vector_packs(t, lambda: A.vectors(t)), A.question_vectors(t), 12, "rank")
    heads = hits.join(A.docs(t).select("chunk_id", "text"), "chunk_id").withColumn("question", F.col("qid").cast("string"))
    return R.rerank(hits, hooks.rerank_scores(heads, hooks.length_mod))
