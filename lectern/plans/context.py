"""Budget and prompt material queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import clock, text as X
from lectern.operators import context as CX, library, retrieval as R
from lectern.plans import adapters as A, shelves
from lectern.plans.registry import query
from lectern.session import settle


def label_sql(ms: str) -> str:
    return (
        f"CASE WHEN {ms} // 3600000 > 0 THEN printf('%02d:%02d:%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60)"
        f" ELSE printf('%02d:%02d', {ms} // 60000, {ms} // 1000 % 60) END"
    )


# water-filling written round by round: the share of a round, who fits under it, what is left
def fill_sql(items: str, budgets: str) -> str:
    return f"""
it AS ({items}), bu AS ({budgets}),
ranked AS (SELECT i.*, b.budget, row_number() OVER (PARTITION BY i.k ORDER BY size, id) AS rn, count(*) OVER (PARTITION BY i.k) AS n,
  coalesce(sum(size) OVER (PARTITION BY i.k ORDER BY size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM it i JOIN bu b ON b.k = i.k),
lvl AS (SELECT k, arg_min(greatest(0, CAST(floor((budget - used) / (n - rn + 1)) AS BIGINT)), rn) AS level FROM ranked WHERE size > floor((budget - used) / (n - rn + 1)) GROUP BY k),
filled AS (SELECT r.k, r.id, r.size, CASE WHEN budget < n THEN 0 WHEN l.level IS NULL THEN size ELSE least(size, l.level) END AS lim FROM ranked r LEFT JOIN lvl l ON l.k = r.k)"""


@query("waterfill_budget", "doc_id long, size long, lim long", "WITH" + fill_sql(
    "SELECT source AS k, doc_id AS id, length(text) AS size FROM documents",
    "SELECT source AS k, CASE CAST(source[4:] AS BIGINT) % 4 WHEN 0 THEN 20 WHEN 1 THEN sum(length(text)) // 2 WHEN 2 THEN sum(length(text)) * 2 ELSE 7001 END AS budget FROM documents GROUP BY source",
) + "\n---\nSELECT id AS doc_id, size, lim FROM filled")
def waterfill_budget(t):
    items = t.documents.select("source", "doc_id", F.length("text").alias("size"))
    n = F.substring("source", 4, 10).cast("long") % 4
    total = F.col("total")
    budgets = items.groupBy("source").agg(F.sum("size").alias("total")).select(
        "source", F.when(n == 0, 20).when(n == 1, F.floor(total / 2)).when(n == 2, total * 2).otherwise(7001).alias("budget")
    )
    return CX.waterfill(items, budgets, "source").withColumnRenamed("limit", "lim")


def summarised_courses(t):
    first = A.docs(t).groupBy("video_id").agg(F.min_by("summary", "idx").alias("video_summary"))
    return A.courses(t).join(first, "video_id")


_HEAD = f"""
chap AS (SELECT video_id, string_agg('- [' || {label_sql('start_ms')} || '] ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || CASE WHEN summary <> '' THEN '：' || trim(summary) ELSE '' END, chr(10) ORDER BY idx) AS l FROM v_doc_chapters GROUP BY video_id),
summ AS (SELECT video_id, arg_min(summary, idx) AS s FROM v_docs GROUP BY video_id),
head AS (SELECT c.video_id, '# 课程材料：' || c.title || chr(10) || '总时长：' || {label_sql('CAST(c.duration_ms AS BIGINT)')} || CASE WHEN s.s <> '' THEN chr(10) || chr(10) || '## 全课摘要' || chr(10) || trim(s.s) ELSE '' END
  || chr(10) || chr(10) || '## 章节结构' || chr(10) || chap.l AS head FROM v_courses c JOIN summ s ON s.video_id = c.video_id JOIN chap ON chap.video_id = c.video_id)"""


def _full_sql(most: int) -> str:
    return f"""WITH{_HEAD},
body AS (SELECT video_id, idx, chr(10) || '【' || {label_sql('start_ms')} || '】' AS mark, text, trim(ocr_text) AS ocr FROM v_docs),
fix AS (SELECT video_id, sum(length(mark) + length(text) + 2 + CASE WHEN ocr <> '' THEN 5 ELSE 0 END) AS f FROM body GROUP BY video_id),
{fill_sql("SELECT video_id AS k, idx AS id, length(ocr) AS size FROM body", f"SELECT h.video_id AS k, greatest(0, {most} - length(head) - 7 - 2 - f) AS budget FROM head h JOIN fix ON fix.video_id = h.video_id")},
parts AS (SELECT b.video_id, string_agg(mark || CASE WHEN ocr <> '' AND lim > 0 THEN chr(10) || '（课件）' || CASE WHEN length(ocr) <= lim THEN ocr ELSE ocr[1:lim - 1] || '…' END ELSE '' END || chr(10) || text, chr(10) ORDER BY b.idx) AS p
  FROM body b JOIN filled f ON f.k = b.video_id AND f.id = b.idx GROUP BY b.video_id),
whole AS (SELECT h.video_id, head || chr(10) || chr(10) || '## 逐字稿' || chr(10) || p AS x FROM head h JOIN parts ON parts.video_id = h.video_id)
---
SELECT video_id, CASE WHEN length(x) > {most} THEN x[1:{most}] || chr(10) || chr(10) || '（材料过长已截断）' ELSE x END AS prefix,
       greatest(1, CAST(floor(length(CASE WHEN length(x) > {most} THEN x[1:{most}] || chr(10) || chr(10) || '（材料过长已截断）' ELSE x END) / 1.6) AS BIGINT)) AS tokens FROM whole"""


@query("full_prefix", "video_id string, prefix string, tokens long", _full_sql(200_000))
def full_prefix(t):
    return CX.full_prefix(summarised_courses(t), A.doc_chapters(t), A.docs(t))


@query("full_prefix_tight", "video_id string, prefix string, tokens long", _full_sql(130_000))
def full_prefix_tight(t):
    return CX.full_prefix(summarised_courses(t), A.doc_chapters(t), A.docs(t), max_chars=130_000)


@query("outline_prefix", "video_id string, ch long, idx long, line string", f"""
SELECT video_id, idx AS ch, -1 AS idx, chr(10) || '## ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || '　[' || {label_sql('start_ms')} || ' - ' || {label_sql('end_ms')} || ']'
  || CASE WHEN trim(summary) <> '' THEN chr(10) || trim(summary) ELSE '' END AS line FROM v_doc_chapters
UNION ALL SELECT video_id, chapter_idx, idx, '- [' || {label_sql('start_ms')} || '] ' || CASE WHEN title <> '' THEN title ELSE {label_sql('start_ms')} END || CASE WHEN summary <> '' THEN '：' || trim(summary) ELSE '' END FROM v_docs""")
def outline_prefix(t):
    return CX.outline_lines(*A.numbered_chapters(t)).orderBy("video_id", "ch", "idx")


@query("citation_prefix", "qid long, prefix string", f"""
WITH h AS (SELECT * FROM (SELECT qid, video_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM v_vector_hits) WHERE rank <= 4)
---
SELECT h.qid, '# 检索到的课程片段' || chr(10) || string_agg(chr(10) || '【' || {label_sql('start_ms')} || ' - ' || {label_sql('end_ms')} || '】' || chr(10) || text
  || CASE WHEN ocr_text <> '' THEN chr(10) || '（课件）' || CASE WHEN length(trim(ocr_text)) > 400 THEN trim(ocr_text)[1:400] || '…' ELSE trim(ocr_text) END ELSE '' END, chr(10) ORDER BY rank) AS prefix
FROM h JOIN v_docs d ON d.chunk_id = h.chunk_id GROUP BY h.qid""")
def citation_prefix(t):
    return CX.citation_prefix(R.vector_hits(shelves.vector_packs(t, lambda: A.vectors(t)), A.question_vectors(t), 4, "rank"), A.docs(t))


@query("series_prefix", "video_id string, line string", """
SELECT c.video_id, '## 《' || c.title || '》（video_id=' || c.video_id || '）' || chr(10) || CASE WHEN s = '' THEN '（尚无全课摘要）' WHEN length(s) > 60 THEN rtrim(s[1:60]) || '…' ELSE s END || chr(10) AS line
FROM v_courses c JOIN (SELECT video_id, trim(arg_min(summary, idx)) AS s FROM v_docs GROUP BY video_id) d ON d.video_id = c.video_id""")
def series_prefix(t):
    return summarised_courses(t).select("video_id", CX.series_line(F.col("title"), F.col("video_id"), F.col("video_summary"), 60).alias("line"))


_QUIZ_BLOCKS = f"""
WITH b AS (SELECT video_id, idx, chr(10) || '## ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || ' [' || {label_sql('start_ms')} || '-' || {label_sql('end_ms')} || ']' || chr(10)
   || CASE WHEN trim(summary) <> '' THEN trim(summary)[1:800] || chr(10) ELSE coalesce(pts || chr(10), '') END AS block
  FROM v_doc_chapters c LEFT JOIN (SELECT parent_id, string_agg('- [' || {label_sql('start_ms')} || '] ' || trim(CASE WHEN summary <> '' THEN summary WHEN title <> '' THEN title ELSE text END)[1:220], chr(10) ORDER BY rn) AS pts
     FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY idx) AS rn FROM v_docs) WHERE rn <= 4 GROUP BY parent_id) p ON p.parent_id = c.chapter_id),
taken AS (SELECT video_id, idx, block FROM (SELECT *, sum(length(block)) OVER (PARTITION BY video_id ORDER BY idx) AS s FROM b) WHERE s <= 1400)"""


@query("quiz_prompt", "video_id string, material string", _QUIZ_BLOCKS + f""",
summ AS (SELECT video_id, trim(arg_min(summary, idx)) AS s FROM v_docs GROUP BY video_id),
x AS (SELECT c.video_id, trim('课程：' || c.title || chr(10) || '总时长：' || {label_sql('CAST(c.duration_ms AS BIGINT)')} || CASE WHEN s.s <> '' THEN chr(10) || chr(10) || '## 全课摘要' || chr(10) || s.s[1:3000] ELSE '' END
  || coalesce(chr(10) || k.t, ''), ' ' || chr(10)) AS m FROM v_courses c JOIN summ s ON s.video_id = c.video_id LEFT JOIN (SELECT video_id, string_agg(block, chr(10) ORDER BY idx) AS t FROM taken GROUP BY video_id) k ON k.video_id = c.video_id)
---
SELECT video_id, CASE WHEN length(m) >= 80 THEN m END AS material FROM x""")
def quiz_prompt(t):
    from lectern.operators import quiz

    return quiz.material_text(summarised_courses(t), A.doc_chapters(t), A.docs(t), budget=1400)


@query("quiz_material", "video_id string, idx long, block string", _QUIZ_BLOCKS + """
---
SELECT video_id, idx, block FROM taken""")
def quiz_material(t):
    from lectern.operators import quiz

    return quiz.material(A.doc_chapters(t), A.docs(t), budget=1400)


@query("chapter_transcript", "parent_id string, transcript string", f"""
WITH num AS (SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY idx) AS rn, chr(10) || '【' || {label_sql('start_ms')} || '】' AS head, chr(10) || text AS tail, ocr_text AS ocr FROM v_docs),
walk AS (SELECT parent_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS total, false AS cut, false AS stop, '' AS part FROM num WHERE rn = 1
 UNION ALL
 SELECT parent_id, rn, CASE WHEN lft <= 0 THEN total ELSE total + length(head) + length(op) + length(tl) END, cut OR lft <= 0 OR length(tl) < length(tail) OR (ocr <> '' AND (oroom <= 0 OR length(ocr) > oroom)),
   lft <= 0 OR length(tl) < length(tail), CASE WHEN lft <= 0 THEN NULL ELSE head || op || tl END
 FROM (SELECT *, CASE WHEN ocr <> '' AND oroom > 0 THEN chr(10) || '（课件）' || CASE WHEN length(ocr) <= oroom THEN ocr WHEN oroom = 1 THEN '…' ELSE ocr[1:oroom - 1] || '…' END ELSE '' END AS op FROM (
   SELECT *, lft - length(head) - length(tl) - 5 AS oroom FROM (
   SELECT *, CASE WHEN lft - length(head) <= 0 THEN '' WHEN length(tail) <= lft - length(head) THEN tail WHEN lft - length(head) = 1 THEN '…' ELSE tail[1:lft - length(head) - 1] || '…' END AS tl FROM (
   SELECT n.parent_id, n.rn, n.head, n.tail, n.ocr, w.total, w.cut, 6000 - w.total AS lft FROM walk w JOIN num n ON n.parent_id = w.parent_id AND n.rn = w.rn + 1 WHERE NOT w.stop))))),
out AS (SELECT parent_id, string_agg(part, chr(10) ORDER BY rn) FILTER (rn > 0 AND part IS NOT NULL) AS t, bool_or(cut) AS cut FROM walk GROUP BY parent_id)
---
SELECT parent_id, CASE WHEN cut THEN t || chr(10) || chr(10) || '（本章内容过长，已截断）' ELSE t END AS transcript FROM out""")
def chapter_transcript(t):
    return CX.chapter_transcripts(A.docs(t), ["parent_id"], budget=6000)


_FULL_CTES, _FULL_ROWS = _full_sql(130_000).split("---\n")


@query("prefix_choice", "video_id string, prefix string, tokens long, used_outline boolean", _FULL_CTES.rstrip() + f""",
full_p AS ({_FULL_ROWS}),
ol AS (SELECT video_id, idx AS ch, -1 AS idx, chr(10) || '## ' || CASE WHEN title = '' THEN '第 ' || (idx + 1) || ' 章' ELSE title END || '　[' || {label_sql('start_ms')} || ' - ' || {label_sql('end_ms')} || ']'
    || CASE WHEN trim(summary) <> '' THEN chr(10) || trim(summary) ELSE '' END AS line FROM v_doc_chapters
  UNION ALL SELECT video_id, chapter_idx, idx, '- [' || {label_sql('start_ms')} || '] ' || CASE WHEN title <> '' THEN title ELSE {label_sql('start_ms')} END || CASE WHEN summary <> '' THEN '：' || trim(summary) ELSE '' END FROM v_docs),
outl AS (SELECT c.video_id, '# 课程大纲：' || c.title || chr(10) || '总时长：' || {label_sql('CAST(c.duration_ms AS BIGINT)')} || CASE WHEN s.s <> '' THEN chr(10) || chr(10) || '## 全课摘要' || chr(10) || trim(s.s) ELSE '' END || chr(10) || l.t AS x
  FROM v_courses c JOIN summ s ON s.video_id = c.video_id JOIN (SELECT video_id, string_agg(line, chr(10) ORDER BY ch, idx) AS t FROM ol GROUP BY video_id) l ON l.video_id = c.video_id),
cut_o AS (SELECT video_id, CASE WHEN length(x) > 130000 THEN x[1:130000] || chr(10) || chr(10) || '（材料过长已截断）' ELSE x END AS o FROM outl)
---
SELECT f.video_id, CASE WHEN f.tokens > 40000 THEN o ELSE f.prefix END AS prefix,
  CASE WHEN f.tokens > 40000 THEN greatest(1, CAST(floor(length(o) / 1.6) AS BIGINT)) ELSE f.tokens END AS tokens, f.tokens > 40000 AS used_outline
FROM full_p f JOIN cut_o ON cut_o.video_id = f.video_id""")
def prefix_choice(t):
    """Prefixes of yesterday, when every third course had another title, brought up to date."""
    courses, (chapters, chunks) = summarised_courses(t), A.numbered_chapters(t)
    limits = {"max_chars": 130_000, "max_tokens": 40_000}
    renamed = F.when(F.substring("video_id", 4, 10).cast("long") % 3 == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title"))
    stored = settle(CX.choose_prefixes(courses.withColumn("title", renamed), chapters, chunks, **limits))
    return CX.choose_prefixes(courses, chapters, chunks, stored, **limits).drop("inputs")


@query("question_text", "qid long, prompt string", f"""
WITH q AS (SELECT session_id, max(id) AS qid, arg_max(content, id) AS question FROM v_messages GROUP BY session_id),
hist AS (SELECT q.qid, string_agg(CASE WHEN m.role = 'user' THEN '用户' ELSE '助手' END || '：' || CASE WHEN length(trim(m.content)) <= 800 THEN trim(m.content) ELSE trim(m.content)[1:799] || '…' END, chr(10) ORDER BY m.id) AS talk
  FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM v_messages) m ON m.session_id = q.session_id AND m.rn BETWEEN 2 AND {C.HISTORY_MESSAGES + 1} GROUP BY q.qid),
sp AS (SELECT qid, string_agg({label_sql('start_ms')} || '-' || {label_sql('end_ms')}, '、' ORDER BY k) AS s FROM (
  SELECT q.qid, k, d.start_ms, d.end_ms FROM (SELECT *, unnest(range(0, 5)) AS k FROM q) q JOIN v_docs d ON d.idx = session_id % 20 + 20 * ((session_id * 7 + k) % (SELECT max(doc_id) // 20 + 1 FROM documents))) GROUP BY qid)
---
SELECT q.qid, coalesce('【此前对话】（仅供理解指代与追问，课程事实仍以材料为准）' || chr(10) || talk || chr(10) || chr(10), '') || '用户问题：' || question
  || CASE WHEN session_id % 2 = 0 THEN chr(10) || '（用户当前播放到 ' || {label_sql('(session_id * 61000)')} || '，仅作参考，不代表问题范围）' ELSE '' END
  || CASE WHEN session_id % 3 = 0 THEN chr(10) || '（用户限定只在本章回答：第 1 章）' ELSE '' END
  || coalesce(chr(10) || '（以下是检索到的可能相关位置，供你优先核对：' || s || '）', '') AS prompt
FROM q LEFT JOIN hist ON hist.qid = q.qid LEFT JOIN sp ON sp.qid = q.qid""")
def question_text(t):
    m = A.messages(t)
    asked = m.groupBy("session_id").agg(F.max("id").alias("qid"), F.max_by("content", "id").alias("question"))
    sid = F.col("session_id")
    asked = asked.withColumn("current_ms", F.when(sid % 2 == 0, sid * 61_000)).withColumn("chapter", F.when(sid % 3 == 0, F.lit("第 1 章")))
    recent = library.last_messages(m, C.HISTORY_MESSAGES + 1).join(asked.select("session_id", "qid"), "session_id").filter("id < qid")
    history = recent.select("qid", F.col("id").alias("pos"), "role", "content")
    many = t.documents.agg((F.floor(F.max("doc_id") / 20) + 1).alias("n")).scalar()
    spots = asked.select("qid", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"), "session_id").withColumn("idx", sid % 20 + 20 * ((sid * 7 + F.col("rank")) % many))
    spans = spots.join(A.docs(t).select("idx", "start_ms", "end_ms"), "idx")
    return CX.question_text(asked, history, spans)
