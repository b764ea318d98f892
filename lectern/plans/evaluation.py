"""Evaluation, citation and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import answers as fa, text as X
from lectern.operators import citations as CT, evaluation as EV
from lectern.plans import adapters as A
from lectern.plans.registry import query
from lectern.plans.views import VIEWS

# ------------------------------------------------------------------ adapters
# Every document answers one benchmark question. Key points are pairs of spellings: the words of
# the question two by two. A toxic document counts as a failed call.

VIEWS["v_item_words"] = r"""
SELECT item_id, list(w ORDER BY pos) AS ws FROM (
  SELECT item_id, w, min(pos) AS pos FROM (
    SELECT item_id, unnest(f) AS w, generate_subscripts(f, 1) AS pos FROM (
      SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS f FROM benchmark))
  GROUP BY item_id, w) GROUP BY item_id"""

VIEWS["v_answers"] = """
SELECT d.doc_id, d.doc_id % (SELECT count(*) FROM benchmark) AS item_id, d.text, coalesce(l.toxic, 0) = 1 AS failed,
       CASE WHEN d.doc_id % 4 = 3 THEN [] ELSE [d.doc_id * 1000 % 500000, d.doc_id * 777 % 500000] END AS starts
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

VIEWS["v_scored"] = r"""
SELECT *, CASE WHEN failed THEN 0 WHEN status = 'n/a' THEN rate ELSE 0.7 * rate + 0.3 * CASE status WHEN 'missing' THEN 0.5 WHEN 'wrong' THEN 0 ELSE 1 END END AS score FROM (
SELECT *, CASE WHEN total = 0 THEN 0 ELSE hit / total END AS rate,
  CASE WHEN failed OR expect_ms IS NULL THEN 'n/a' WHEN len(starts) = 0 THEN 'missing' WHEN len(list_filter(starts, lambda s: abs(s - expect_ms) <= 90000)) > 0 THEN 'ok' ELSE 'wrong' END AS status FROM (
SELECT doc_id, item_id, failed, starts, type, expect_ms, miss,
  CASE WHEN failed THEN 0 ELSE len(kps) END AS total, CASE WHEN failed THEN 0 ELSE len(kps) - len(miss) END AS hit FROM (
SELECT *, list_transform(list_filter(kps, lambda k: NOT contains(norm, regexp_replace(k[1], '[^0-9a-z]', '', 'g')) AND NOT contains(norm, regexp_replace(k[2], '[^0-9a-z]', '', 'g'))), lambda k: k[1]) AS miss FROM (
SELECT a.doc_id, a.item_id, a.failed, a.starts,
  regexp_replace(regexp_replace(lower(a.text), '[\s，。、；：？！,.;:?!"''“”‘’()（）\[\]【】《》<>·—\-_/\\|]+', '', 'g'), '[^0-9a-zA-Z\x{4e00}-\x{9fff}^+\-=<>()]+', '', 'g') AS norm,
  list_transform(range(0, len(w.ws) // 2), lambda i: [w.ws[2 * i + 1], w.ws[2 * i + 2]]) AS kps,
  ['factual', 'cross', 'visual', 'global'][a.item_id % 4 + 1] AS type, CASE WHEN a.item_id % 3 = 0 THEN NULL ELSE a.item_id * 7000 END AS expect_ms
FROM v_answers a JOIN v_item_words w ON w.item_id = a.item_id))))"""


def question_set(t):
    words = X.query_terms(F.col("text"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("ws") / 2).cast("int")),
        lambda i: F.slice("ws", i * 2 + 1, F.lit(2)),
    )
    n = F.col("item_id")
    kind = F.element_at(F.array(*[F.lit(k) for k, _p, _t in C.QUESTION_TYPES]), (n % 4 + 1).cast("int"))
    return t.benchmark.withColumn("ws", words).select(
        "item_id", kind.alias("type"), fa.ready_keypoints(F.filter(pairs, lambda p: F.size(p) == 2)).alias("keypoints"),
        F.when(n % 3 != 0, n * 7000).alias("expect_ms"), F.lit(C.CITATION_TOLERANCE_MS).alias("tolerance_ms"),
    )


def answered(t):
    n = F.col("doc_id")
    items = t.benchmark.agg(F.count("*").alias("c")).scalar()
    none = F.array().cast("array<bigint>")
    docs = t.documents.select(
        "doc_id", (n % items).alias("item_id"), F.col("text").alias("answer"),
        F.when(n % 4 == 3, none).otherwise(F.array(n * 1000 % 500000, n * 777 % 500000)).alias("starts"),
    )
    failed = t.labels.select("doc_id", (F.col("toxic") == 1).alias("failed"))
    return docs.join(failed, "doc_id", "left").join(question_set(t), "item_id")


def outcomes(t):
    return EV.score(answered(t))


@query("keypoint_score", "doc_id long, item_id long, hit long, total long, rate double, missing string", """
SELECT doc_id, item_id, hit, total, rate, array_to_string(miss, ',') AS missing FROM v_scored""")
def keypoint_score(t):
    return outcomes(t).withColumn("missing", F.array_join("missing", ","))


@query("citation_score", "doc_id long, status string", "SELECT doc_id, status FROM v_scored")
def citation_score(t):
    return outcomes(t)


@query("question_score", "doc_id long, score double", "SELECT doc_id, score FROM v_scored")
def question_score(t):
    return outcomes(t)


_SUM = """count(*) AS n, round(avg(score), 4) AS mean,
  round(CASE WHEN count(*) FILTER (status <> 'n/a') = 0 THEN 0 ELSE count(*) FILTER (status = 'missing') / count(*) FILTER (status <> 'n/a') END, 4) AS no_citation_rate,
  round(CASE WHEN count(*) FILTER (status <> 'n/a') = 0 THEN 0 ELSE count(*) FILTER (status = 'wrong') / count(*) FILTER (status <> 'n/a') END, 4) AS wrong_citation_rate,
  count(*) FILTER (failed) AS failures"""
_SUM_COLS = "n long, mean double, no_citation_rate double, wrong_citation_rate double, failures long"


@query("eval_summary", f"type string, {_SUM_COLS}", f"SELECT type, {_SUM} FROM v_scored GROUP BY type")
def eval_summary(t):
    return EV.summary(outcomes(t), "type")


_GATES = f"""
WITH m AS (SELECT type AS gate, {_SUM} FROM v_scored GROUP BY type UNION ALL SELECT 'overall', {_SUM} FROM v_scored),
g(gate, threshold) AS (VALUES ('factual', 0.80), ('cross', 0.65), ('global', 0.65), ('visual', 0.60), ('overall', 0.70))
---
SELECT m.gate, m.mean AS value, threshold, m.mean >= threshold AS passed FROM m JOIN g ON g.gate = m.gate
UNION ALL SELECT 'wrong_citation_rate', wrong_citation_rate, 0.05, wrong_citation_rate <= 0.05 FROM m WHERE gate = 'overall'"""


@query("eval_gates", "gate string, value double, threshold double, passed boolean", _GATES)
def eval_gates(t):
    return EV.gates(outcomes(t))


@query("run_validity", "n long, failures long, valid boolean", """
SELECT count(*) AS n, count(*) FILTER (failed) AS failures, count(*) FILTER (failed) < greatest(1, count(*) // 2) AS valid FROM v_scored""")
def run_validity(t):
    return EV.validity(outcomes(t))


@query("eval_failures", "doc_id long, type string", "SELECT doc_id, type FROM v_scored WHERE failed")
def eval_failures(t):
    return outcomes(t).filter("failed")


@query("eval_rows", "doc_id long, type string, score double, rate double, status string, failed boolean", """
SELECT doc_id, type, score, rate, status, failed FROM v_scored""")
def eval_rows(t):
    return outcomes(t).withColumn("failed", F.coalesce("failed", F.lit(False)))


@query("evaluation_run", f"grp string, {_SUM_COLS}, passed boolean", f"""
WITH m AS (SELECT type AS grp, {_SUM} FROM v_scored GROUP BY type UNION ALL SELECT 'overall', {_SUM} FROM v_scored),
g(gate, threshold) AS (VALUES ('factual', 0.80), ('cross', 0.65), ('global', 0.65), ('visual', 0.60), ('overall', 0.70))
---
SELECT m.*, m.mean >= threshold AS passed FROM m JOIN g ON g.gate = m.grp""")
def evaluation_run(t):
    both = EV.summary(outcomes(t), "type", overall=True).withColumnRenamed("type", "grp")
    return both.join(EV.gate_table(t.spark).withColumnRenamed("gate", "grp"), "grp").withColumn("passed", F.col("mean") >= F.col("threshold"))


@query("notes_score", "source string, hit long, total long, rate double", r"""
WITH src AS (SELECT doc_id, source, regexp_replace(regexp_replace(lower(text), '[\s，。、；：？！,.;:?!"''“”‘’()（）\[\]【】《》<>·—\-_/\\|]+', '', 'g'), '[^0-9a-zA-Z\x{4e00}-\x{9fff}^+\-=<>()]+', '', 'g') AS norm FROM documents)
---
SELECT source, sum(hit) AS hit, sum(total) AS total, sum(hit) / sum(total) AS rate FROM (
  SELECT s.source, len(w.ws) AS total, len(list_filter(w.ws, lambda x: contains(s.norm, regexp_replace(x, '[^0-9a-z]', '', 'g')))) AS hit
  FROM src s JOIN v_item_words w ON w.item_id = s.doc_id % (SELECT count(*) FROM benchmark)) GROUP BY source""")
def notes_score(t):
    items = t.benchmark.agg(F.count("*").alias("c")).scalar()
    points = t.benchmark.select("item_id", fa.ready_keypoints(F.transform(X.query_terms(F.col("text")), lambda w: F.array(w))).alias("kps"))
    d = t.documents.select("source", (F.col("doc_id") % items).alias("item_id"), fa.normalise(F.col("text")).alias("norm"))
    s = d.join(points, "item_id").withColumn("total", F.size("kps")).withColumn("hit", F.col("total") - F.size(fa.missing_keypoints(F.col("norm"), F.col("kps"))))
    return s.groupBy("source").agg(F.sum("hit").alias("hit"), F.sum("total").alias("total")).withColumn("rate", F.col("hit") / F.col("total"))


# ------------------------------------------------------------------ question sets


@query("question_set", "id long, type string, n_points long, first_point string, expect_ms long, tolerance_ms long", r"""
SELECT item_id AS id, 'visual' AS type, 2 AS n_points, ws[1] AS first_point, (item_id % 50 * 60 + 7) * 1000 AS expect_ms, CASE WHEN item_id % 2 = 0 THEN 5000 ELSE 90000 END AS tolerance_ms
FROM v_item_words WHERE item_id % 4 = 2 AND item_id % 5 <> 0""")
def question_set_query(t):
    n = F.col("item_id")
    ws = X.query_terms(F.col("text"))
    raw = t.benchmark.select(
        n.alias("id"),
        F.element_at(F.array(*[F.lit(k) for k, _p, _t in C.QUESTION_TYPES]), (n % 4 + 1).cast("int")).alias("type"),
        F.when(n % 5 == 0, "  ").otherwise(F.col("text")).alias("question"),
        F.array(F.to_json(F.slice(ws, 1, 2)), F.get(ws, F.lit(2))).alias("keypoints"),
        F.format_string("%02d:07", n % 50).alias("expect_time"),
        F.when(n % 2 == 0, 5000).alias("tolerance_ms"),
    )
    q = EV.questions(raw, only="visual")
    return q.withColumn("n_points", F.size("keypoints")).withColumn("first_point", F.get(F.get("keypoints", F.lit(0)), F.lit(0)))


@query("question_skeleton", "video_id string, id string, type string, expect_time string, tolerance_ms long", """
WITH n AS (SELECT video_id, count(*) AS n FROM v_chapters GROUP BY video_id),
k(type, prefix, tol) AS (VALUES ('factual', 'f', 90000), ('cross', 'c', 300000), ('visual', 'v', 120000), ('global', 'g', 600000)),
s AS (SELECT n.*, unnest(range(0, 10)) AS slot FROM n)
---
SELECT s.video_id, prefix || printf('%02d', slot + 1) AS id, type, CASE WHEN type NOT IN ('factual', 'visual') THEN ''
   WHEN c.start_ms // 3600000 > 0 THEN printf('%02d:%02d:%02d', c.start_ms // 3600000, c.start_ms // 60000 % 60, c.start_ms // 1000 % 60) ELSE printf('%02d:%02d', c.start_ms // 60000, c.start_ms // 1000 % 60) END AS expect_time, tol AS tolerance_ms
FROM s CROSS JOIN k LEFT JOIN v_chapters c ON c.video_id = s.video_id AND c.idx = least(slot * greatest(1, n // 10), n - 1)""")
def question_skeleton(t):
    return EV.skeleton(t.spark, A.transcript_chapters(t))


# ------------------------------------------------------------------ answers and citations

# assistant messages as answers with two written times; hits are fourteen chunks of the course
VIEWS["v_replies"] = """
SELECT id AS qid, video_id, id % 100 AS turn, content || ' [' || printf('%02d:%02d', id * 37 % 60, id % 60) || '] x [时间 ' || printf('%02d:%02d:%02d', id % 30, id * 7 % 60, id % 60) || ']' AS answer
FROM v_messages WHERE role = 'assistant'"""

VIEWS["v_hits"] = """
SELECT r.qid, r.video_id, k AS rank, d.idx FROM (SELECT *, unnest(range(0, 14)) AS k FROM v_replies) r
JOIN v_docs d ON d.video_id = r.video_id AND d.idx = CAST(r.video_id[4:] AS BIGINT) + 20 * ((r.qid * 11 + k * 3) % (SELECT max(doc_id) // 20 + 1 FROM documents))"""


def replies(t):
    n = F.col("id")
    answer = F.concat(
        "content", F.lit(" ["), F.format_string("%02d:%02d", n * 37 % 60, n % 60),
        F.lit("] x [时间 "), F.format_string("%02d:%02d:%02d", n % 30, n * 7 % 60, n % 60), F.lit("]"),
    )
    return A.messages(t).filter("role = 'assistant'").select(n.alias("qid"), "video_id", (n % 100).alias("turn"), answer.alias("answer"))


def hits(t):
    r = replies(t).select("qid", "video_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("rank"))
    many = t.documents.agg((F.floor(F.max("doc_id") / 20) + 1).alias("n")).scalar()
    idx = F.substring("video_id", 4, 10).cast("long") + 20 * ((F.col("qid") * 11 + F.col("rank") * 3) % many)
    return r.withColumn("idx", idx).join(A.docs(t).select("video_id", "idx"), ["video_id", "idx"], "left_semi")


@query("answer_times", "qid long, pos long, at_ms long", """
SELECT qid, unnest([0, 1]) AS pos, unnest([(qid * 37 % 60 * 60 + qid % 60) * 1000, (qid % 30 * 3600 + qid * 7 % 60 * 60 + qid % 60) * 1000]) AS at_ms FROM v_replies""")
def answer_times(t):
    return CT.answer_times(replies(t))


VIEWS["v_picked"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prio, pos) - 1 AS priority FROM (
  SELECT qid, video_id, idx, min(prio * 1000 + pos) // 1000 AS prio, min(prio * 1000 + pos) % 1000 AS pos FROM (
    SELECT qid, video_id, idx, 0 AS prio, pos FROM (
      SELECT p.qid, p.video_id, p.pos, d.idx, row_number() OVER (PARTITION BY p.qid, p.pos ORDER BY CASE WHEN p.at_ms BETWEEN d.start_ms AND d.end_ms THEN 0 ELSE abs(d.start_ms - p.at_ms) END, d.idx) AS rn
      FROM (SELECT qid, video_id, unnest([0, 1]) AS pos, unnest([(qid * 37 % 60 * 60 + qid % 60) * 1000, (qid % 30 * 3600 + qid * 7 % 60 * 60 + qid % 60) * 1000]) AS at_ms FROM v_replies) p
      JOIN v_docs d ON d.video_id = p.video_id) WHERE rn = 1
    UNION ALL SELECT qid, video_id, idx, 1, rank FROM v_hits) GROUP BY qid, video_id, idx)) WHERE priority < 12"""


def picked(t):
    return CT.picked_chunks(replies(t), A.docs(t), hits(t))


@query("citation_cut", "qid long, idx long, priority long", "SELECT qid, idx, priority FROM v_picked")
def citation_cut(t):
    return picked(t)


@query("answer_citations", "qid long, chunk_id string, start_ms long, end_ms long, text string, chapter_title string", """
SELECT p.qid, d.chunk_id, d.start_ms, d.end_ms, d.text[1:400] AS text, coalesce(c.title, '') AS chapter_title
FROM v_picked p JOIN v_docs d ON d.idx = p.idx AND d.video_id = p.video_id LEFT JOIN v_doc_chapters c ON c.chapter_id = d.parent_id""")
def answer_citations(t):
    return CT.citations(picked(t), A.docs(t), A.doc_chapters(t)).orderBy("qid", "start_ms")


@query("citation_titles", "chunk_id string, chapter_title string", """
SELECT d.chunk_id, coalesce(c.title, '') AS chapter_title FROM v_docs d LEFT JOIN v_doc_chapters c ON c.chapter_id = d.parent_id""")
def citation_titles(t):
    titles = A.doc_chapters(t).select(F.col("chapter_id").alias("parent_id"), F.col("title").alias("chapter_title"))
    return A.docs(t).join(titles, "parent_id", "left").withColumn("chapter_title", F.coalesce("chapter_title", F.lit("")))


@query("evidence_slides", "qid long, slide_idx long, n long", """
WITH seen AS (SELECT qid, slide_idx, min(rank * 100 + pos) AS o FROM (
  SELECT qid, rank, unnest([idx % 7, idx % 11, idx % 5]) AS slide_idx, unnest([0, 1, 2]) AS pos FROM v_hits) GROUP BY qid, slide_idx)
---
SELECT * FROM (SELECT qid, slide_idx, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS n FROM seen) WHERE n < 3""")
def evidence_slides(t):
    n = F.col("idx")
    return CT.evidence_slides(hits(t).withColumn("slide_idxs", F.array(n % 7, n % 11, n % 5)))


@query("chat_intents", "id long, intent string", """
SELECT id, CASE WHEN regexp_matches(lower(q), '这张图|画面|板书|ppt|幻灯|图里|图表|写的什么|屏幕') THEN 'visual'
  WHEN regexp_matches(lower(q), '一共|几种|哪些|总结|概括|整体|全部|整个课程|贯穿|对比|比较|有变化') THEN 'global' ELSE 'local' END AS intent
FROM (SELECT id, content || CASE id % 5 WHEN 0 THEN ' PPT' WHEN 1 THEN ' 一共几种' WHEN 2 THEN ' 画面 全部' ELSE '' END AS q FROM v_messages)""")
def chat_intents(t):
    n = F.col("id") % 5
    hint = F.when(n == 0, " PPT").when(n == 1, " 一共几种").when(n == 2, " 画面 全部").otherwise("")
    return A.messages(t).select("id", fa.intent(F.concat("content", hint)).alias("intent"))
