"""Index and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import constants as C
from lectern.functions import text, vectors
from lectern.operators import retrieval as R, search as S
from lectern.plans import adapters as A, shelves
from lectern.plans.registry import query
from lectern.session import settle


def bodies(t):
    return A.docs(t).select("video_id", "chunk_id", "text")


def packs(t):
    """the stored vectors of the documents"""
    return shelves.vector_packs(t, lambda: A.vectors(t))


def words(t):
    """the stored keyword index of the documents"""
    return shelves.chunk_words(t, lambda: bodies(t))


@query("query_terms", "item_id long, terms string", r"""
WITH w AS (SELECT item_id, word, pos FROM (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS ws FROM benchmark)))
---
SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS terms FROM (SELECT item_id, word, min(pos) AS pos FROM w GROUP BY item_id, word) GROUP BY item_id""")
def query_terms(t):
    return t.benchmark.select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("bm25_postings", "idx long, term string, tf long, len long", """
SELECT idx, term, count(*) AS tf, len FROM (SELECT idx, len(toks) AS len, unnest(toks) AS term FROM v_tokens) GROUP BY ALL""")
def bm25_postings(t):
    return R.postings(A.docs(t).select("idx", "text"))


@query("bm25_search", "qid long, video_id string, chunk_id string, score double",
       "SELECT qid, video_id, chunk_id, score FROM v_bm25 WHERE doc_video = video_id")
def bm25_search(t):
    return R.bm25(words(t), A.questions(t))


@query("keyword_topk", "qid long, chunk_id string, score double, rank long", """
SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank
  FROM v_bm25 WHERE doc_video = video_id) WHERE rank < 8""")
def keyword_topk(t):
    return R.keyword_hits(words(t), A.questions(t), C.TOP_K, "rank")


@query("l2_normalise", "vec_id long, pos long, x double", """
SELECT vec_id, pos - 1 AS pos, v[pos] AS x FROM (
  SELECT vec_id, unnest(range(1, len(v) + 1)) AS pos, list_transform(v, lambda x: x / n) AS v FROM (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-6) AS n FROM embeddings))""")
def l2_normalise(t):
    return t.embeddings.select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("pos", "x"))


@query("vector_topk", "qid long, chunk_id string, score double, rank long", """
SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank FROM v_vector_hits) WHERE rank < 8""")
def vector_topk(t):
    return R.vector_hits(packs(t), A.question_vectors(t), C.TOP_K, "rank")


def _candidates(t):
    return R.candidates(words(t), A.questions(t), packs(t), A.question_vectors(t))


@query("rrf_ranks", "qid long, chunk_id string, score double, sources string", "SELECT qid, chunk_id, score, sources FROM v_fused")
def rrf_ranks(t):
    return _candidates(t).withColumn("sources", F.array_join("sources", "+"))


def _top8(inner: str) -> str:
    return f"""SELECT * FROM (SELECT qid, chunk_id, score, sources, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) - 1 AS rank
FROM ({inner})) WHERE rank < 8"""


@query("hybrid_rrf", "qid long, chunk_id string, score double, sources string, rank long", _top8("SELECT * FROM v_fused"))
def hybrid_rrf(t):
    hits = R.hybrid(words(t), A.questions(t), packs(t), A.question_vectors(t))
    return hits.withColumn("sources", F.array_join("sources", "+"))


@query("hybrid_time_bias", "qid long, chunk_id string, score double, sources string, rank long", _top8("""
SELECT f.qid, f.chunk_id, f.sources, f.score * (1 + 0.15 / (1 + abs(d.start_ms - f.qid * 3600000) / 600000.0)) AS score
FROM v_fused f JOIN v_docs d ON d.chunk_id = f.chunk_id"""))
def hybrid_time_bias(t):
    fused = settle(_candidates(t))  # used twice below
    where = fused.join(A.docs(t).select("chunk_id", "start_ms"), "chunk_id").select(
        "qid", "chunk_id", F.abs(F.col("start_ms") - F.col("qid") * 3_600_000).alias("distance_ms")
    )
    hits = R.top(R.time_bias(fused, where), ["qid"], [F.round("score", 12).desc(), F.col("chunk_id")], C.TOP_K, "rank")
    return hits.withColumn("sources", F.array_join("sources", "+"))


@query("hybrid_in_chapter", "qid long, chunk_id string, score double, sources string, rank long", _top8("""
SELECT f.* FROM v_fused f JOIN v_docs d ON d.chunk_id = f.chunk_id WHERE d.chapter_idx % 2 = f.qid % 2"""))
def hybrid_in_chapter(t):
    parity = A.docs(t).select("chunk_id", "video_id", (F.col("chapter_idx") % 2).alias("p"))
    asked = A.question_vectors(t).select("qid", "video_id", (F.col("qid") % 2).alias("p"))
    within = asked.join(parity, ["video_id", "p"]).select("qid", "chunk_id")
    hits = R.hybrid(words(t), A.questions(t), packs(t), A.question_vectors(t), within=within)
    return hits.withColumn("sources", F.array_join("sources", "+"))


@query("rerank_head", "qid long, chunk_id string, score double, rank long", """
WITH hits AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) - 1 AS old_rank FROM v_fused),
sc AS (SELECT h.*, CASE WHEN h.old_rank < 10 THEN length(d.text) % 97 END AS ns FROM hits h JOIN v_docs d ON d.chunk_id = h.chunk_id)
---
SELECT qid, chunk_id, coalesce(ns, score) AS score, row_number() OVER (PARTITION BY qid ORDER BY ns IS NULL, ns DESC, old_rank) - 1 AS rank FROM sc""")
def rerank_head(t):
    hits = R.top(_candidates(t), ["qid"], [F.round("score", 12).desc(), F.col("chunk_id")], 64, "rank")
    scores = hits.join(A.docs(t).select("chunk_id", (F.length("text") % 97).cast("double").alias("new_score")), "chunk_id").select("qid", "chunk_id", "new_score")
    return R.rerank(hits, scores, head=10)


@query("hybrid_search", "qid long, chunk_id string, score double, sources string, rank long", f"""
WITH asked AS (SELECT item_id AS qid, 'src' || CAST(item_id % 20 AS VARCHAR) AS video_id, CASE WHEN item_id % 4 = 1 THEN item_id % 3 END AS ch, CASE WHEN item_id % 3 = 0 THEN item_id * 3600000 END AS at_ms FROM benchmark
  UNION ALL SELECT 100000 + item_id, 'src' || CAST(item_id % 20 AS VARCHAR), CASE WHEN item_id % 2 = 1 THEN item_id % 3 END, NULL FROM benchmark),
c AS (SELECT f.qid, f.chunk_id, f.sources, d.text, f.score * CASE WHEN a.at_ms IS NULL THEN 1.0 ELSE 1 + {C.TIME_BIAS_WEIGHT} / (1 + abs(d.start_ms - a.at_ms) / {C.TIME_BIAS_SCALE_MS}.0) END AS score
  FROM v_fused f JOIN asked a ON a.qid = f.qid JOIN v_docs d ON d.chunk_id = f.chunk_id WHERE a.ch IS NULL OR a.ch = d.chapter_idx),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) - 1 AS old FROM c),
q AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM p WHERE old < {max(C.TOP_K * 4, 20)}),
r AS (SELECT *, CASE WHEN n > 1 AND old < {max(C.RERANK_TOP_N * 6, 20)} THEN length(text) % 97 END AS ns FROM q),
ranked AS (SELECT qid, chunk_id, coalesce(ns, score) AS score, sources || CASE WHEN ns IS NULL THEN '' ELSE '+rerank' END AS sources, row_number() OVER (PARTITION BY qid ORDER BY ns IS NULL, ns DESC, old) - 1 AS rank FROM r),
opening AS (SELECT a.qid, d.chunk_id, row_number() OVER (PARTITION BY a.qid ORDER BY d.idx) - 1 AS rank FROM asked a JOIN v_docs d ON d.video_id = a.video_id AND (a.ch IS NULL OR a.ch = d.chapter_idx) WHERE a.qid NOT IN (SELECT qid FROM v_fused))
---
SELECT qid, chunk_id, score, sources, rank FROM ranked WHERE rank < {C.TOP_K} UNION ALL SELECT qid, chunk_id, 0, 'fallback', rank FROM opening WHERE rank < 5""")
def hybrid_search(t):
    """every benchmark item, some in a chapter, some with a playing position; and as many questions that find nothing"""
    n = F.col("item_id")
    docs = A.docs(t)

    def wish(qid, chapter, at):
        name = F.concat(A.course_of(n), F.lit("-ch"), F.lpad((n % 3).cast("string"), 3, "0"))
        return t.benchmark.select(
            qid.cast("long").alias("qid"), A.course_of(n).alias("video_id"), F.when(chapter, name).alias("chapter_id"), at.cast("long").alias("at_ms")
        )

    asked = wish(n, n % 4 == 1, F.when(n % 3 == 0, n * 3_600_000)).unionByName(wish(n + 100_000, n % 2 == 1, F.lit(None)))
    nothing = t.benchmark.select((n + 100_000).alias("qid"), A.course_of(n).alias("video_id"), F.lit("qqzzxq").alias("term"))

    def scorer(hits):
        return hits.join(docs.select("chunk_id", (F.length("text") % 97).cast("double").alias("new_score")), "chunk_id").select("qid", "chunk_id", "new_score")

    found = R.search(asked, docs, A.questions(t).unionByName(nothing), packs(t), A.question_vectors(t), scorer=scorer, index=words(t))
    return found.withColumn("sources", F.array_join("sources", "+"))


@query("search_fallback", "qid long, chunk_id string, source string", """
WITH asked AS (SELECT conv_id * 100 + turn AS qid, 'src' || CAST(conv_id % 20 AS VARCHAR) AS video_id, CASE WHEN conv_id % 3 = 0 THEN 'qqzz' || conv_id || ' zzxq' ELSE text END AS text FROM conversations WHERE role = 'user'),
terms AS (SELECT DISTINCT qid, video_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2)) AS term FROM asked),
found AS (SELECT DISTINCT q.qid FROM terms q JOIN (SELECT DISTINCT video_id, unnest(toks) AS term FROM v_tokens) d ON d.video_id = q.video_id AND d.term = q.term),
opening AS (SELECT video_id, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS rn FROM v_docs)
---
SELECT a.qid, o.chunk_id, 'fallback' AS source FROM asked a JOIN opening o ON o.video_id = a.video_id AND o.rn <= 5
WHERE a.qid NOT IN (SELECT qid FROM found)""")
def search_fallback(t):
    # every third conversation asks for words that no document has
    sid = F.col("session_id")
    nothing = F.concat(F.lit("qqzz"), sid.cast("string"), F.lit(" zzxq"))
    asked = A.messages(t).filter("role = 'user'").select(
        F.col("id").alias("qid"), "video_id", F.when(sid % 3 == 0, nothing).otherwise(F.col("content")).alias("content")
    )
    terms = asked.select("qid", "video_id", F.explode(text.query_terms(F.col("content"))).alias("term"))
    return R.fallback(asked, R.answered(words(t), terms), A.docs(t))


# ------------------------------------------------------------------ in-course and cross-course search

_ASKED = """
SELECT event_id AS qid, 'u' || user_id AS video_id, replace(replace(props, '{', ''), '}', '') AS q FROM events WHERE event_type = 'signup'"""


@query("cross_course_search", "qid long, video_id string, chunk_id string, title string, label string, text string, score double, rank long", """
WITH per AS (SELECT qid, doc_video, chunk_id, idx, score, row_number() OVER (PARTITION BY qid, doc_video ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM v_bm25),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM per WHERE rn <= 5)
---
SELECT b.qid, b.doc_video AS video_id, b.chunk_id, 'Course ' || b.doc_video AS title,
  CASE WHEN d.start_ms // 3600000 > 0 THEN printf('%02d:%02d:%02d', d.start_ms // 3600000, d.start_ms // 60000 % 60, d.start_ms // 1000 % 60) ELSE printf('%02d:%02d', d.start_ms // 60000, d.start_ms // 1000 % 60) END AS label,
  d.text[1:240] AS text, b.score, b.rank FROM best b JOIN v_docs d ON d.chunk_id = b.chunk_id WHERE rank < 10""")
def cross_course_search(t):
    return S.cross_course(A.questions(t), A.docs(t), A.courses(t), index=words(t))


@query("cross_topk", "qid long, chunk_id string, score double, rank long", """
WITH per AS (SELECT qid, doc_video, chunk_id, score, row_number() OVER (PARTITION BY qid, doc_video ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM v_bm25)
---
SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM per WHERE rn <= 2) WHERE rank < 8""")
def cross_topk(t):
    scores = R.bm25(words(t), A.questions(t), scoped=False, k=2)
    order = [F.round("score", 9).desc(), F.col("chunk_id")]
    return R.top(R.top(scores, ["qid", "video_id"], order, 2), ["qid"], order, 8, "rank")


@query("series_evidence", "qid long, evidence string", """
WITH per AS (SELECT qid, doc_video, chunk_id, score, row_number() OVER (PARTITION BY qid, doc_video ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM v_bm25),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM per WHERE rn <= 5)
---
SELECT b.qid, string_agg('- 《Course ' || b.doc_video || '》[' || CASE WHEN d.start_ms // 3600000 > 0 THEN printf('%02d:%02d:%02d', d.start_ms // 3600000, d.start_ms // 60000 % 60, d.start_ms // 1000 % 60) ELSE printf('%02d:%02d', d.start_ms // 60000, d.start_ms // 1000 % 60) END
  || '] ' || d.text[1:240], chr(10) ORDER BY rank) AS evidence FROM best b JOIN v_docs d ON d.chunk_id = b.chunk_id WHERE rank < 10 GROUP BY b.qid""")
def series_evidence(t):
    return S.evidence_text(cross_course_search(t))
