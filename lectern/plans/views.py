"""SQL side of the adapters: the shared tables seen as usage log, transcript, slides, chunks, ...

Each entry is one common table expression; later ones may use earlier ones. The Spark side of the
same adapters is in ``adapters.py``.
"""

from __future__ import annotations

from lectern import constants as C

_PRICES = ", ".join(f"('{m}', '{t}', {h}, {i}, {o})" for m, t, h, i, o in C.PRICES)

_LOCAL = "(ts + INTERVAL 8 HOUR)"

VIEWS: dict[str, str] = {}

VIEWS["v_calls"] = f"""
SELECT event_id, ts AS called_at, 'u' || user_id AS video_id, event_type AS kind,
       CASE event_id % 3 WHEN 0 THEN 'deepseek-flash' WHEN 1 THEN 'deepseek-v4-pro' ELSE 'local-model' END AS model,
       CAST(floor(value * 100) AS BIGINT) AS prompt_tokens,
       CAST(floor((event_id % 120) * floor(value * 100) / 100) AS BIGINT) AS cached_tokens,
       (event_id % 50) * 10 AS completion_tokens,
       CAST(floor(value * 1000) AS BIGINT) AS audio_ms,
       (isodow({_LOCAL}) <= 5 AND (hour({_LOCAL}) BETWEEN 9 AND 11 OR hour({_LOCAL}) BETWEEN 14 AND 17)) AS peak
FROM events"""

VIEWS["v_prices"] = f"SELECT * FROM (VALUES {_PRICES}) AS p(model, tier, hit, miss, outp)"

VIEWS["v_usage"] = """
SELECT c.*, (least(cached_tokens, prompt_tokens) * hit
             + (prompt_tokens - least(cached_tokens, prompt_tokens)) * miss
             + completion_tokens * outp) / 1000000.0 AS cost
FROM v_calls c LEFT JOIN v_prices p
  ON p.model = c.model AND p.tier = CASE WHEN peak THEN 'peak' ELSE 'off_peak' END"""

VIEWS["v_segments"] = """
SELECT 'u' || user_id AS video_id, event_id AS seg_id,
       CAST(floor(epoch(ts)) AS BIGINT) AS start_ms,
       CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 100) AS BIGINT) AS end_ms,
       event_type || ' ' || props AS text, CAST(event_id % 4 AS VARCHAR) AS speaker
FROM events"""

VIEWS["v_seg_idx"] = """
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seg_id) - 1 AS idx FROM v_segments"""

VIEWS["v_slides"] = """
SELECT video_id, seg_id AS slide_id, start_ms,
       coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, seg_id), start_ms + 1000) AS end_ms,
       'slide ' || text AS ocr_text
FROM v_segments WHERE text LIKE 'view %'"""

# transcript chunks: the resetting fold written as a recursive walk over row numbers
VIEWS["v_runs"] = f"""
SELECT idx AS rn, video_id, start_ms, end_ms, start_ms AS run_start, CAST(0 AS BIGINT) AS run
FROM v_seg_idx WHERE idx = 0
UNION ALL
SELECT s.idx, s.video_id, s.start_ms, s.end_ms,
       CASE WHEN (s.end_ms - r.run_start >= {C.CHUNK_MIN_MS} AND s.start_ms - r.end_ms >= {C.CHUNK_GAP_MS})
              OR s.end_ms - r.run_start >= {C.CHUNK_MAX_MS} THEN s.start_ms ELSE r.run_start END,
       CASE WHEN (s.end_ms - r.run_start >= {C.CHUNK_MIN_MS} AND s.start_ms - r.end_ms >= {C.CHUNK_GAP_MS})
              OR s.end_ms - r.run_start >= {C.CHUNK_MAX_MS} THEN r.run + 1 ELSE r.run END
FROM v_runs r JOIN v_seg_idx s ON s.video_id = r.video_id AND s.idx = r.rn + 1"""

VIEWS["v_chunks"] = f"""
SELECT s.video_id, r.run AS idx, s.video_id || '-c' || printf('%04d', r.run) AS chunk_id,
       min(s.start_ms) AS start_ms, arg_max(s.end_ms, s.idx) AS end_ms, count(*) AS n_segments,
       string_agg(CASE WHEN speaker NOT IN ('', '0', '1') THEN '[' || speaker || '] ' || text ELSE text END, chr(10) ORDER BY s.idx) AS text
FROM v_seg_idx s JOIN v_runs r ON r.video_id = s.video_id AND r.rn = s.idx
GROUP BY s.video_id, r.run"""

# chapters over those chunks; the adapter's axis is coarse, so the limits are scaled
VIEWS["v_chapter_runs"] = """
SELECT idx AS rn, video_id, start_ms, end_ms, start_ms AS run_start, CAST(0 AS BIGINT) AS run
FROM v_chunks WHERE idx = 0
UNION ALL
SELECT s.idx, s.video_id, s.start_ms, s.end_ms,
       CASE WHEN s.start_ms - r.end_ms >= 60000 OR s.end_ms - r.run_start >= 600000 THEN s.start_ms ELSE r.run_start END,
       CASE WHEN s.start_ms - r.end_ms >= 60000 OR s.end_ms - r.run_start >= 600000 THEN r.run + 1 ELSE r.run END
FROM v_chapter_runs r JOIN v_chunks s ON s.video_id = r.video_id AND s.idx = r.rn + 1"""

VIEWS["v_chapters"] = """
SELECT c.video_id, r.run AS idx, c.video_id || '-ch' || printf('%03d', r.run) AS chapter_id,
       min(c.start_ms) AS start_ms, arg_max(c.end_ms, c.idx) AS end_ms, count(*) AS n_chunks
FROM v_chunks c JOIN v_chapter_runs r ON r.video_id = c.video_id AND r.rn = c.idx
GROUP BY c.video_id, r.run"""

# documents as chunks of a course (course = source)
VIEWS["v_docs"] = """
SELECT source AS video_id, doc_id AS idx, source || '-c' || printf('%04d', doc_id) AS chunk_id,
       doc_id * 120000 AS start_ms, doc_id * 120000 + greatest(1000, 5 * length(text)) AS end_ms,
       text, lang, string_split(text, chr(10))[1] AS title,
       coalesce(string_split(text, chr(10))[2], '') AS summary,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(string_split(text, chr(10))[3], '') END AS ocr_text,
       source || '-ch' || lpad(CAST(doc_id // 100 AS VARCHAR), 3, '0') AS parent_id,
       doc_id // 100 AS chapter_idx
FROM documents"""

# one chapter per hundred document numbers of a course
VIEWS["v_doc_chapters"] = """
SELECT video_id, parent_id AS chapter_id, chapter_idx AS idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
       CASE WHEN chapter_idx % 2 = 0 THEN arg_min(title, idx) ELSE '' END AS title, arg_min(summary, idx) AS summary
FROM v_docs GROUP BY video_id, parent_id, chapter_idx"""

# words of documents, accents folded
VIEWS["v_tokens"] = """
SELECT video_id, idx, chunk_id,
       list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS toks
FROM v_docs"""

# one search question per benchmark item: all its words, asked in one course
VIEWS["v_questions"] = """
SELECT item_id AS qid, 'src' || CAST(item_id % 20 AS VARCHAR) AS video_id, term
FROM (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2)) AS term
      FROM benchmark)"""

VIEWS["v_bm25"] = f"""
SELECT q.qid, q.video_id, h.video_id AS doc_video, h.idx, h.chunk_id, sum(
         greatest(ln((s.n - d.df + 0.5) / (d.df + 0.5)), {C.BM25_MIN_IDF})
         * h.tf * {C.BM25_K1 + 1} / (h.tf + {C.BM25_K1} * ({1 - C.BM25_B} + {C.BM25_B} * h.dl / s.avgdl))) AS score
FROM v_questions q
JOIN (SELECT video_id, idx, chunk_id, len(toks) AS dl, term, count(*) AS tf
      FROM (SELECT video_id, idx, chunk_id, toks, unnest(toks) AS term FROM v_tokens)
      GROUP BY ALL) h ON h.term = q.term
JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT idx, unnest(toks) AS term FROM v_tokens) GROUP BY term) d ON d.term = q.term
CROSS JOIN (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM v_tokens) s
GROUP BY ALL"""

# vectors: chunk of the same number; the question of benchmark item i is vector i
VIEWS["v_vectors"] = """
SELECT e.vec_id AS idx, d.video_id, d.chunk_id, e.embedding AS vec, e.label
FROM embeddings e JOIN v_docs d ON d.idx = e.vec_id"""

VIEWS["v_vector_hits"] = """
SELECT b.item_id AS qid, v.video_id, v.idx, v.chunk_id,
       round(CAST(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.vec AS DOUBLE[])) AS DOUBLE)
       / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
          * sqrt(list_dot_product(CAST(v.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[])))), 9) AS score
FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id
JOIN v_vectors v ON v.video_id = 'src' || CAST(b.item_id % 20 AS VARCHAR)
WHERE len(q.embedding) = len(v.vec)"""

VIEWS["v_fused"] = f"""
SELECT qid, video_id, idx, chunk_id, sum(1.0 / ({C.RRF_K} + rank)) AS score,
       string_agg(src, '+' ORDER BY src) AS sources
FROM (
  SELECT qid, video_id, idx, chunk_id, 'keyword' AS src,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank
  FROM v_bm25 WHERE doc_video = video_id
  UNION ALL
  SELECT qid, video_id, idx, chunk_id, 'vector',
         row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank
  FROM v_vector_hits)
WHERE rank < {max(C.TOP_K * 4, 20)}
GROUP BY ALL"""

# chat
VIEWS["v_messages"] = """
SELECT conv_id AS session_id, conv_id * 100 + turn AS id, role, text AS content,
       'src' || CAST(conv_id % 20 AS VARCHAR) AS video_id,
       CAST(conv_id * 86400 + turn * 60 AS BIGINT) AS created_s
FROM conversations"""

VIEWS["v_sessions"] = """
SELECT session_id, video_id, CASE WHEN session_id % 5 = 0 THEN 'session ' || session_id ELSE '' END AS title,
       session_id % 7 = 0 AS archived, min(created_s) AS created_s, max(created_s) AS updated_s
FROM v_messages GROUP BY session_id, video_id"""

# courses: one per source, with a file path
VIEWS["v_courses"] = """
SELECT source AS video_id, 'library/' || min(lang) || '/' || source || '.mp4' AS path,
       'Course ' || source AS title, sum(n_chars) * 50 AS duration_ms, count(*) AS n_docs
FROM documents GROUP BY source"""

# courses and remembered titles of the usage log
VIEWS["v_user_courses"] = """
SELECT 'u' || user_id AS video_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'Course ' || user_id END AS title,
       sum(CAST(floor(value * 1000) AS BIGINT)) AS duration_ms, min('lib/' || event_type || '/' || user_id || '.mp4') AS path
FROM events WHERE user_id % 3 <> 0 GROUP BY user_id"""

VIEWS["v_user_labels"] = """
SELECT DISTINCT 'u' || user_id AS video_id, 'Old ' || user_id AS title FROM events WHERE user_id % 2 = 0"""
