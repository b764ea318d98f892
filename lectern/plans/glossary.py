"""Glossary queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import glossary as G
from lectern.plans import adapters as A, shelves
from lectern.plans.registry import query
from lectern.plans.views import VIEWS

# rules from benchmark items: the two longest words of an item are wrong forms, the longest in
# capitals is right; every third item is a global rule, the others belong to one course
VIEWS["v_rules"] = r"""
SELECT item_id AS ord, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'src' || CAST(item_id % 20 AS VARCHAR) END AS video_id,
       max(w) FILTER (rn = 1) AS w1, max(w) FILTER (rn = 2) AS w2, upper(max(w) FILTER (rn = 1)) AS rgt
FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS rn
      FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark))
WHERE rn <= 2 GROUP BY item_id"""

# replacement steps of every course, in order
VIEWS["v_steps"] = """
SELECT video_id, rule_no, w, rgt, w1, row_number() OVER (PARTITION BY video_id ORDER BY rule_no, vn) AS step FROM (
  SELECT video_id, rule_no, unnest([w1, w2]) AS w, unnest([1, 2]) AS vn, rgt, w1 FROM (
    SELECT c.video_id, r.*, row_number() OVER (PARTITION BY c.video_id ORDER BY length(w1) DESC, r.video_id <> '', ord) AS rule_no
    FROM (SELECT DISTINCT source AS video_id FROM documents) c JOIN (SELECT ord, video_id, w1, w2, rgt FROM v_rules) r(ord, video_id, w1, w2, rgt) ON r.video_id IN ('', c.video_id)))"""
VIEWS["v_steps"] = VIEWS["v_steps"].replace("SELECT c.video_id, r.*,", "SELECT c.video_id, r.w1, r.w2, r.rgt,")

VIEWS["v_fields"] = """
SELECT video_id, idx, 'text' AS field, text AS body FROM v_docs UNION ALL SELECT video_id, idx, 'title', title FROM v_docs
UNION ALL SELECT video_id, idx, 'summary', summary FROM v_docs UNION ALL SELECT video_id, idx, 'ocr_text', ocr_text FROM v_docs"""

VIEWS["v_fixed"] = """
SELECT video_id, idx, field, CAST(0 AS BIGINT) AS step, body, CAST(0 AS BIGINT) AS n, '' AS w1, '' AS rgt FROM v_fields
UNION ALL
SELECT f.video_id, f.idx, f.field, s.step, replace(f.body, s.w, s.rgt),
       CAST((length(f.body) - length(replace(f.body, s.w, ''))) / length(s.w) AS BIGINT), s.w1, s.rgt
FROM v_fixed f JOIN v_steps s ON s.video_id = f.video_id AND s.step = f.step + 1"""

FIELDS = ["text", "title", "summary", "ocr_text"]

# every text of a course, not only its chunks
VIEWS["v_parts"] = """
SELECT video_id, 'chunks' AS part, body FROM v_fields UNION ALL SELECT video_id, 'segments', unnest(string_split(text, chr(10))) FROM v_docs
UNION ALL SELECT video_id, 'chapters', title FROM v_doc_chapters UNION ALL SELECT video_id, 'chapters', summary FROM v_doc_chapters
UNION ALL SELECT video_id, 'slides', string_split(text, chr(10))[4] FROM v_docs WHERE len(string_split(text, chr(10))) >= 4
UNION ALL SELECT video_id, 'courses', arg_min(summary, idx) FROM v_docs GROUP BY video_id"""

VIEWS["v_parts_fixed"] = """
SELECT video_id, part, CAST(0 AS BIGINT) AS step, body, CAST(0 AS BIGINT) AS n FROM v_parts
UNION ALL
SELECT f.video_id, f.part, s.step, replace(f.body, s.w, s.rgt), CAST((length(f.body) - length(replace(f.body, s.w, ''))) / length(s.w) AS BIGINT)
FROM v_parts_fixed f JOIN v_steps s ON s.video_id = f.video_id AND s.step = f.step + 1"""


VIEWS["v_item_words_all"] = """SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark"""


def item_words(t):
    return t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("term"))


def rules(t):
    words = t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    w = Window.partitionBy("item_id").orderBy(F.length("w").desc(), "w")
    best = words.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    wide = best.groupBy("item_id").agg(F.max(F.when(F.col("rn") == 1, F.col("w"))).alias("w1"), F.max(F.when(F.col("rn") == 2, F.col("w"))).alias("w2"))
    return wide.select(
        F.when(F.col("item_id") % 3 == 0, "").otherwise(A.course_of(F.col("item_id"))).alias("video_id"),
        F.array("w1", "w2").alias("wrong"), F.upper("w1").alias("right"), F.lit("benchmark").alias("reason"), F.col("item_id").alias("ord"),
    )


def repaired(t):
    return G.repair(A.docs(t), rules(t), FIELDS)


@query("glossary_correct", "chunk_id string, text string, n long", """
SELECT d.chunk_id, f.body AS text, c.n FROM v_docs d
JOIN (SELECT idx, arg_max(body, step) AS body FROM v_fixed WHERE field = 'text' GROUP BY idx) f ON f.idx = d.idx
JOIN (SELECT idx, sum(n) AS n FROM v_fixed WHERE field = 'text' GROUP BY idx) c ON c.idx = d.idx""")
def glossary_correct(t):
    return G.repair(A.docs(t), rules(t), ["text"]).withColumn("n", G.n_fixes(F.col("fixes_text")))


@query("repair_report", "video_id string, text long, title long, summary long, ocr_text long", """
SELECT video_id, sum(n) FILTER (field = 'text') AS text, sum(n) FILTER (field = 'title') AS title,
       sum(n) FILTER (field = 'summary') AS summary, sum(n) FILTER (field = 'ocr_text') AS ocr_text FROM v_fixed GROUP BY video_id""")
def repair_report(t):
    return G.repair_report(repaired(t), FIELDS)


@query("repair_courses", "chunk_id string, text string, title string, summary string, ocr_text string", """
WITH last AS (SELECT idx, field, arg_max(body, step) AS body, sum(n) AS n FROM v_fixed GROUP BY idx, field)
---
SELECT d.chunk_id, max(body) FILTER (field = 'text') AS text, max(body) FILTER (field = 'title') AS title, max(body) FILTER (field = 'summary') AS summary,
       max(body) FILTER (field = 'ocr_text') AS ocr_text FROM v_docs d JOIN last l ON l.idx = d.idx GROUP BY d.chunk_id HAVING sum(n) > 0""")
def repair_courses(t):
    total = F.lit(0)
    for f in FIELDS:
        total = total + F.size(f"fixes_{f}")
    return repaired(t).filter(total > 0)


@query("repair_library", "video_id string, part string, n long", "SELECT video_id, part, sum(n) AS n FROM v_parts_fixed GROUP BY ALL HAVING sum(n) > 0")
def repair_library(t):
    d = A.docs(t)
    rows_of = F.split("text", "\n")
    tables = {
        "chunks": d, "segments": d.select("video_id", F.explode(rows_of).alias("text")), "chapters": A.doc_chapters(t),
        "slides": d.filter(F.size(rows_of) >= 4).select("video_id", F.get(rows_of, F.lit(3)).alias("ocr_text")),
        "courses": d.groupBy("video_id").agg(F.min_by("summary", "idx").alias("video_summary")),
    }
    return G.repair_library(tables, rules(t))[1]


@query("repair_stored", "chunk_id string, text string, title string, summary string, ocr_text string, length double", """
WITH last AS (SELECT idx, field, arg_max(body, step) AS body FROM v_fixed GROUP BY idx, field)
---
SELECT d.chunk_id, max(body) FILTER (field = 'text') AS text, max(body) FILTER (field = 'title') AS title, max(body) FILTER (field = 'summary') AS summary,
       max(body) FILTER (field = 'ocr_text') AS ocr_text, length(max(body) FILTER (field = 'text')) AS length FROM v_docs d JOIN last l ON l.idx = d.idx GROUP BY d.chunk_id""")
def repair_stored(t):
    """a stored library after its repair: all chunks, each with the vector of its present text"""
    embed = lambda rows: rows.select("video_id", "chunk_id", F.array(F.length("text").cast("double")).alias("vec"))
    library, chunks = shelves.temporary_library(t), A.docs(t).select("video_id", "chunk_id", *FIELDS)
    library.create(chunks, embed(chunks))
    G.repair_stored(library, rules(t), embed)
    return library.chunks.all().join(library.vectors.all(), ["video_id", "chunk_id"]).withColumn("length", F.get("vec", F.lit(0)))


@query("fix_merge", "wrong string, right_form string, n long", """
SELECT w1 AS wrong, rgt AS right_form, sum(n) AS n FROM v_fixed WHERE n > 0 GROUP BY w1, rgt""")
def fix_merge(t):
    return G.merge_fixes(repaired(t), FIELDS).withColumnRenamed("right", "right_form")


@query("glossary_rules", "video_id string, pos long, wrong string, right_form string", """
SELECT video_id, rule_no - 1 AS pos, string_agg(w, '|' ORDER BY step) AS wrong, any_value(rgt) AS right_form FROM v_steps GROUP BY video_id, rule_no""")
def glossary_rules(t):
    blank = rules(t).withColumn("wrong", F.transform("wrong", lambda w: F.concat(F.lit(" "), w)))
    empty = rules(t).withColumn("right", F.lit(" "))
    loaded = G.with_rules(A.courses(t).select("video_id"), blank.unionByName(empty))
    rows = loaded.select("video_id", F.posexplode("rules").alias("pos", "r"))
    return rows.select("video_id", "pos", F.array_join("r.wrong", "|").alias("wrong"), F.col("r.right").alias("right_form"))


@query("glossary_upsert", "video_id string, wrong string, right_form string, ord long", """
WITH old AS (SELECT 'src' || CAST(ord % 20 AS VARCHAR) AS video_id, w1 AS wrong, rgt AS r, ord, 0 AS v FROM v_rules),
fresh AS (SELECT 'src' || CAST(ord % 20 AS VARCHAR) AS video_id, CASE WHEN ord % 2 = 0 THEN w1 ELSE w2 END AS wrong, 'new ' || w2 AS r, ord + 1000 AS ord, 1 AS v FROM v_rules)
---
SELECT video_id, wrong, arg_max(r, v * 100000 + ord) AS right_form, min(ord) AS ord FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) GROUP BY video_id, wrong""")
def glossary_upsert(t):
    base = rules(t).withColumn("video_id", A.course_of(F.col("ord")))
    w1, w2 = F.get("wrong", F.lit(0)), F.get("wrong", F.lit(1))
    old = base.select("video_id", w1.alias("wrong"), "right", "reason", "ord")
    new = base.select("video_id", F.when(F.col("ord") % 2 == 0, w1).otherwise(w2).alias("wrong"), F.concat(F.lit(" new "), w2).alias("right"), F.lit("edit").alias("reason"), (F.col("ord") + 1000).alias("ord"))
    blank = base.select("video_id", F.lit(" ").alias("wrong"), "right", "reason", "ord")
    return G.upsert(old, new.unionByName(blank)).withColumnRenamed("right", "right_form")


# ------------------------------------------------------------------ suspicious terms

# the page with some letters set apart, its address, and the address with the first host letter lost
VIEWS["v_page_text"] = r"""SELECT page_id, replace(html, 'nav>', 'n a v>') || ' ' || url || ' ' || regexp_replace(url, '^(https?://)[a-z]', '\1') AS body FROM pages"""


def page_text(t):
    short = F.regexp_replace("url", "^(https?://)[a-z]", "$1")
    return t.pages.select("page_id", F.concat_ws(" ", F.replace("html", F.lit("nav>"), F.lit("n a v>")), "url", short).alias("body"))


_IDENTS = r"""
SELECT page_id, token, count(*) AS n, min(pos) AS pos, regexp_replace(lower(token), '[^a-z0-9]', '', 'g') AS skel FROM (
  SELECT page_id, unnest(f) AS token, generate_subscripts(f, 1) AS pos FROM (SELECT page_id, regexp_extract_all(body, '[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+') AS f FROM v_page_text))
GROUP BY page_id, token"""

_VARIANTS = f"""
SELECT a.page_id, a.token || ' / ' || b.token AS term, 'inconsistent' AS kind, a.n + b.n AS n
FROM (SELECT *, min(pos) OVER (PARTITION BY page_id, skel) AS spos FROM ({_IDENTS})) a
JOIN (SELECT *, min(pos) OVER (PARTITION BY page_id, skel) AS spos FROM ({_IDENTS})) b
  ON b.page_id = a.page_id AND a.spos < b.spos AND levenshtein(a.skel, b.skel) = 1
 AND regexp_replace(a.skel, '[^0-9]', '', 'g') = regexp_replace(b.skel, '[^0-9]', '', 'g')"""


@query("identifier_counts", "page_id long, token string, n long", f"SELECT page_id, token, n FROM ({_IDENTS})")
def identifier_counts(t):
    return G.identifiers(page_text(t), "page_id", "body")


@query("identifier_variants", "page_id long, term string, n long", f"SELECT page_id, term, n FROM ({_VARIANTS})")
def identifier_variants(t):
    return G.spelling_variants(G.identifiers(page_text(t), "page_id", "body"), "page_id")


_SPACED = r"SELECT page_id, unnest(regexp_extract_all(body, '\b(?:[A-Za-z]\s){2,}[A-Za-z]\b')) AS term, 'spaced_letters' AS kind, 1 AS n FROM v_page_text"
_QUOTED = r"""SELECT page_id, term, 'quoted_phrase' AS kind, 1 AS n FROM (
  SELECT page_id, trim(unnest(regexp_extract_all(body, '["“]([A-Za-z][A-Za-z0-9 _./\\+-]{2,})["”]', 1))) AS term FROM v_page_text)
WHERE term LIKE '% %' AND len(list_filter(regexp_extract_all(term, '[A-Za-z]+'), lambda w: w = lower(w))) > 0 AND lower(term) <> 'buildprop enhancer'"""
_LISTED = """SELECT p.page_id, r.w AS term, 'listed' AS kind, CAST((length(body) - length(replace(body, r.w, ''))) / length(r.w) AS BIGINT) AS n
FROM v_page_text p JOIN (SELECT DISTINCT w FROM v_item_words_all) r ON contains(p.body, r.w)"""


@query("suspicious_patterns", "page_id long, kind string, term string, n long", f"""
SELECT page_id, kind, term, count(*) AS n FROM (SELECT * FROM ({_SPACED}) UNION ALL SELECT * FROM ({_QUOTED})) GROUP BY ALL""")
def suspicious_patterns(t):
    body = F.col("body")
    kinds = page_text(t).select(
        "page_id",
        F.explode(F.concat(
            F.transform(G.spaced_letters(body), lambda x: F.struct(F.lit("spaced_letters").alias("kind"), x.alias("term"))),
            F.transform(G.quoted_phrases(body), lambda x: F.struct(F.lit("quoted_phrase").alias("kind"), x.alias("term"))),
        )).alias("f"),
    )
    return kinds.groupBy("page_id", "f.kind", "f.term").agg(F.count("*").alias("n"))


_FLAGS = f"""
SELECT page_id, term, kind, sum(n) AS n FROM (SELECT * FROM ({_SPACED}) UNION ALL SELECT * FROM ({_QUOTED}) UNION ALL SELECT * FROM ({_LISTED}) UNION ALL SELECT * FROM ({_VARIANTS}))
GROUP BY page_id, term, kind"""


def suspects(t):
    """every word of every benchmark item"""
    return item_words(t).select("term").distinct()


@query("glossary_flag", "page_id long, term string, kind string, n long", f"""
WITH f AS ({_FLAGS})
---
SELECT * FROM f WHERE kind <> 'listed' OR NOT EXISTS (SELECT 1 FROM f o WHERE o.page_id = f.page_id AND o.kind <> 'listed' AND contains(o.term, f.term))""")
def glossary_flag(t):
    return G.flag(page_text(t), "page_id", "body", suspects(t))


@query("finding_merge", "kind string, term string, n_pages long, n long", f"""
SELECT kind, term, count(*) AS n_pages, sum(n) AS n FROM ({_FLAGS}) WHERE kind <> 'listed' GROUP BY kind, term""")
def finding_merge(t):
    found = G.flag(page_text(t), "page_id", "body")
    return found.groupBy("kind", "term").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n"))


# ------------------------------------------------------------------ evidence

VIEWS["v_sources"] = """
SELECT video_id, 0 AS priority, 0 AS grp, 0 AS source_no, idx, '课件OCR' AS label, start_ms AS ms, string_split(text, chr(10))[4] AS text, true AS trusted FROM v_docs WHERE len(string_split(text, chr(10))) >= 4
UNION ALL SELECT video_id, 0, 1, 1, idx, '片段内课件', start_ms, ocr_text, true FROM v_docs
UNION ALL SELECT video_id, 1, 2, 2, idx, '章节摘要', start_ms, summary, false FROM v_doc_chapters
UNION ALL SELECT video_id, 1, 3, 3, idx, '片段摘要', start_ms, summary, false FROM v_docs
UNION ALL SELECT video_id, 1, 3, 4, idx, '片段正文', start_ms, text, true FROM v_docs
UNION ALL SELECT video_id, 1, 4, 5, 0, '全课摘要', NULL, arg_min(title, idx), false FROM v_docs GROUP BY video_id
UNION ALL SELECT video_id, 2, 5, 6, idx * 100000 + i, '转写', start_ms, line, true FROM (SELECT video_id, idx, start_ms, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT video_id, idx, start_ms, string_split(text, chr(10)) AS ls FROM v_docs))"""

VIEWS["v_terms"] = """
SELECT DISTINCT 'src' || CAST(c AS VARCHAR) AS video_id, w AS term FROM (SELECT *, unnest([item_id % 20, (item_id + 7) % 20]) AS c FROM v_item_words_all WHERE length(w) >= 7)"""

# positions of the non-overlapping occurrences: pieces between them, summed up
VIEWS["v_contexts"] = """
SELECT video_id, term, priority, grp, source_no, idx, label, ms, trusted, occ,
       replace(text[greatest(0, at0 - 110) + 1:least(length(text), at0 + length(term) + 110)], chr(10), ' ') AS snippet
FROM (SELECT *, sum(length(piece)) OVER w + (occ - 1) * length(term) AS at0
      FROM (SELECT s.*, t.term, unnest(string_split(s.text, t.term)) AS piece, generate_subscripts(string_split(s.text, t.term), 1) AS occ, len(string_split(s.text, t.term)) AS pieces
            FROM v_sources s JOIN v_terms t ON t.video_id = s.video_id AND contains(s.text, t.term))
      WINDOW w AS (PARTITION BY video_id, term, source_no, idx ORDER BY occ))
WHERE occ < pieces"""

_LABEL = """CASE WHEN ms IS NULL THEN '' WHEN ms // 3600000 > 0 THEN '[' || printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) || '] ' ELSE '[' || printf('%02d:%02d', ms // 60000, ms // 1000 % 60) || '] ' END"""


def sources(t):
    d = A.docs(t)
    rows_of = F.split("text", "\n")
    slides = d.filter(F.size(rows_of) >= 4).withColumn("shown", F.get(rows_of, F.lit(3)))
    sentences = d.select("video_id", "idx", "start_ms", F.posexplode(rows_of).alias("i", "line"))
    courses = d.groupBy("video_id").agg(F.min_by("title", "idx").alias("title"))

    def one(priority, grp, number, label, body, trusted, rows=d, idx=F.col("idx"), ms=F.col("start_ms")):
        return rows.select(
            "video_id", F.lit(priority).alias("priority"), F.lit(grp).alias("grp"), F.lit(number).alias("source_no"), idx.cast("long").alias("idx"),
            F.lit(label).alias("label"), ms.cast("long").alias("ms"), F.col(body).alias("text"), F.lit(trusted).alias("trusted"),
        )

    return (
        one(0, 0, 0, "课件OCR", "shown", True, slides)
        .unionByName(one(0, 1, 1, "片段内课件", "ocr_text", True))
        .unionByName(one(1, 2, 2, "章节摘要", "summary", False, A.doc_chapters(t)))
        .unionByName(one(1, 3, 3, "片段摘要", "summary", False))
        .unionByName(one(1, 3, 4, "片段正文", "text", True))
        .unionByName(one(1, 4, 5, "全课摘要", "title", False, courses, F.lit(0), F.lit(None)))
        .unionByName(one(2, 5, 6, "转写", "line", True, sentences, F.col("idx") * 100_000 + F.col("i") + 1))
    )


def open_terms(t):
    """every word of seven letters or more of every benchmark item, open in two courses: an open term is a rare, long word"""
    n = F.col("item_id")
    return item_words(t).filter(F.length("term") >= 7).select(F.explode(F.array(A.course_of(n), A.course_of(n + 7))).alias("video_id"), "term").distinct()


@query("term_contexts", "video_id string, term string, rank long, line string", f"""
WITH once AS (SELECT video_id, term, lower(regexp_replace(snippet, '[\\s\\x{{3000}}]+', '', 'g')) AS k, arg_min(label || ' ' || {_LABEL} || '…' || snippet || '…', (priority, grp, idx, source_no, occ)) AS line,
  min((priority, grp, idx, source_no, occ)) AS o FROM v_contexts GROUP BY ALL)
---
SELECT * FROM (SELECT video_id, term, line, row_number() OVER (PARTITION BY video_id, term ORDER BY o) - 1 AS rank FROM once) WHERE rank < 8""")
def term_contexts(t):
    return G.best_contexts(G.contexts(sources(t), open_terms(t)))


_VERDICTS = """
SELECT video_id, term, upper(term) AS correct, CASE length(term) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
       CASE WHEN ascii(term) % 2 = 0 THEN term ELSE term || ' zq9' END AS evidence, CASE WHEN ascii(term) % 5 = 0 THEN 'keep' ELSE 'replace' END AS action FROM v_terms"""

_GATED = f"""
SELECT v.video_id, v.term, ok AS verified, CASE WHEN action = 'replace' AND NOT ok THEN 'uncertain' ELSE action END AS action,
       action = 'replace' AND ok AND confidence IN ('high', 'medium') AND correct <> term AS applicable
FROM (SELECT *, EXISTS (SELECT 1 FROM v_contexts c WHERE c.video_id = q.video_id AND c.term = q.term AND c.trusted
        AND contains(regexp_replace(lower(c.snippet), '[^a-z0-9]', '', 'g'), regexp_replace(lower(q.evidence), '[^a-z0-9]', '', 'g'))) AS ok FROM ({_VERDICTS}) q) v"""


def verdicts(t):
    term = F.col("term")
    n = F.length("term") % 3
    return open_terms(t).select(
        "video_id", "term", F.upper("term").alias("correct"),
        F.when(n == 0, "low").when(n == 1, "medium").otherwise("high").alias("confidence"),
        F.when(F.ascii("term") % 2 == 0, term).otherwise(F.concat(term, F.lit(" zq9"))).alias("evidence"),
        F.when(F.ascii("term") % 5 == 0, "keep").otherwise("replace").alias("action"),
    )


@query("verdict_gate", "video_id string, term string, verified boolean, action string, applicable boolean", _GATED)
def verdict_gate(t):
    return G.gate_verdicts(verdicts(t), G.contexts(sources(t), open_terms(t)))


@query("adjudication", "video_id string, term string, n_contexts long, applicable boolean", f"""
SELECT g.video_id, g.term, least(8, n) AS n_contexts, applicable FROM ({_GATED}) g
JOIN (SELECT video_id, term, count(DISTINCT lower(regexp_replace(snippet, '[\\s\\x{{3000}}]+', '', 'g'))) AS n FROM v_contexts GROUP BY ALL) c USING (video_id, term)""")
def adjudication(t):
    found = G.contexts(sources(t), open_terms(t))
    used = G.best_contexts(found).groupBy("video_id", "term").agg(F.count("*").alias("n_contexts"))
    return G.gate_verdicts(verdicts(t), found).join(used, ["video_id", "term"])
