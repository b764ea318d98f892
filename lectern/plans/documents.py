"""Document parsing and text function queries."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import answers, documents as D, paths, text as X
from lectern.functions.lists import unfold
from lectern.operators import documents as docs
from lectern.plans import adapters as A
from lectern.plans.registry import query
from lectern.session import work_path
from lectern.sources import files

NL = "\n"


def paragraph_docs(t):
    """documents with a blank line after every line"""
    return t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def headed_docs(t):
    """documents with every fourth line as a heading"""
    rows = F.transform(
        F.split("text", "\n"), lambda line, i: F.when(i % 4 == 3, F.concat(F.lit("## "), line)).otherwise(line)
    )
    return t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("video_id"),
        F.array_join(rows, "\n\n").alias("text"), F.lit("").alias("title"), "doc_id",
    )


_PARAS = """
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, trim(line) AS p FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> '')"""

_PACK = """
packed AS (
  SELECT {g}, pos, p, CAST(0 AS BIGINT) AS chunk, CASE WHEN length(p) >= 1200 THEN 0 ELSE length(p) END AS size,
         CASE WHEN length(p) >= 1200 THEN CAST(1 AS BIGINT) ELSE 0 END AS cno FROM paras WHERE pos = 1
  UNION ALL
  SELECT {g2}, b.pos, b.p, CASE WHEN over THEN b.cno + 1 ELSE b.cno END,
         CASE WHEN over THEN length(b.p) WHEN b.size + length(b.p) >= 1200 THEN 0 ELSE b.size + length(b.p) END,
         CASE WHEN over THEN b.cno + 1 WHEN b.size + length(b.p) >= 1200 THEN b.cno + 1 ELSE b.cno END
  FROM (SELECT {g2n}, n.pos, n.p, k.size, k.cno, k.size > 0 AND k.size + length(n.p) > 2400 AS over
        FROM packed k JOIN paras n ON {on} AND n.pos = k.pos + 1) b)"""

_DOC_PACK = f"WITH {_PARAS}, " + _PACK.format(g="doc_id", g2="b.doc_id", g2n="n.doc_id", on="n.doc_id = k.doc_id") + """,
chunks AS (SELECT doc_id, chunk, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS text FROM packed GROUP BY doc_id, chunk)
---
"""


@query("doc_chunks", "doc_id long, chunk long, text string", _DOC_PACK + "SELECT * FROM chunks")
def doc_chunks(t):
    return unfold(paragraph_docs(t), ["doc_id"], D.pack(D.paragraphs(F.col("text"))), "text", "chunk")


@query("doc_timeline", "doc_id long, idx long, start_ms long, end_ms long", _DOC_PACK + """
SELECT doc_id, chunk AS idx, end_ms - span AS start_ms, end_ms FROM (
  SELECT doc_id, chunk, greatest(1000, 50 * length(text)) AS span,
         sum(greatest(1000, 50 * length(text))) OVER (PARTITION BY doc_id ORDER BY chunk) AS end_ms FROM chunks)""")
def doc_timeline(t):
    pieces = F.transform(D.pack(D.paragraphs(F.col("text"))), lambda c: F.struct(F.lit(0).alias("sec"), F.lit("").alias("title"), c.alias("text")))
    return unfold(paragraph_docs(t), ["doc_id"], D.timeline(pieces), "c").select("doc_id", "c.idx", "c.start_ms", "c.end_ms")


_LINES = """
ls AS (SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN '## ' || line ELSE line END AS line FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
marked AS (SELECT *, regexp_matches(line, '^#{1,3}\\s+\\S') AS head, sum(CASE WHEN regexp_matches(line, '^#{1,3}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec0 FROM ls),
secs AS (SELECT doc_id, sec0, coalesce(max(CASE WHEN head THEN trim(regexp_replace(line, '^#{1,3}\\s+', '')) END), CASE WHEN max(max(sec0)) OVER (PARTITION BY doc_id) = 0 THEN NULL ELSE '导言' END) AS title,
           count(*) FILTER (NOT head AND trim(line) <> '') AS n_body FROM marked GROUP BY doc_id, sec0),
kept AS (SELECT s.doc_id, s.sec0, coalesce(s.title, g.title) AS title, n_body, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.sec0) - 1 AS sec
  FROM secs s JOIN (SELECT doc_id, arg_min(trim(line), i)[1:80] AS title FROM ls WHERE trim(line) <> '' GROUP BY doc_id) g ON g.doc_id = s.doc_id WHERE s.sec0 > 0 OR n_body > 0)"""


@query("doc_sections", "doc_id long, sec long, title string, body string", f"WITH {_LINES}\n---\n" + """
SELECT k.doc_id, k.sec, k.title, coalesce(string_agg(trim(m.line), chr(10) || chr(10) ORDER BY m.i) FILTER (NOT m.head AND trim(m.line) <> ''), '') AS body
FROM kept k JOIN marked m ON m.doc_id = k.doc_id AND m.sec0 = k.sec0 GROUP BY k.doc_id, k.sec, k.title""")
def doc_sections(t):
    # blank documents are dropped, as in docs.parse; without a heading the first line is the title
    d = headed_docs(t).withColumn("text", D.clean(F.col("text"))).filter(F.col("text") != "")
    first = F.substring(X.strip(F.substring_index("text", "\n", 1)), 1, 80)
    s = d.select("doc_id", F.posexplode(D.sections(F.col("text"), first)).alias("sec", "s"))
    return s.select("doc_id", "sec", "s.title", F.array_join(D.paragraphs(F.col("s.body")), "\n\n").alias("body"))


_PARSE = f"WITH {_LINES}, paras AS (" + """
SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) AS pos, p FROM (
  SELECT k.doc_id, k.sec, m.i, trim(m.line) AS p FROM kept k JOIN marked m ON m.doc_id = k.doc_id AND m.sec0 = k.sec0 WHERE NOT m.head AND trim(m.line) <> ''
  UNION ALL SELECT doc_id, sec, 0, title FROM kept WHERE n_body = 0)), """ + _PACK.format(
    g="doc_id, sec", g2="b.doc_id, b.sec", g2n="n.doc_id, n.sec", on="n.doc_id = k.doc_id AND n.sec = k.sec"
) + """,
chunks AS (SELECT doc_id, sec, chunk, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS text FROM packed GROUP BY doc_id, sec, chunk),
timed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, chunk) - 1 AS idx, greatest(1000, 50 * length(text)) AS span,
          sum(greatest(1000, 50 * length(text))) OVER (PARTITION BY doc_id ORDER BY sec, chunk) AS end_ms FROM chunks)
---
"""


@query("parse_documents", "chunk_id string, parent_id string, start_ms long, end_ms long, text string", _PARSE + """
SELECT 'd' || doc_id || '-c' || printf('%04d', idx) AS chunk_id, 'd' || doc_id || '-ch' || printf('%03d', sec) AS parent_id, end_ms - span AS start_ms, end_ms, text FROM timed""")
def parse_documents(t):
    return docs.chunks(docs.parse(headed_docs(t)))


@query("parse_chapters", "chapter_id string, title string, start_ms long, end_ms long, n_chunks long", _PARSE + """
SELECT 'd' || c.doc_id || '-ch' || printf('%03d', c.sec) AS chapter_id, k.title[1:80] AS title, min(c.end_ms - c.span) AS start_ms, max(c.end_ms) AS end_ms, count(*) AS n_chunks
FROM timed c JOIN kept k ON k.doc_id = c.doc_id AND k.sec = c.sec GROUP BY c.doc_id, c.sec, k.title""")
def parse_chapters(t):
    return docs.chapters(docs.parse(headed_docs(t)))


@query("doc_title", "doc_id long, title string", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN f ELSE f[1:80] END AS title FROM (
  SELECT doc_id, trim(regexp_replace(trim(string_split(trim(text, chr(10) || ' '), chr(10))[1]), '^#+', '')) AS f FROM documents)""")
def doc_title(t):
    even = F.col("doc_id") % 2 == 0
    return t.documents.select(
        "doc_id", D.guess_title(F.when(even, F.concat(F.lit("# "), F.ltrim("text"))).otherwise(F.col("text"))).alias("title")
    )


@query("corpus_scan", "source string, n_lines long, n_chars long", """
SELECT source, sum(len(ls)) AS n_lines, sum(length(text)) - sum(len(ls)) + count(*) AS n_chars FROM (
  SELECT source, text, string_split(text, chr(10)) AS ls FROM documents) GROUP BY source""")
def corpus_scan(t):
    folder = work_path(t.spark, "corpus")
    lines = t.documents.select("source", F.explode(F.split("text", "\n")).alias("value"))
    lines.write.mode("overwrite").partitionBy("source").text(f"{folder}/corpus")
    found = files.decode(files.scan(t.spark, [f"{folder}/corpus"]))
    rows = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    return (
        found.select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"), F.explode(rows).alias("line"))
        .groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    )


@F.pandas_udf(T.BinaryType())
def _gb18030(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s.encode("gb18030"))


@query("decode_text", "doc_id long, text string", """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN chr(65279) || text ELSE text END AS text FROM documents""")
def decode_text(t):
    raw = F.col("text").cast("binary")
    bom = F.concat(F.unhex(F.lit("EFBBBF")), raw)
    kind = F.col("doc_id") % 3
    encoded = t.documents.withColumn("_gb", _gb18030(F.col("text"))).select(
        "doc_id", F.when(kind == 0, raw).when(kind == 1, bom).otherwise(F.col("_gb")).alias("content")
    )
    return files.decode(encoded).drop("content")


# ------------------------------------------------------------------ text functions


@query("fused_text", "chunk_id string, fused string", """
SELECT chunk_id, CASE WHEN ocr_text = '' THEN text ELSE text || chr(10) || '【课件】' || ocr_text END AS fused FROM v_docs""")
def fused_text(t):
    return A.docs(t).select("chunk_id", X.fused_text(F.col("text"), F.col("ocr_text")).alias("fused"))


@query("short_titles", "id long, short string, cut string", """
SELECT id, CASE WHEN f = '' THEN '新对话' WHEN length(f) <= 28 THEN f ELSE f[1:27] || '…' END AS short, CASE WHEN length(content) <= 40 THEN content ELSE content[1:40] || '…' END AS cut
FROM (SELECT id, content, replace(trim(content), chr(10), ' ') AS f FROM v_messages)""")
def short_titles(t):
    return A.messages(t).select("id", X.short_title(F.col("content")).alias("short"), X.truncate(F.col("content"), 40).alias("cut"))


_CLIP = """CASE WHEN position(lower({n}) IN lower({f})) = 0 THEN NULL ELSE
  CASE WHEN position(lower({n}) IN lower({f})) - 60 > 1 THEN '…' ELSE '' END
  || replace({f}[greatest(1, position(lower({n}) IN lower({f})) - 60):least(length({f}), position(lower({n}) IN lower({f})) - 1 + length({n}) + 60)], chr(10), ' ')
  || CASE WHEN position(lower({n}) IN lower({f})) - 1 + length({n}) + 60 < length({f}) THEN '…' ELSE '' END END"""


@query("snippets", "chunk_id string, snip string", f"""
SELECT chunk_id, coalesce({_CLIP.format(n="w", f="title")}, {_CLIP.format(n="w", f="ocr_text")}, {_CLIP.format(n="w", f="text")},
  CASE WHEN trim(title) <> '' THEN replace(title, chr(10), ' ')[1:120] END, CASE WHEN trim(ocr_text) <> '' THEN replace(ocr_text, chr(10), ' ')[1:120] END, replace(text, chr(10), ' ')[1:120]) AS snip
FROM (SELECT *, CASE idx % 4 WHEN 0 THEN 'THAT' WHEN 1 THEN 'rren' WHEN 2 THEN 'eauxx' ELSE 'ción' END AS w FROM v_docs)""")
def snippets(t):
    n = F.col("idx") % 4
    w = F.when(n == 0, "THAT").when(n == 1, "rren").when(n == 2, "eauxx").otherwise("ción")
    return A.docs(t).withColumn("w", w).select(
        "chunk_id", X.snippet(F.col("w"), F.col("title"), F.col("ocr_text"), F.col("text")).alias("snip")
    )


@query("skeletons", "doc_id long, skeleton string", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS skeleton FROM documents")
def skeletons(t):
    return t.documents.select("doc_id", X.skeleton(F.col("text")).alias("skeleton"))


@query("dedup_keys", "doc_id long, key string", "SELECT doc_id, lower(regexp_replace(text, '[\\s\\x{3000}]+', '', 'g')) AS key FROM documents")
def dedup_keys(t):
    return t.documents.select("doc_id", X.dedup_key(F.col("text")).alias("key"))


@query("answer_normalise", "doc_id long, norm string", r"""
SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[\s，。、；：？！,.;:?!"''“”‘’()（）\[\]【】《》<>·—\-_/\\|]+', '', 'g'), '[^0-9a-zA-Z\x{4e00}-\x{9fff}^+\-=<>()]+', '', 'g') AS norm FROM documents""")
def answer_normalise(t):
    return t.documents.select("doc_id", answers.normalise(F.col("text")).alias("norm"))


_QUOTED = """list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 4 THEN '> **拓展** ' || x WHEN i % 5 = 0 THEN ' > ' || x ELSE x END), 'string_agg', chr(10))"""


def quoted_docs(t):
    rows = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("> **拓展** "), x)).when(i % 5 == 4, F.concat(F.lit(" > "), x)).otherwise(x),
    )
    return t.documents.select("doc_id", F.array_join(rows, "\n").alias("text"))


@query("strip_extension", "doc_id long, kept string", """
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS kept FROM (
  SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
GROUP BY doc_id, 1 = 1 HAVING true""".replace("string_agg(x, chr(10) ORDER BY i)", "string_agg(x, chr(10) ORDER BY i) FILTER (i % 5 NOT IN (4, 0))"))
def strip_extension(t):
    return quoted_docs(t).select("doc_id", answers.without_extension(F.col("text")).alias("kept"))


@query("strip_outline", "doc_id long, kept string", r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN s || chr(10) || '大纲：' || chr(10) || '- 第一' || chr(10) || 'tail' ELSE regexp_replace(s, '\s+$', '') END AS kept FROM (
  SELECT doc_id, text AS s FROM documents)""")
def strip_outline(t):
    n = F.col("doc_id") % 3
    tail = F.when(n == 0, "\n\n大纲：\n- 第一\n\n2. 第二").when(n == 1, "\n## **大纲** :\n• 甲").otherwise("\n大纲：\n- 第一\ntail")
    return t.documents.select("doc_id", X.without_outline(F.concat("text", tail)).alias("kept"))


@query("strip_heading", "doc_id long, kept string", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '# other' || chr(10) || text END AS kept FROM (SELECT doc_id, trim(text, chr(10) || ' ') AS text FROM documents)""")
def strip_heading(t):
    body = F.btrim("text", F.lit("\n "))
    own = F.concat(F.lit("## 1. title x\n\n  \n"), body)
    other = F.concat(F.lit("# other\n"), body)
    return t.documents.select("doc_id", X.without_heading(F.when(F.col("doc_id") % 2 == 0, own).otherwise(other), F.lit("title x")).alias("kept"))


@query("token_estimate", "source string, n_docs long, tokens long", """
SELECT source, count(*) AS n_docs, sum(greatest(1, CAST(floor(length(text) / 1.6) AS BIGINT))) AS tokens FROM documents GROUP BY source""")
def token_estimate(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(X.estimate_tokens(F.length("text"))).alias("tokens"))


# ------------------------------------------------------------------ links and paths


@query("url_identity", "page_id long, canonical string, link_id string", r"""
SELECT page_id, c AS canonical, sha1(c)[1:16] AS link_id FROM (
  SELECT page_id, regexp_extract(url, '^([^:/?#]+)://', 1).lower() || '://' || regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1).lower()
    || CASE WHEN regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
    || regexp_extract(url, '(\?[^#]*)', 1) AS c FROM pages)""")
def url_identity(t):
    return t.pages.select("page_id", paths.canonical_link(paths.with_scheme(F.col("url"))).alias("canonical"), paths.link_id(F.col("url")).alias("link_id"))


@query("url_kind", "page_id long, is_link boolean", """
SELECT page_id, page_id % 4 < 2 AS is_link FROM pages""")
def url_kind(t):
    n = F.col("page_id") % 4
    raw = F.when(n == 0, F.concat(F.lit('"'), "url", F.lit('"'))).when(
        n == 1, F.regexp_replace("url", "^https?://[^/]+", "www.youtube.com")
    ).when(n == 2, F.regexp_replace("url", "^https?://[^/]+", "C:")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return t.pages.select("page_id", paths.looks_like_link(raw).alias("is_link"))


@query("series_of_path", "doc_id long, series string, label string", """
SELECT doc_id, s AS series, CASE WHEN s = '_ungrouped' THEN '未分组' ELSE s END AS label FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '_ungrouped' ELSE lang END AS s FROM documents)""")
def series_of_path(t):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 5 == 0, F.concat(n, F.lit(".md"))).when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("C:\\lib\\"), "lang", F.lit("\\"), n, F.lit(".md"))
    ).otherwise(F.concat(F.lit("/lib/"), "lang", F.lit("/"), n, F.lit(".md")))
    series = paths.series_id(path)
    return t.documents.select("doc_id", series.alias("series"), paths.series_label(series).alias("label"))
