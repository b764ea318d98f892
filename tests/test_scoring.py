"""Scores in blocks and packs against a loop; words counted inside their row."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import retrieval, scoring
from lectern.operators.stored import Store, TermIndex
from lectern.session import written


@pytest.mark.parametrize("scoped", [True, False])
def test_sums_equal_a_loop(spark, monkeypatch, scoped):
    monkeypatch.setattr(scoring, "CELLS", 40)
    monkeypatch.setattr(scoring, "BLOCK", 100)
    monkeypatch.setattr(scoring, "PACK", 3)
    rng = random.Random(5)
    found = [(f"v{d % 3}", f"c{d}", f"t{t}", rng.random() + 0.1) for d in range(60) for t in rng.sample(range(12), 5)]
    asked = [(q, f"v{q % 4}", f"t{t}", rng.random() + 0.1) for q in range(8) for t in rng.sample(range(14), 4)]
    want = collections.defaultdict(float)
    for v, c, t, w in found:
        for q, qv, qt, idf in asked:
            if t == qt and (v == qv or not scoped):
                want[q, v, c] += w * idf
    tables = (spark.createDataFrame(found, "video_id string, chunk_id string, term string, weight double"),
              spark.createDataFrame(asked, "qid long, video_id string, term string, idf double"))
    got = {tuple(r)[:3]: r.score for r in scoring.sums(*tables, ["video_id", "chunk_id"], scoped).collect()}
    assert got == pytest.approx(dict(want)) and len(got) > 50
    few = {tuple(r)[:3]: r.score for r in scoring.sums(*tables, ["video_id", "chunk_id"], scoped, k=2).collect()}
    best = collections.defaultdict(list)
    for key, score in want.items():
        best[key[:2]].append((-score, key))
    assert {key for rows in best.values() for _, key in sorted(rows)[:2]} <= set(few) and few.items() <= got.items()


def test_postings_meet_only_questions_of_their_courses(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 100)
    monkeypatch.setattr(scoring, "PACK", 10)

    def received(keys, scoped, k):
        def run(block, pack):
            return pa.table({"qid": [len(pack)], "video_id": [""], "chunk_id": [""], "score": [float(len(block))]})

        return run

    monkeypatch.setattr(scoring, "_summer", received)
    # 200 courses with a question each, and one with half as many postings as all of them
    found = [(f"v{c}", f"c{d}", "t", 1.0) for c in range(200) for d in range(5)] + [("w", f"d{d}", "t", 1.0) for d in range(500)]
    asked = [(q, f"v{q}", "t", 1.0) for q in range(200)] + [(q, "w", "t", 1.0) for q in range(200, 205)]
    tables = (spark.createDataFrame(found, "video_id string, chunk_id string, term string, weight double"),
              spark.createDataFrame(asked, "qid long, video_id string, term string, idf double"))
    rows = scoring.sums(*tables, ["video_id", "chunk_id"], True).collect()
    assert 1_500 <= sum(r.score for r in rows) <= 3_000 and 205 <= sum(r.qid for r in rows) <= 1_000
    assert max(r.score for r in rows) < 250  # the large course is spread
    assert sum(r.score for r in scoring.sums(*tables, ["video_id", "chunk_id"], False).collect()) == 1_500 * 21


def test_words_are_counted_without_a_shuffle(spark):
    words = spark.createDataFrame([(["b", "a", "b", "é", "b"],), ([],), (["x"],)], "w array<string>")
    got = [[tuple(x) for x in r[0]] for r in words.select(text.counted(F.col("w"))).collect()]
    assert got == [[("a", 1), ("b", 3), ("é", 1)], [], [("x", 1)]]
    docs = spark.createDataFrame([("v", "c1", "a b a"), ("v", "c2", ""), ("v", "c3", None)], "video_id string, chunk_id string, text string")
    found = retrieval.postings(docs, marked=True)
    assert sorted(tuple(r) for r in found.collect()) == [("v", "c1", 3, "", 1), ("v", "c1", 3, "a", 2), ("v", "c1", 3, "b", 1), ("v", "c2", 0, "", 1), ("v", "c3", 0, "", 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # rows of one document are one
    assert ("v", "c1", 3, "a", 4) in {tuple(r) for r in retrieval.postings(docs.unionAll(docs)).collect()}


def test_a_change_splits_only_texts_that_differ(spark):
    old = spark.createDataFrame([(None, "c0", "a"), ("v", "c1", "a a"), ("v", "c2", "b"), ("v", "c4", None)], "video_id string, chunk_id string, text string")
    new = spark.createDataFrame([(None, "c0", "a"), ("v", "c1", "a c"), ("v", "c3", "b b"), ("v", "c4", None)], "video_id string, chunk_id string, text string")
    index = TermIndex(Store.temporary(spark, "test"), "words")
    rows = {tuple(r) for r in index._difference(new, old).select("chunk_id", "term", "tf", "len", "df").collect()}
    assert rows == {("c1", "a", -1, 0, 0), ("c1", "c", 1, 2, 1), ("c2", "", -1, -1, -1), ("c2", "b", -1, -1, -1), ("c3", "", 1, 2, 1), ("c3", "b", 2, 2, 1)}


def test_only_postings_of_asked_courses_are_written(spark, monkeypatch):
    sizes = {}

    def counted(df, label="table"):
        out = written(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(scoring, "written", counted)
    found = spark.createDataFrame([(f"v{n % 10}", f"c{n}", f"t{n % 3}", 1.0) for n in range(300)] + [(None, "c", "t0", 1.0)], "video_id string, chunk_id string, term string, weight double")
    asked = spark.createDataFrame([(1, "v1", "t0", 2.0), (2, "v2", "t1", 2.0), (3, None, "t0", 2.0)], "qid long, video_id string, term string, idf double")
    assert scoring.sums(found, asked, ["video_id", "chunk_id"], True).count() == 20 == sizes["weights"]
    assert scoring.sums(found, asked, ["video_id", "chunk_id"], False).count() == 302 and sizes["weights"] == 301


def test_time_bias_scores_once(spark):
    from lectern.plans import catalogue

    plan = catalogue.all_queries()["hybrid_time_bias"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan
