"""Stored tables: signed refresh against an index built anew, commits, substring search with and without the index."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import glossary, retrieval as R, search as S
from lectern.operators.stored import Library, Rows, Store, TermIndex

WORDS = "alpha beta gamma delta Épsilon zeta".split()


def chunks(spark, rows):
    return spark.createDataFrame(rows, "video_id string, chunk_id string, title string, text string")


def embed(rows):
    return rows.select("video_id", "chunk_id", F.array(F.length("text").cast("double")).alias("vec"))


def scores(index, asked):
    return sorted((r.qid, r.video_id, r.chunk_id, round(r.score, 9)) for r in R.bm25(index, asked, scoped=False).collect())


def state(library):
    rows = sorted(tuple(r) for r in library.chunks.all().select("video_id", "chunk_id", "title", "text").collect())
    vectors = sorted((r.video_id, r.chunk_id, r.vec[0]) for r in library.vectors.all().collect())
    return rows, vectors


def test_changes_equal_a_rebuild(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(0, 9)))
    now = {(v, f"{v}-{k}"): ["t", text()] for v in "abc" for k in range(6)}
    rows = lambda of: [(*key, *value) for key, value in of.items()]
    asked = spark.createDataFrame([(q, "a", w) for q in (1, 2) for w in ("alpha", "epsilon", "nowhere", "zeta")], "qid long, video_id string, term string")
    library = Library(Store.temporary(spark, "test"))
    start = chunks(spark, rows(now))
    library.create(start, embed(start))

    def same():
        fresh = TermIndex(Store.temporary(spark, "test"), "words")
        with fresh.store.begin() as change:
            fresh.put(change, chunks(spark, rows(now)).select("video_id", "chunk_id", "text"))
        assert scores(library.words, asked) == scores(fresh, asked)
        assert library.words.totals().first() == fresh.totals().first()
        assert state(library) == (sorted(rows(now)), sorted((*key, float(len(v[1]))) for key, v in now.items()))

    same()
    new = {("b", f"b-{k}"): ["n", text()] for k in (1, 2, 9)}
    now = {k: v for k, v in now.items() if k[0] != "b"} | new
    library.replace(chunks(spark, rows(new)), embed(chunks(spark, rows(new))))
    same()
    patches = [("a", "a-1", None, "alpha alpha new"), ("a", "a-2", "only a title", None), ("c", "c-0", "both", "zeta"), ("c", "gone", "x", "y")]
    for v, c, title, body in patches[:3]:
        now[v, c] = [title or now[v, c][0], body or now[v, c][1]]
    met = []
    library.patch(chunks(spark, patches), lambda rows: (met.extend(r.chunk_id for r in rows.collect()), embed(rows))[1])
    assert sorted(met) == ["a-1", "c-0"]  # a title alone is not embedded anew
    same()
    library.purge(spark.createDataFrame([("c",)], "video_id string"))
    now = {k: v for k, v in now.items() if k[0] != "c"}
    same()
    library.compact()
    assert library.store.parts("words_postings") == [4] and len(library.store.parts("chunks")) == 1
    same()


def test_a_failed_batch_is_not_seen(spark):
    library = Library(Store.temporary(spark, "test"))
    start = chunks(spark, [("a", "1", "t", "alpha")])
    library.create(start, embed(start))
    with pytest.raises(ZeroDivisionError), library.store.begin() as change:
        library.chunks.put(change, chunks(spark, [("a", "1", "t", "lost"), ("a", "2", "t", "lost")]))
        raise ZeroDivisionError
    assert state(library)[0] == [("a", "1", "t", "alpha")]
    again = chunks(spark, [("a", "2", "t", "beta")])
    library.replace(again, embed(again))
    assert state(library) == ([("a", "2", "t", "beta")], [("a", "2", 4.0)])
    other = Library(Store(spark, library.store.folder))  # another reader of the folder
    assert state(other) == state(library)


def test_substring_index_finds_what_a_scan_finds(spark):
    rng = random.Random(5)
    rows = [(f"v{k % 3}", k, f"s{k}", k, k + 1, "".join(rng.choices("abÄ \n", k=rng.randrange(0, 30)))) for k in range(300)]
    rows += [("v0", 900 + k, f"s{900 + k}", k, k, "needle in a hot place") for k in range(40)]
    sentences = spark.createDataFrame(rows, "video_id string, idx long, seg_key string, start_ms long, end_ms long, text string")
    other = sentences.select(
        "video_id", "idx", F.col("seg_key").alias("chunk_id"), "start_ms", "end_ms", F.upper("text").alias("title"),
        F.when(F.col("idx") % 2 == 0, F.col("text")).alias("summary"), F.lit("").alias("ocr_text"), F.lit("b a").alias("text"),
    )
    table = S.searchable(sentences, other, other.withColumn("ocr_text", F.col("summary")), other)
    asked = spark.createDataFrame(
        [(n, f"v{n % 3}", q) for n, q in enumerate(["aä", "b", "ab a", "ÄÄ", "needle", "HOT pl", "bbb", "a\nb", "nowhere", "b a", "äab", " ab"])],
        "qid long, video_id string, q string",
    )
    index = TermIndex(Store.temporary(spark, "test"), "pieces", S.piece_list)
    with index.store.begin() as change:
        index.put(change, table.select("video_id", F.col("key").alias("chunk_id"), F.concat_ws("\n", *S.FIELDS).alias("text")))
    pick = lambda df: sorted((r.qid, r.key) for r in df.select("qid", "key").collect())
    found = pick(S.like_pairs(table, asked, index))
    assert found == pick(S.like_pairs(table, asked)) and len(found) > 300


def test_neighbouring_rows_share_an_entry_of_the_substring_index(spark):
    rng = random.Random(6)
    n = F.col("id")
    kinds = ["view", "click", "error", "signup"]
    said = [(f"v{k % 7}", k, f"s{k:05}", k, k + 1, f'{rng.choice(kinds)} {{"k": {rng.randrange(100)}}}') for k in range(1400)] + [("v1", 5000, "s05000", 1, 2, None), (None, 5001, "s05001", 1, 2, "view")]
    store = Store.temporary(spark, "test")
    kept = Rows(store, "sentences", ["video_id", "seg_key"], place="place")
    with store.begin() as change:
        kept.put(change, spark.createDataFrame(said, "video_id string, idx long, seg_key string, start_ms long, end_ms long, text string"))
    sentences = kept.all()
    at = [r.place for r in sentences.orderBy("video_id", "seg_key").collect()]
    assert at == sorted(set(at))
    none = spark.range(0).select(F.lit("").alias("video_id"), n.alias("idx"), F.lit("").alias("chunk_id"), n.alias("start_ms"), n.alias("end_ms"), *[F.lit("").alias(f) for f in S.FIELDS])
    table = S.searchable(sentences, none, none, none)
    asked = spark.createDataFrame([(q, f"v{q % 8}", x) for q, x in enumerate(["VIEW", 'k": 7', 'signup {"k": 5', "nowhere", "k", "", "up", "error", "click {"] * 3)], "qid long, video_id string, q string")
    index = TermIndex(store, "pieces", S.block_pieces)
    with store.begin() as change:
        index.put(change, S.blocks(table))
    pick = lambda df: sorted((r.qid, r.key) for r in df.select("qid", "key").collect())
    found = pick(S.like_pairs(table, asked, index))
    assert found == pick(S.like_pairs(table, asked)) and len(found) > 1000
    # a row for every piece of every sentence would be 20 times the sentences
    assert store.read("pieces_postings").count() < 4 * len(said)


def test_the_course_library_indexes_blocks(spark):
    from lectern.plans import library as queries
    from lectern.plans.registry import Tables

    made = queries._search_inputs(Tables(spark, "/root/testdata/sf0.001"))
    entries = made["indexes"].pieces.store.read("pieces_postings").filter("term = ''")
    assert entries.count() < made["segments"].count()


def test_grouped_documents_of_distinct_terms_are_not_counted(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "1", ["view one", "view"]), ("a", "2", [None, "", "ab"]), (None, "3", ["über"])], "video_id string, chunk_id string, text array<string>")
    rows = []
    for once in (False, True):
        if once:
            monkeypatch.setattr(R, "repeated", lambda *_: pytest.fail("looked for rows of one document"))
            monkeypatch.setattr(R.text, "counted", lambda *_: pytest.fail("counted"))
        index = TermIndex(Store.temporary(spark, "test"), "pieces", S.block_pieces, distinct=once)
        with index.store.begin() as change:
            index.put(change, docs, grouped=once)
        made = [index.store.read(f"pieces_{table}").drop("batch").collect() for table in ("postings", "frequency", "totals")]
        rows.append([sorted(map(str, table)) for table in made])
    assert rows[0] == rows[1] and len(rows[0][0]) == 11


def test_repair_is_written_back(spark):
    library = Library(Store.temporary(spark, "test"))
    rows = [("a", "1", "fo bar", "fo", None, ""), ("a", "2", "bar", "fo fo", "s", "o"), ("b", "3", "clean", "t", "s", "o"), ("b", "4", None, None, None, None)]
    start = spark.createDataFrame(rows, "video_id string, chunk_id string, text string, title string, summary string, ocr_text string")
    library.create(start, embed(start))
    rules = spark.createDataFrame([("", ["fo"], "foo!", "", 1), ("b", ["bar"], "never", "", 2)], "video_id string, wrong array<string>, right string, reason string, ord long")
    met = []

    def watched(moved):
        met.extend(r.chunk_id for r in moved.collect())
        return embed(moved)

    assert {(r.video_id, r.n) for r in glossary.repair_stored(library, rules, watched).collect()} == {("a", 4)}
    want = [("a", "1", "foo! bar", "foo!", None, ""), ("a", "2", "bar", "foo! foo!", "s", "o"), *rows[2:]]
    assert sorted(map(tuple, library.chunks.all().select(*start.columns).collect()), key=lambda r: r[1]) == want
    assert met == ["1"]  # only its indexed text is another
    fresh = Library(Store.temporary(spark, "test"))
    made = spark.createDataFrame(want, start.schema)
    fresh.create(made, embed(made))
    asked = spark.createDataFrame([("foo",), ("fo",), ("bar",)], "term string")
    both = [sorted(map(tuple, x.words.postings(asked).collect())) for x in (library, fresh)]
    assert both[0] == both[1] and len(both[0]) == 3


def test_every_text_is_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def model(text):
        seen.add(1)
        return [float(len(text))]

    embed = lambda rows: rows.select("video_id", "chunk_id", model("text").alias("vec"))
    chunks = spark.range(40).select(F.concat(F.lit("v"), F.col("id") % 4).alias("video_id"), F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    library = Library(Store.temporary(spark, "test"))
    library.create(chunks, embed(chunks))
    new = chunks.filter("video_id = 'v1'").withColumn("text", F.concat("text", F.lit(" more")))
    library.replace(new, embed(new))
    library.patch(chunks.filter("video_id = 'v2'").select("video_id", "chunk_id", F.lit("other text").alias("text")), embed)
    assert seen.value == 40 + 10 + 10
    assert {(r.video_id, r.vec[0]) for r in library.vectors.all().collect()} >= {("v1", 17.0), ("v1", 18.0), ("v2", 10.0)}
