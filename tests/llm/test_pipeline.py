"""Queries and the pipeline on the smallest shared tables."""

import pathlib

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
if not pathlib.Path(FOLDER).exists():
    pytest.skip("no shared tables here", allow_module_level=True)

import corpus_pipeline
from lectern.llm import mixing, queries, simhash
from lectern.llm.common import table
from lectern.session import written

from . import edge


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for p in pathlib.Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, FOLDER)
    assert edge.as_rows(df.select(sorted(df.columns))) == sorted(
        (tuple(dict(zip(rel.columns, r))[c] for c in sorted(df.columns)) for r in rel.fetchall()), key=repr
    )


def test_every_query_gives_its_columns(spark):
    want = {
        "op1": {"doc_id", "fingerprint", "component_id"}, "op2": {"doc_id", "size", "source_size", "target", "taken"},
        "op3": {"vec_id", "n_links", "component_id", "kept"}, "op4": {"doc_id", "text"},
        "op5": {"doc_id", "held_out", "score", "predicted"}, "op6": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op7": {"doc_id", "held_out", "score", "predicted"}, "op8": {"doc_id", "text"},
        "op9": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op10": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op11": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
        "op12": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
        "op13": {"lang", "source", "part", "item", "value", "rank"},
    }
    assert {n.split("_")[0] for n in queries.QUERIES} == set(want)
    for name, query in queries.QUERIES.items():
        df = query(spark, FOLDER)
        assert want[name.split("_")[0]] <= set(df.columns)
        of = {"op3": "embeddings", "op12": "conversations"}.get(name.split("_")[0], "documents")
        rows = table(spark, FOLDER, of)
        rows = (rows.select("conv_id").distinct() if of == "conversations" else rows).count()
        assert df.count() == rows or name.startswith(("op9", "op13"))


def test_stages_in_turn(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), name)
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            assert all(before[r.doc_id] == r for r in rows)
        if name == "near_dedup":
            left = simhash.near_copies(out).collect()
            assert all(r.kept for r in left)  # nothing is left to drop
            assert {r.component_id for r in simhash.near_copies(docs).collect()} == {r.doc_id for r in rows}
        if name == "mixing":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        docs = out


def test_boilerplate_goes_from_short_pages_too(spark):
    passage = "a passage that many sites repeat below a text of their own, longer than that text"
    rows = [(k, f"own {k}\n{passage}", "en", f"s{k}", 1, *[None] * 5) for k in range(12)]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, edge.docs(spark, rows), FOLDER).collect()}
    assert out == {0: f"own 0\n{passage}", **{k: f"own {k}" for k in range(1, 12)}}


def test_a_line_has_the_sites_of_all_its_rows(spark):
    texts = [f"a shared line\nthe rest of this text is its own, number {k}" for k in range(2)]
    rows = [(k, texts[k % 2], "en", f"s{k}", 1, *[None] * 5) for k in range(12)]  # two texts, each copied to six sites
    rows += [(50 + k, "one text only\ncopied to many sites", "en", f"s{k}", 1, *[None] * 5) for k in range(12)]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, edge.docs(spark, rows), FOLDER).collect()}
    assert out[0] == texts[0] and all(out[k] == texts[k % 2].split("\n")[1] for k in range(1, 12))
    assert all(out[50 + k] == "one text only\ncopied to many sites" for k in range(12))


def test_stages_on_edge_and_empty_tables(spark):
    for make in (edge.docs, edge.empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, FOLDER), name)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
            else:
                assert out.count() >= docs.count()
