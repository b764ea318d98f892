"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import collections
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not pathlib.Path(FOLDER).exists():
    pytest.skip("no shared tables here", allow_module_level=True)

import __spark_entry__ as entry

SAMPLE = (
    "usage_grouping_sets price_calls chunk_segments chapter_segments stitch_overlaps split_points notes_complete slide_overlap_join nearest_chunk"
    " frame_groups bm25_search hybrid_rrf course_search parse_documents glossary_flag term_contexts verdict_gate evaluation_run"
    " hybrid_search usage_summary repair_library quiz_prompt stream_replies purge_course append_usage rerank_hook"
    " answer_citations waterfill_budget full_prefix chapter_transcript session_list quiz_grade guide_verify stream_chunks"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in pathlib.Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_its_sql():
    from lectern.plans import catalogue

    assert set(catalogue.all_queries()) == set(catalogue.all_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert cols == [rel.columns[i] for i in order]
    mine = collections.Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert mine == collections.Counter(tuple(r[i] for i in order) for r in rel.fetchall())
