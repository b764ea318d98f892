"""Block-wise vector search against a loop."""

import numpy as np
import pytest

from lectern.operators import retrieval as R
from lectern.operators.vector_blocks import VectorBlocks


def data(seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    store = [("hot", f"h{k:04d}", (centres[k % 6] + spread * rng.normal(size=12)).tolist()) for k in range(700)]
    store += [(f"c{k % 9}", f"x{k}", rng.normal(size=12).tolist()) for k in range(300)]
    store += [("hot", f"same{k}", store[5][2]) for k in range(30)] + [("hot", f"zero{k}", [0.0] * 12) for k in range(3)]
    store += [("hot", "short", [1.0, 2.0]), ("hot", "none", None), ("hot", "empty", []), ("hot", "hole", [1.0] * 11 + [None])]
    asked = [(q, "hot" if q % 2 else f"c{q % 9}", (centres[q % 6] + 0.1 * rng.normal(size=12)).tolist()) for q in range(40)]
    asked += [(100, "hot", store[5][2]), (101, "hot", [0.0] * 12), (102, "hot", [2.0, 1.0]), (103, "nowhere", [1.0] * 12), (104, "hot", None)]
    return store, asked


def loop(store, asked, k):
    out = []
    for qid, video, q in asked:
        scores = []
        for v, c, x in store:
            if v == video and q is not None and x is not None and x and len(x) == len(q) and None not in x:
                product = float(np.dot(q, q) ** 0.5 * np.dot(x, x) ** 0.5)
                scores.append((-round(float(np.dot(q, x)) / (product or 1.0), 9), c))
        out += [(qid, c, rank) for rank, (_, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 8, 40])
def test_equals_a_loop(spark, k):
    store, asked = data()
    vectors = spark.createDataFrame(store, "video_id string, chunk_id string, vec array<float>").repartition(5)
    store = [(v, c, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for v, c, x in store]
    questions = spark.createDataFrame(asked, "qid long, video_id string, qvec array<double>")
    blocks = VectorBlocks.pack(vectors, size=32)
    got = R.vector_hits(blocks, questions, k, "rank")
    assert sorted((r.qid, r.chunk_id, r["rank"]) for r in got.collect()) == loop(store, asked, k)


def test_far_blocks_are_skipped_and_empty_tables_work(spark):
    store, asked = data(spread=0.02)
    vectors = spark.createDataFrame(store, "video_id string, chunk_id string, vec array<double>")
    questions = spark.createDataFrame(asked[1:12:2], "qid long, video_id string, qvec array<double>")
    blocks = VectorBlocks.pack(vectors, size=32)
    hot = blocks.packed.filter("video_id = 'hot' AND dim = 12").count()
    left = blocks.search(questions, 5).groupBy("qid").count().collect()  # up to five of each block met
    assert hot > 20 and all(r["count"] < 5 * hot / 2 for r in left)
    none = VectorBlocks.pack(vectors.limit(0))
    assert none.search(questions, 5).count() == 0 and blocks.search(questions.limit(0), 5).count() == 0
