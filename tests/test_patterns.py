"""Many strings in many texts against a loop."""

import random

import pytest

from lectern.operators import patterns


@pytest.mark.parametrize("scope", ["video_id", None])
def test_equals_a_loop(spark, scope):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcÄ漢 .*\n", k=n))
    texts = [(k, f"v{k % 3}", word(rng.randrange(0, 60))) for k in range(200)] + [(900, "v0", None), (901, "v0", ""), (902, "v1", "abc"), (903, "v1", "abc")]
    strings = [(f"v{rng.randrange(3)}", word(rng.randrange(1, 6))) for _ in range(10_000)] + [("v0", None), ("v0", ""), ("v1", "abc"), ("v1", "abcd")]
    got = patterns.pairs(
        spark.createDataFrame(texts, "id long, video_id string, text string").repartition(4),
        spark.createDataFrame(strings, "video_id string, term string"), scope=scope,
    )
    bound = {(v if scope else "", s) for v, s in strings if s}
    want = sorted((k, s) for k, v, t in texts if t for b, s in bound if b in ("", v) and s in t)
    assert sorted((r.id, r.term) for r in got.collect()) == want and len(want) > 1000


def test_long_strings_only(spark):
    texts = spark.createDataFrame([(1, "v", "the needle"), (2, "v", "a needl")], "id long, video_id string, text string")
    strings = spark.createDataFrame([("v", "needle"), ("w", "needl")], "video_id string, term string")
    assert [(r.id, r.term) for r in patterns.pairs(texts, strings).collect()] == [(1, "needle")]
    assert patterns.pairs(texts, strings.limit(0)).collect() == [] and patterns.pairs(texts.limit(0), strings).collect() == []


def test_pieces_of_texts_are_not_written(spark, monkeypatch):
    written, sizes = patterns.written, []

    def counted(df, label):
        out = written(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(patterns, "written", counted)
    needle = "abcdefghijklmnopqrstuvwxyz"
    texts = spark.createDataFrame([(k, "v", f"{k} {needle}") for k in range(10)], "id long, video_id string, text string")
    assert patterns.pairs(texts, spark.createDataFrame([("v", needle)], "video_id string, term string")).count() == 10
    assert sum(sizes) <= 11


def test_places_and_surroundings_leave_the_task_without_their_text(spark):
    texts = spark.createDataFrame([(1, "v", "aaaa b 漢𝒳漢𝒳"), (2, "v", "aa"), (3, "w", "aa"), (4, "v", None)], "id long, video_id string, text string")
    strings = spark.createDataFrame([("v", "aa"), ("v", "a b"), ("v", "漢𝒳"), ("w", "b")], "video_id string, term string")
    found = patterns.matches(texts, strings, keep=["id"], window=1)
    assert found.columns == ["id", "term", "at", "near"]
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "a b", [3], ["aa b "]), (1, "aa", [0, 2], ["aaa", "aaa "]), (1, "漢𝒳", [7, 9], [" 漢𝒳漢", "𝒳漢𝒳"]), (2, "aa", [0], ["aa"]),
    ]


def test_a_tree_finds_every_place(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abc\n漢", k=3000))
    strings = sorted({"".join(rng.choices("abc漢", k=rng.randrange(1, 7))) for _ in range(300)})
    want = sorted((k, i) for i, s in enumerate(strings) for k in range(len(text)) if text.startswith(s, k))
    for cells in (patterns.CELLS, 0):  # steps in a table, and looked up
        monkeypatch.setattr(patterns, "CELLS", cells)
        monkeypatch.setattr(patterns, "STRIDE", 256)
        got = patterns._Tree(strings).walk(patterns._codes(text))
        assert sorted(zip(*(x.tolist() for x in got))) == want


def test_a_task_holds_the_finds_of_a_slice(monkeypatch):
    import pyarrow as pa

    longest, walk = [], patterns._Tree.walk
    monkeypatch.setattr(patterns, "SLICE", 100, raising=False)
    monkeypatch.setattr(patterns._Tree, "walk", lambda tree, codes: longest.append(len(codes)) or walk(tree, codes))
    texts = ["ab" * k for k in range(1, 40)] + ["b" * 500, "漢 ab"]
    block = pa.table({"id": list(range(len(texts))), "text": texts})
    run = patterns._finder("text", "term", ["id"], 1)
    got = run(block, pa.table({"term": ["ab", "bb", "漢"]})).to_pydict()
    want = [(k, w, t.count(w)) for k, t in enumerate(texts) for w in ("ab", "bb", "漢") if w in t]
    assert [(k, w, len(at)) for k, w, at in zip(got["id"], got["term"], got["at"])] == want and [len(x) for x in got["near"]] == [n for *_, n in want]
    assert len(longest) > 10 and max(longest) <= 700
    none = run(block, pa.table({"term": pa.array([], pa.string())}))
    assert none.num_rows == 0 and none.column_names == ["id", "term", "at", "near"]
