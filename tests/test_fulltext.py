import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators import fulltext


@pytest.mark.parametrize("rising", [True, False])
def test_packed_lists(rising):
    rnd = random.Random(1)
    for most in (2, 130, 70_000, 1 << 40):
        lists = [sorted({rnd.randrange(most) for _ in range(rnd.choice([0, 1, 5, 300]))}) for _ in range(40)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        packed = fulltext.pack(np.array(sum(lists, []), np.int64), offsets, rising)
        got, at = fulltext.unpack(packed, rising)
        assert at.tolist() == offsets.tolist() and got.tolist() == sum(lists, [])
    dense = fulltext.pack(np.arange(65_536), np.array([0, 65_536]), True)
    assert len(dense[0].as_py()) == 65_536


def scan(texts, terms, every):
    words = {i: set(t.lower().split()) for i, t in texts.items()}
    return {i for i, w in words.items() if (all if every else any)(x in w for x in terms)}


def found(index, terms, every):
    rows = index.search(terms, every).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id for r in rows}


def test_index_follows_additions_changes_and_removals(spark, tmp_path):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "the", "ω"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(6))) + " the"
    # ids over several blocks, dense and sparse
    texts = {i: text() for i in [*range(300), *range(65_400, 65_700), 10**12, 10**12 + 70_000]}
    index = fulltext.Index(spark, str(tmp_path / "a"))
    put = lambda part, segment: index.add(spark.createDataFrame(list(part.items()), "id long, text string"), segment)
    put({i: t for i, t in texts.items() if i % 2}, 0)
    put({i: t for i, t in texts.items() if i % 2 == 0}, 1)
    cases = [(["alpha"], True), (["alpha", "beta"], True), (["alpha", "gamma", "alpha"], False), (["the", "ω"], True), (["none"], False), (["none", "the"], True), (["the"], False)]
    for terms, every in cases:
        assert found(index, terms, every) == scan(texts, terms, every)
    changed = {i: text() for i in list(texts)[::5]}
    put(changed, 2)
    put(changed, 2)  # a batch that is run again
    gone = list(texts)[::7]
    index.remove(spark.createDataFrame([(i,) for i in gone], "id long"), 3)
    back = {gone[0]: "alpha again"}
    put(back, 4)
    texts = {i: t for i, t in (texts | changed).items() if i not in set(gone)} | back
    merged = index.merged(str(tmp_path / "b"))
    for state in (index, merged):
        assert tuple(state.size().first()) == (len(texts), sum(len(t.split()) for t in texts.values()))
        for terms, every in cases:
            assert found(state, terms, every) == scan(texts, terms, every)
    assert merged.postings(["the"]).agg(F.sum("n")).first()[0] == sum("the" in t.split() for t in texts.values())


def test_ranking_by_hand(spark, tmp_path):
    texts = {1: "a a b", 2: "a c c c c c c", 3: "b", 4: None, 5: "a a b"}
    index = fulltext.Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(list(texts.items()), "id long, text string"), 0)
    words = {i: (t or "").split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / 5
    want = {}
    for term in ("a", "b"):
        d = sum(term in w for w in words.values())
        for i, w in words.items():
            if n := w.count(term):
                want[i] = want.get(i, 0) + np.log(1 + (5 - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = [(r.id, r.score) for r in index.ranked(["a", "b"], 3).collect()]
    assert [i for i, _ in got] == sorted(want, key=lambda i: (-round(want[i], 9), i))[:3]
    assert all(abs(s - want[i]) < 1e-9 for i, s in got)


def test_no_texts(spark, tmp_path):
    index = fulltext.Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame([], "id long, text string"), 0)
    assert found(index, ["a"], True) == set() and index.ranked(["a"], 5).count() == 0 and tuple(index.size().first()) == (0, 0)
    assert found(index.merged(str(tmp_path / "m")), ["a"], False) == set()


def test_a_search_opens_the_terms_folders_only(spark, tmp_path):
    index = fulltext.Index(spark, str(tmp_path / "i"))
    index.add(spark.range(2000).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("text")), 0)
    files = index.postings(["w17"]).select(F.input_file_name()).distinct().count()
    assert files <= 1 and len(index.postings(["w17"]).inputFiles()) > 8
    plan = index.postings(["w17"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan or "(folder#" in plan
    assert "In(term" in plan or "EqualTo(term" in plan


def test_words_are_counted_in_parts():
    rnd = random.Random(5)
    most = 1 << 17
    texts = [[f"w{rnd.randrange(50)}" for _ in range(n)] for n in [0, 3, most + 5, 0, *[400] * 1000, 0]]
    batch = pa.RecordBatch.from_arrays([pa.array([7 * i + 65_000 for i in range(len(texts))]), pa.array(texts, pa.list_(pa.string()))], ["id", "found"])
    parts = list(fulltext._counted(iter([batch.slice(0, 0), batch.slice(1), batch.slice(0, 1)])))
    assert len(parts) > 3 and all(sum(p["value"].to_pylist()) <= most or len(set(p["low"].to_pylist())) == 1 for p in parts)
    got = {(r["term"], r["block"] << 16 | r["low"]): r["value"] for p in parts for r in p.to_pylist()}
    assert got == {(w, 7 * i + 65_000): t.count(w) for i, t in enumerate(texts) for w in set(t)}


def test_postings_are_merged_in_parts():
    n, ids = 12, np.arange(fulltext.BLOCK)
    at = np.arange(n + 1) * fulltext.BLOCK
    packed = [fulltext.pack(np.tile(x, n), at, rising) for x, rising in ((ids, True), (ids % 200 + 1, False))]
    postings = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(n)]), pa.array([3] * n), pa.array([i % 2 for i in range(n)]), *packed], ["term", "block", "segment", "ids", "counts"])
    length, last = np.where(ids % 5, 9, 0), ids % 2
    parts = list(fulltext._live(postings, length, last))
    assert len(parts) > 4 and all(sum(p["n"].to_pylist()) <= 1 << 17 for p in parts)
    for i, r in enumerate(r for p in parts for r in p.to_pylist()):
        want = ids[(ids % 5 > 0) & (ids % 2 == i % 2)]
        assert (r["term"], r["block"], r["n"]) == (f"t{i}", 3, len(want))
        assert (fulltext._one(r["ids"], True) == want).all() and (fulltext._one(r["counts"]) == want % 200 + 1).all()


def test_what_merging_holds_does_not_grow_with_its_batch():
    ids, peaks = np.arange(fulltext.BLOCK), []
    length, last = np.full(fulltext.BLOCK, 9), np.zeros(fulltext.BLOCK, np.int64)
    for n in (4, 64):
        packed = [fulltext.pack(np.tile(x, n), np.arange(n + 1) * fulltext.BLOCK, rising) for x, rising in ((ids, True), (ids % 200 + 1, False))]
        postings = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(n)]), pa.array([3] * n), pa.array([0] * n), *packed], ["term", "block", "segment", "ids", "counts"])
        tracemalloc.start()
        rows = sum(p.num_rows for p in fulltext._live(postings, length, last))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.2 * peaks[0], peaks


def test_sizes_go_block_by_block():
    one = lambda x, rising: fulltext.pack(np.array(x), np.array([0, len(x)]), rising)[0].as_py()
    row = lambda segment, ids, lengths: {"segment": segment, "place": -1, "ids": one(ids, True), "values": one(lengths, False)}
    blocks = [[row(0, [1, 5, 9], [4, 1, 3])], [row(0, [0, 65_535], [2, 2]), row(1, [0], [0])], [row(0, [7], [11])]]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 3, 4]), pa.array(blocks)], ["block", "rows"])
    assert [tuple(p.to_pylist()[0].values()) for p in fulltext._sizes(iter([batch]))] == [(3, 5), (1, 1), (1, 10)]
