import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle, queries


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def grown(nodes, fan):
    """All levels of a tree, the lowest first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def path_of(tree, p, fan):
    out = []
    for nodes in tree[:-1]:
        a = p // fan * fan
        out.append((nodes[a:p], nodes[p + 1 : a + fan]))
        p //= fan
    return out


def by_hand(rows, fan=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda x: x[:3])
        trees[n] = grown([x[2] for x in groups[n]], fan)
    top = grown([trees[n][-1][0] for n in names], fan)
    out = []
    for i, n in enumerate(names):
        for p, (_, _, leaf, r) in enumerate(groups[n]):
            path = path_of(trees[n], p, fan) + path_of(top, i, fan)
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            f = leaf_of(r, text)
            for left, right in path:
                f = h([*left, f, *right])
            out.append((r["doc_id"], leaf, trees[n][-1][0], top[-1][0], h(x for a, b in path for x in a + b), f, f == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(spark, rows, **how):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "_pos": F.lit("x")})
    return [tuple(r) for r in merkle.manifest(df, changed={"text": lower}, where=tampered, **how).collect()]


@pytest.mark.parametrize("fan,deep", [(8, 4), (2, 1), (3, 2)])
def test_manifest_by_hand(spark, fan, deep):
    rows = [(k * 7 % 301 - 5, f"s{k % 3}", ("en", "de", None, "é", "z")[min(k % 11, 4) if k < 90 else 0], k, ("Some Text %d" % k, None, "", "Über\n")[k % 4]) for k in range(301)]
    rows += [(None, None, "en", None, None), (None, None, "en", None, None), (None, "a", "en", 1, "X"), (9, "s", "en", 3, "again A"), (9, "s", "en", 3, "again A"), (12, None, "lone", None, "L" * 300_000)]
    want = by_hand([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows], fan)
    got = made(spark, rows, fan=fan, deep=deep)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {x[6] for x in got} == {True, False}


def test_one_row_and_none(spark):
    one = made(spark, [(1, None, None, None, None)])
    assert one[0][1] == one[0][2] == one[0][3] == one[0][5] and one[0][4] == h([]) and one[0][6]
    assert made(spark, []) == []


@pytest.mark.parametrize("fan,height", [(8, 4), (8, 3), (2, 10), (3, 5)])
def test_traversal_in_order_on_time_and_in_little_memory(fan, height):
    for n in {1, fan - 1, fan + 1, fan**height // 2 + 1, fan**height - 1, fan**height}:
        leaves = [sha256(str(k).encode()).hexdigest() for k in range(n)]
        tree = [leaves]
        for _ in range(height):
            tree.append([h(tree[-1][k : k + fan]) for k in range(0, len(tree[-1]), fan)])
        walk = merkle.Traversal([x.encode() for x in leaves], height, fan)
        assert walk.root.decode() == tree[height][0]
        most = 0
        for p, path in enumerate(walk):
            want = [("".join(a), "".join(b)) for a, b in path_of(tree, p, fan)]
            assert [(a.decode(), b.decode()) for a, b in path] == want
            most = max(most, walk.held())
        assert walk.late == 0
        assert most <= 3 * fan * height


def test_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(str, map(tuple, queries.op12_merkle_manifest(spark, sf).collect()))) == sorted(map(str, by_hand(rows)))
