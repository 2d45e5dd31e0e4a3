import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import minhash, mixing, shingles
from tickloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    full = {i: sets(t) for i, t in rows}
    for a, b in combinations(sorted(full), 2):
        both = len(full[a] & full[b])
        if both and 100 * both >= percent * len(full[a] | full[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(full[i]), find(i)) for i in full}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "X"]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 8, 40, 200]))]
        for _ in range(rnd.randrange(1, 8)):
            copy = list(words)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 3, rnd.choice([" ", "  ", "\n"]).join(copy)))
    # a family around a base: each copy is near the base, copies are far from each other
    words = [rnd.choice(vocabulary) for _ in range(120)]
    for k in range(15):
        copy = list(words)
        copy[8 * k : 8 * k + 3] = ["q", "r", f"s{k}"]
        rows.append((1000 + 2 * k, " ".join(copy)))
    rows.append((2001, " ".join(words)))
    line = " ".join(vocabulary[:12])
    rows += [(3000 + k, line + "\n" + " ".join(rnd.choice(vocabulary) for _ in range(9))) for k in range(30)]
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (5005, "one two")]


def test_against_brute_force(spark):
    for seed, percent in ((1, 85), (2, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
        got = {r.doc_id: r for r in minhash.near_duplicates(df, percent).collect()}
        expected = brute(rows, percent)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
        assert all(r.kept == (i == r.component_id) for i, r in got.items())
        kept = minhash.keep_first(df, percent)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}


def test_edge_tables(spark):
    df = spark.createDataFrame([(5, "x"), (5, "x"), (None, "x")], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 3 and all(r.component_id == 5 and r.kept for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_clashing_columns_stay(spark):
    names = ["_id", "row", "id", "kept", "n", "a.b", "component_id"]
    df = spark.createDataFrame([(1, "a b c d e f", *names), (2, "a b c d e f", *names), (3, "g h i j k l", *names)], ["doc_id", "text", *names])
    assert sorted(map(tuple, minhash.keep_first(df).collect())) == [(1, "a b c d e f", *names), (3, "g h i j k l", *names)]
    docs = df.withColumn("source", F.lit("s")).withColumns({"_times": F.lit(7), "_pass": F.lit(8), "times": F.lit(9)})
    got = mixing.copies(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}


def test_shingle_sets_count_as_strings_do():
    rows = [t.encode() for _, t in corpus(3) if t is not None]
    for text, found in zip(rows, shingles.shingle_sets(rows)):
        assert len(found) == len(sets(text.decode())) and (np.diff(found.astype(object)) > 0).all()


def test_register_bound_loses_no_pair():
    rnd = np.random.default_rng(5)
    for n in (3, 12, 60, 300, 2000):
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(30):
            drop = rnd.integers(0, max(1, len(base) // 12))
            other = np.unique(np.concatenate([base[drop:], rnd.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if both >= 0.85 * (len(base) + len(other) - both):
                sizes = np.array([len(base)]), np.array([len(other)])
                a, b = minhash.registers(base)[None], minhash.registers(other)[None]
                assert minhash.may_reach(a, b, *sizes, minhash.chances(*sizes), 0.85)[0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102, 200)}}
    assert components(df.limit(0)).count() == 0


def test_measured_recall_at_the_threshold():
    """Planted pairs of 0.85 to 0.87, of sets from 20 to 3,000 shingles: how many share a band and pass the estimate."""
    rng = np.random.Generator(np.random.PCG64(12))
    met = passed = pairs = 0
    for _ in range(6000):
        n = int(np.exp(rng.uniform(np.log(20), np.log(3000))))
        union = int(round(n / rng.uniform(0.85, 0.87)))
        if not 0.85 <= n / union <= 0.87:
            continue
        drawn = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, union, dtype=np.uint64)
        side = rng.random(union - n) < 0.5
        a, b = (np.unique(np.concatenate([drawn[:n], drawn[n:][s]])) for s in (side, ~side))
        sa, sb = minhash.registers(a)[None], minhash.registers(b)[None]
        (ka, fa), (kb, fb) = minhash.band_keys(sa), minhash.band_keys(sb)
        sizes = np.array([len(a)]), np.array([len(b)])
        pairs += 1
        met += bool(((ka == kb) & fa & fb).any())
        passed += bool(minhash.may_reach(sa, sb, *sizes, minhash.chances(*sizes), 0.85)[0])
    assert pairs > 4000
    print(f"recall at the threshold: {met} of {pairs} share a band, {passed} pass the estimate")
    assert met == passed == pairs
