import random

from tickloom.llm import bytewindows


def brute(rows, window):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - window + 1):
            k = b[s : s + window]
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < i:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    bases = ["".join(rnd.choice("ab") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(60):
        x = list(rnd.choice(bases))
        for _ in range(rnd.randrange(6)):
            k = rnd.randrange(len(x))
            x[k : k + rnd.randrange(3)] = list(rnd.choice(["", "é", "zz", "a"]))
        rows.append((i, "".join(x)[rnd.randrange(100) :] + rnd.choice(bases)[: rnd.randrange(200)]))
    return rows + [(100, None), (101, ""), (102, rows[3][1]), (103, "ab" * 400), (104, "x" * 20 + "ab" * 300), (105, "x" * 49), (106, "x" * 49), (107, "y" * 50), (108, "y" * 50)]


def found(df, window=50):
    return {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in bytewindows.repeated_windows(df, window).collect()}


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
        assert found(df) == brute(rows, 50)
        assert found(df, 33) == brute(rows, 33)


def test_long_texts_are_cut_in_steps(monkeypatch):
    # the same runs of windows, whatever the block size
    import numpy as np

    rows = corpus(4)
    text = "".join(t or "" for _, t in rows).encode()
    whole = bytewindows.Batch(np.array([1]), [text], 50, 8)
    monkeypatch.setattr(bytewindows, "STEP_BYTES", 1000)
    cut = bytewindows.Batch(np.array([1]), [text], 50, 8)
    covered = lambda b: sorted(set().union(*(range(f + a, l + a + 1) for f, l, a in zip(b.first, b.last, b.at))))
    assert covered(whole) == covered(cut) == list(range(len(text) - 49))


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "z" * 60), (1, "z" * 60), (None, "z" * 60)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in bytewindows.repeated_windows(df).collect())
    assert got == [(0, 60), (1, 0), (1, 0)]
    assert bytewindows.repeated_windows(df.limit(0)).count() == 0
