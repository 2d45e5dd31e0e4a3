import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import middle


def by_hand(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_elias_fano():
    rnd = random.Random(5)
    for n, bound in [(0, 1), (1, 1), (1, 10**9), (5, 6), (300, 300), (300, 10**6), (1000, 5000), (129, 2**40)]:
        values = sorted(rnd.randrange(bound) for _ in range(n))
        got = middle.EliasFano(np.array(values, np.int64), bound)
        assert len(got) == n and [got[i] for i in range(n)] == values
        assert 8 * len(got.lows) + 64 * len(got.words) <= n * (3 + max(0, (bound // max(1, n)).bit_length())) + 136


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 20)])
def test_forms_by_hand(spark, rate, spm):
    rnd = random.Random(6)
    pool = ["", "\n", "\n\n\n", "one", "a\nb\nc", "a\r\nb\r\n", "é漢😀\n😀\n" * 40, "x<P>y\n", "<S\n<\nS>\n<M", "line\n" * 3000, "w " * 300_000, "Ω\n" * 700_000]
    rows = [(k, rnd.choice(pool[:9])) for k in range(600)] + [(1000 + k, t) for k, t in enumerate(pool)] + [(None, "a\nb"), (None, None), (5, "same id\nother"), (5, "same id\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit("x"), "part": F.lit(1), "n": F.lit(None).cast("int")})
    got = middle.transformed(df, rate=rate, spm=spm).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *by_hand(i, t, rate, spm))) for i, t in rows)
    digests = middle.transformed(df, rate=rate, spm=spm, texts=False).collect()
    assert {(r.doc_id, r.output_sha256) for r in digests} == {(r.doc_id, sha256(r.output.encode()).hexdigest()) for r in got}
    assert middle.transformed(df.where(F.lit(False))).count() == 0


def test_a_text_that_many_rows_share_is_dealt_in_parts(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a\nb\nc\n")).otherwise(F.concat(F.lit("t\n"), F.col("id").cast("string"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = middle.transformed(df).withColumn("task", F.spark_partition_id()).where("n = 3").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1334 and len({r.task for r in got}) > 4
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) == by_hand(r.doc_id, "a\nb\nc\n") for r in got)
