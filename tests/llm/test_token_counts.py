import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, tokencounts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SOME = ["ab", "aaa", "the ing\n\t", " \n\r", "éüß漢字😀", "0123 .,", "éà̧ ", "가각각", "'s're don't", "<|endoftext|>x", "!!<|startoftext|>?", "\x1c\x85  a", "İıſ", "—=-", "सिো"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def mixed(rnd, size):
    out = ""
    while len(out) < size:
        some = rnd.choice(SOME)
        out += some * rnd.randrange(1, 4) if rnd.random() < 0.5 else "".join(rnd.choice(some) for _ in range(rnd.randrange(1, 80)))
    return out[:size]


def counted(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencounts.count_tokens(df, VOCABULARY, **how).collect()}


def test_spliced_counts_equal_the_library(spark, library):
    rnd = random.Random(3)
    texts = [mixed(rnd, rnd.randrange(1, 900)) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 1500, "́" * 700, "x" + "́" * 900 + "y", "漢字" * 800, "-" * 2500, "😀" * 700, " " * 900, "'s" * 700, "<|endoftext|>" * 90, "1234567890" * 120, "a" * 64, "a" * 65]
    got = counted(spark, texts, chunk=64, width=4)
    for k, t in enumerate(texts):
        assert got[k] == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)), t


def test_production_sizes(spark, library):
    rnd = random.Random(4)
    texts = [mixed(rnd, n) for n in (16_384, 16_385, 40_000, 200_000)] + ["a" * 100_000, "lo" * 60_000, "word " * 30_000, "漢" * 50_000, "\n" * 40_000]
    got = counted(spark, texts)
    assert [got[k][1] for k in range(len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_overlaps_widen_until_chunks_are_one(spark):
    texts = spark.createDataFrame([("k", "a" * 500)], "key string, text string")
    with open(VOCABULARY, encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    counts, joints = tokencounts._spliced(texts.withColumn("cuts", F.expr("array(struct(65 AS at, 4 AS width), struct(130 AS at, 4 AS width))")), raw, 64)
    assert counts.first().failed > 0 and joints.where("excess is null").count() > 0


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(1, "Hello world", 5), (2, None, None), (3, "", 1), (1, "Hello world", 5), (None, "ab " * 9000, 2), (None, "ab " * 9000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("key", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    got = sorted(tokencounts.count_tokens(df, VOCABULARY).collect(), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 11, 2), (1, 11, 2), (2, 0, 0), (3, 0, 0), (None, 27_000, 9000), (None, 27_000, 9000)]))
    assert tokencounts.count_tokens(df.where(F.lit(False)), VOCABULARY).count() == 0


def test_query_over_all_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 2048)
