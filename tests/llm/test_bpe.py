import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tickloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.PrefixEncoder(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def texts(n):
    rnd = random.Random(1)
    for _ in range(n):
        some = rnd.choice(["ab", "aaa ", "the ing\n\t", " \n", "éüß漢字😀", "0123 .,", "ABC_-—=", "\x1c\x1d\x85 a"])
        yield "".join(rnd.choice(some) for _ in range(rnd.randrange(60)))


def test_same_ids_as_the_library(encoder, library):
    for t in [*texts(1500), "a" * 5000, " " * 3000 + "=" * 3000, "The quick brown fox, 1234 times. ", "", "<|endoftext|>"]:
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_append_and_edit_equal_a_new_table(encoder):
    rnd = random.Random(2)
    for t in texts(300):
        data = t.encode()
        table = encoder.extend(data, [])
        assert encoder.extend(data + b"tion", list(table)) == encoder.extend(data + b"tion", [])
        i = rnd.randrange(len(data) + 1)
        j = min(len(data), i + rnd.randrange(4))
        changed, new = encoder.edit(data, table, i, j, rnd.choice([b"", b"x", b"the "]))
        assert new == encoder.extend(changed, [])


def test_documents(spark, library):
    rows = [(1, "Hello  world\n", 5), (2, None, None), (3, "", 1), (1, "Hello  world\n", 5), (None, "é" * 50_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello  world\n", 2: "", 3: "", None: "é" * 50_000}[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert bpe.encode_documents(df.where(F.lit(False)), RANKS, public_tokenizers.PATTERN).count() == 0
