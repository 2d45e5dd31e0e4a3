"""Fill-in-the-middle over whole lines, with an index of line ends made once for each distinct text.

Rows meet by their text: dealt by its hash, sorted by hash and text, so that equal texts are neighbours and are found
equal by their bytes. Of each distinct text the places of its line ends are kept as an Elias-Fano list, from which every
document with that text selects its two cuts. A text that very many rows share is dealt in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed by the contract: marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text is dealt in parts if more than one in so many rows has it; so there are no more such texts than this.
HOT = 20_000
#: Code points looked at at a time, and bytes of output after which a batch is flushed.
STRIDE, FLUSH_BYTES = 1 << 20, 8 << 20


class EliasFano:
    """A rising list of numbers below a bound: low bits packed side by side, high bits as gaps in unary, with the ones counted word by
    word. About 2 + log2(bound / length) bits a number; any one is read without the others."""

    def __init__(self, values: np.ndarray, bound: int):
        self.n, self.low_bits = len(values), max(0, (bound // max(1, len(values))).bit_length() - 1)
        values = values.astype(np.uint64)
        width = np.uint64(self.low_bits)
        lows = (values[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)
        self.lows = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> width).astype(np.int64) + np.arange(self.n)
        words = np.zeros(int(ones[-1]) // 64 + 1 if self.n else 0, np.uint64)
        np.bitwise_or.at(words, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        self.words, self.before = words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        w = int(np.searchsorted(self.before, i, side="right")) - 1
        word = int(self.words[w])
        for _ in range(i - int(self.before[w])):
            word &= word - 1
        high = 64 * w + (word & -word).bit_length() - 1 - i
        a = i * self.low_bits
        low = int.from_bytes(self.lows[a >> 3 : (a + self.low_bits + 7) >> 3], "little") >> (a & 7)
        return high << self.low_bits | low & ((1 << self.low_bits) - 1)


def line_ends(text: str) -> EliasFano:
    """Where each line ends, in code points; a last line need not end with a line feed."""
    found = [np.flatnonzero(np.frombuffer(text[a : a + STRIDE].encode("utf-32-le"), np.uint32) == 10) + a + 1 for a in range(0, len(text), STRIDE)]
    ends = np.concatenate([np.zeros(0, np.int64), *found])
    if text and text[-1] != "\n":
        ends = np.append(ends, len(text))
    return EliasFano(ends, len(text) + 1)


def cut_at(ends: EliasFano, draws: tuple[int, int]) -> tuple[int, int]:
    """The places of the two cuts that two draws choose, in code points."""
    a, b = sorted(x % (len(ends) + 1) for x in draws)
    return tuple(ends[k - 1] if k else 0 for k in (a, b))


def arranged(text: str, a: int, b: int, form: str) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def draws(order: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers, each from eight digits of the SHA-256 of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(order.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row for each row of docs: the id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output and restored.

    ``rate`` percent of the rows are transformed, and ``spm`` percent of those suffix first; the draws depend on seed and
    id only, so that rows that share an id share them, and reruns agree. Texts that are empty, null (as empty) or hold a mark
    stay plain. With ``texts=False``, output and restored are SHA-256 digests (output_sha256, restored_sha256), and whole
    texts never leave the task. Any length is handled; a text is held by one task, as its row was. Repeated rows
    give a row each; ties don't arise; an empty table gives an empty result; other columns are not read.

    One exchange of the texts. A scan before counts hashes, to find texts that more than one in HOT rows has: they are
    dealt in parts by row number, and their index is made once for each part."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    # fewer than HOT rows, as each stands for more than one in HOT
    many = F.broadcast(counts.where(F.col("n") > max(500, total // HOT)).select("hash", F.lit(True).alias("many")))
    part = F.when(F.col("many"), F.monotonically_increasing_id() % (1 << 16)).otherwise(F.lit(0))
    dealt = rows.join(many, "hash", "left").select("id", "text", "hash", part.alias("part"), *[d.alias(f"h{k}") for k, d in enumerate(draws(F.col("id"), seed), 1)])
    spread = dealt.repartition("hash", "part").sortWithinPartitions("hash", "text")
    kind = rows.schema["id"].dataType
    arrow, value = to_arrow_type(kind), pa.string()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", *(("output", "restored") if texts else ("output_sha256", "restored_sha256"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends, marked = None, None, False
        out: list[tuple] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            kinds = (arrow, pa.int64(), pa.string(), pa.int64(), pa.int64(), value, value)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "h1", "h2", "h3", "h4")]
            for k, item in enumerate(batch.column("text")):
                i, h1, h2, h3, h4 = (c[k] for c in columns)
                text = item.as_py()
                if text != known:
                    known, ends = text, line_ends(text)
                    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                if not text or marked or h3 % 100 >= rate:
                    form, a, b, output = "plain", None, None, text
                else:
                    form = "spm" if h4 % 100 < spm else "psm"
                    a, b = cut_at(ends, (h1, h2))
                    output = arranged(text, a, b, form)
                both = (output, restored(output, form))
                if not texts:
                    both = tuple(sha256(x.encode()).hexdigest() for x in both)
                out.append((i, len(ends), form, a, None if a is None else b - a, *both))
                held += 64 + len(both[0]) + len(both[1])
                if held >= FLUSH_BYTES:
                    yield flushed()
                    out, held = [], 0
        if out:
            yield flushed()

    schema = f"id {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {names[5]} string, {names[6]} string"
    return spread.mapInArrow(run, schema).withColumnRenamed("id", id_col)
