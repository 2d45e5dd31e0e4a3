"""A maintained full-text index: postings in blocks of ids, kept in Parquet, searched without reading the texts.

Ids are cut into blocks of 65,536. A posting is a term in a block: the sorted ids within it, as packed differences, and how
often each text has the term. So a term that every text has is as many postings as there are blocks, none larger than
a block, and terms are intersected block by block. Each addition is a segment; of an id that comes again, the latest
segment counts, and a removed id is one without a length. Postings lie in folders by a hash of the term, sorted by it,
so that a search opens a few of them and skips most of those."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .batches import bounds, ranges

BLOCK, FOLDERS = 1 << 16, 32
#: Numbers that are packed or unpacked, or words that are counted, at a time; at least those of one list or text.
NUMBERS = 1 << 17
POSTINGS = "term string, block bigint, n int, ids binary, counts binary, segment int, folder int"
DOCUMENTS = "block bigint, ids binary, lengths binary, segment int"


def pack(lists: np.ndarray, offsets: np.ndarray, rising: bool = False) -> pa.Array:
    """Lists of non-negative numbers, one behind the other from offset to offset, as an Arrow array of binaries: seven bits
    a byte, the high bit set where a number goes on; of rising lists the differences."""
    x = lists.astype(np.int64)
    if rising and len(x):
        before = np.concatenate(([0], x[:-1]))
        before[offsets[:-1][offsets[:-1] < offsets[1:]]] = 0
        x = x - before
    size = np.maximum(1, -(-np.frexp(x.astype(np.float64))[1] // 7))
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[ends[:-1][on] + k] = (x[on] >> 7 * k & 127) | np.where(size[on] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int32)), pa.py_buffer(out)])


def unpack(packed: pa.Array, rising: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The lists that pack made binaries of, one behind the other, and their offsets."""
    bounds = np.concatenate(([0], np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False)))).astype(np.int64)
    b = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    last = b < 128
    offsets = np.concatenate(([0], np.cumsum(last)))[bounds]
    begins = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(b) else np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(begins, np.diff(np.append(begins, len(b))))
    x = np.add.reduceat((b & 127).astype(np.int64) << 7 * place, begins) if len(b) else np.zeros(0, np.int64)
    if rising and len(x):
        total = np.cumsum(x)
        before = np.concatenate(([0], total))[offsets[:-1]]
        x = total - np.repeat(before, np.diff(offsets))
    return x, offsets


def _one(packed: bytes, rising: bool = False) -> np.ndarray:
    return unpack(pa.array([packed], pa.binary()), rising)[0]


def _block(id_: Column) -> tuple[Column, Column]:
    return F.shiftright(id_, 16).alias("block"), id_.bitwiseAND(BLOCK - 1).cast("int").alias("low")


def _packed(pairs: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """keys, n and the packed columns of pairs (keys, low, value); a group has a block's ids at most."""
    grouped = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "value"))).alias("x"))
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            values, offsets = x.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)))).astype(np.int64)
            low, value = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b in ranges(offsets, NUMBERS):
                at, part = offsets[a : b + 1] - offsets[a], slice(offsets[a], offsets[b])
                packed = (pa.array(np.diff(at).astype(np.int32)), pack(low[part], at, True), pack(value[part], at))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keys), *packed], [*keys, "n", first, second])

    return grouped.mapInArrow(run, f"{kinds}, n int, {first} binary, {second} binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each text."""
    for batch in batches:
        ids, found = batch.column("id").to_numpy(), batch.column("found")
        offsets = found.offsets.to_numpy().astype(np.int64)
        for a, b in ranges(offsets, NUMBERS):
            coded = found.values.slice(offsets[a], offsets[b] - offsets[a]).dictionary_encode()
            n = len(coded.dictionary)
            if n == 0:
                continue
            # a number for each text and term
            both, counts = np.unique(np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])) * n + coded.indices.to_numpy(), return_counts=True)
            at = ids[a + both // n]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(both % n)), pa.array(at >> 16), pa.array((at & BLOCK - 1).astype(np.int32)), pa.array(counts.astype(np.int32))], ["term", "block", "low", "value"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its texts and their terms; the lengths of one block are held at a time."""
    for batch in batches:
        for rows in batch.column("rows"):
            length = _latest(rows.as_py(), 0)[0]
            length = length[length > 0] - 1
            yield pa.RecordBatch.from_arrays([pa.array([len(length)]), pa.array([int(length.sum())])], ["texts", "total"])


class Index:
    """The index in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, postings: DataFrame, documents: DataFrame, segment: int) -> None:
        spread = postings.withColumn("folder", (F.crc32(F.col("term").cast("binary")) % FOLDERS).cast("int")).repartition("folder", F.col("block") % 8)
        spread.sortWithinPartitions("folder", "term", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{self.folder}/postings/segment={segment}")
        documents.write.mode("overwrite").parquet(f"{self.folder}/documents/segment={segment}")

    def add(self, docs: DataFrame, segment: int) -> None:
        """Indexes docs (id, text) as a segment; ids must not repeat in it. A segment that is added again, as when a
        streaming batch is run again, takes the place of itself. A null text has no terms."""
        found = docs.select(F.col("id").cast("long").alias("id"), tokens(F.coalesce("text", F.lit(""))).alias("found"))
        terms = found.mapInArrow(_counted, "term string, block bigint, low int, value int")
        # lengths are one more, so that none is left for a removed text
        lengths = found.select(*_block(F.col("id")), (F.size("found") + 1).alias("value"))
        self._write(_packed(terms, ["term", "block"], "ids", "counts"), _packed(lengths, ["block"], "ids", "lengths").drop("n"), segment)

    def remove(self, ids: DataFrame, segment: int) -> None:
        """Marks ids (id) as removed, as a segment."""
        gone = ids.select(*_block(F.col("id").cast("long")), F.lit(0).alias("value")).distinct()
        none = self.spark.createDataFrame([], "term string, block bigint, n int, ids binary, counts binary")
        self._write(none, _packed(gone, ["block"], "ids", "lengths").drop("n"), segment)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def postings(self, terms: list[str]) -> DataFrame:
        folders = {zlib.crc32(t.encode()) % FOLDERS for t in terms}
        return self._read("postings", POSTINGS).where(F.col("folder").isin(*folders) & F.col("term").isin(*terms))

    def matches(self, terms: list[str]) -> DataFrame:
        """id, length and counts (of each term, in their order) of the texts that have any of the terms."""
        found = self.postings(terms).select("block", "segment", (F.array_position(F.array(*map(F.lit, terms)), F.col("term")) - 1).cast("int").alias("place"), "ids", F.col("counts").alias("values"))
        lengths = self._read("documents", DOCUMENTS).join(found.select("block").distinct(), "block", "left_semi")
        both = found.unionByName(lengths.select("block", "segment", F.lit(-1).alias("place"), "ids", F.col("lengths").alias("values")))
        # a row for each term and segment of a block
        blocks = both.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("segment", "place", "ids", "values"))).alias("rows"))
        n = len(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
                    length, last, counts = _latest(rows.as_py(), n)
                    at = np.flatnonzero(counts.any(axis=0))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(counts[:, at].T.ravel()), n).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at), pa.array(length[at] - 1), lists], ["id", "length", "counts"])

        return blocks.mapInArrow(run, "id bigint, length bigint, counts array<int>")

    def search(self, terms: list[str], every: bool) -> DataFrame:
        """The ids of texts that have any, or every one, of the terms."""
        found = self.matches(list(dict.fromkeys(terms)))
        return (found.where(F.forall("counts", lambda c: c > 0)) if every else found).select("id")

    def size(self) -> DataFrame:
        """One row: the texts there are (texts), and all their terms (total)."""
        blocks = self._read("documents", DOCUMENTS).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("segment", F.lit(-1).alias("place"), "ids", F.col("lengths").alias("values")))).alias("rows"))

        return blocks.mapInArrow(_sizes, "texts bigint, total bigint").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))

    def ranked(self, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """id and score of the k texts that are best by BM25; ties to smaller ids."""
        terms = list(dict.fromkeys(terms))
        found = self.matches(terms)
        size = self.size().first()
        with_term = found.agg(*[F.count_if(F.col("counts")[i] > 0).alias(f"n{i}") for i in range(len(terms))]).first()
        weights = [float(np.log(1 + (size.texts - d + 0.5) / (d + 0.5))) for d in with_term]
        mean = size.total / max(1, size.texts)
        norm = k1 * (1 - b + b * F.col("length") / max(mean, 1e-300))
        score = sum((w * F.col("counts")[i] * (k1 + 1) / (F.col("counts")[i] + norm) for i, w in enumerate(weights)), F.lit(0.0))
        return found.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)

    def merged(self, folder: str) -> Index:
        """The same index as one segment in another folder, without what was replaced or removed.

        A block's postings stream through a task behind its lengths; a block is bounded, however large the index."""
        lengths = self._read("documents", DOCUMENTS).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("segment", F.lit(-1).alias("place"), "ids", F.col("lengths").alias("values")))).alias("rows"))
        rows = self._read("postings", POSTINGS).select("block", "term", "segment", "ids", "counts").unionByName(lengths, allowMissingColumns=True)
        spread = rows.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first(), "segment")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = length = None

            for batch in batches:
                heads = [*np.flatnonzero(batch.column("term").is_null().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
                if heads[0] > 0:
                    yield from _live(batch.slice(0, heads[0]), length, last)
                for a, b in zip(heads, heads[1:]):
                    length, last, _ = _latest(batch.column("rows")[a].as_py(), 0)
                    if b > a + 1:
                        yield from _live(batch.slice(a + 1, b - a - 1), length, last)

        def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
                    length, _, _ = _latest(rows.as_py(), 0)
                    at = np.flatnonzero(length)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pack(at, np.array([0, len(at)]), True), pack(length[at], np.array([0, len(at)]))], ["block", "ids", "lengths"])

        new = Index(self.spark, folder)
        new._write(spread.mapInArrow(run, "term string, block bigint, n int, ids binary, counts binary"), lengths.mapInArrow(left, "block bigint, ids binary, lengths binary"), 0)
        return new


def _live(postings: pa.RecordBatch, length: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of one block without the ids whose length or segment (as ``_latest`` has them) is another by now; a term in
    several segments, or batches, may have several. A packed number is a byte at least, so that parts of so many bytes
    have no more numbers."""
    for a, b in ranges(bounds(postings.column("ids")), NUMBERS):
        batch = postings.slice(a, b - a)
        ids, offsets = unpack(batch.column("ids"), True)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        segment = batch.column("segment").to_numpy(zero_copy_only=False)
        on = (last[ids] == segment[row]) & (length[ids] > 0)
        counts = unpack(batch.column("counts"))[0][on]
        n = np.bincount(row[on], minlength=batch.num_rows)
        at = np.concatenate(([0], np.cumsum(n)))
        new = pa.RecordBatch.from_arrays([batch.column("term"), batch.column("block"), pa.array(n.astype(np.int32)), pack(ids[on], at, True), pack(counts, at)], ["term", "block", "n", "ids", "counts"])
        yield new.filter(pa.array(n > 0))


def _latest(rows: list[dict], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each id's length (plus one; 0 without) and segment as of its latest segment, and the terms' counts in that."""
    length, last, counts = np.zeros(BLOCK, np.int64), np.full(BLOCK, -1, np.int64), np.zeros((terms, BLOCK), np.int32)
    for r in rows:  # by segment
        if r["place"] < 0:
            ids = _one(r["ids"], True)
            length[ids], last[ids] = _one(r["values"]), r["segment"]
    for r in rows:
        if r["place"] >= 0:
            ids, values = _one(r["ids"], True), _one(r["values"])
            live = (last[ids] == r["segment"]) & (length[ids] > 0)
            counts[r["place"], ids[live]] = values[live]
    return length, last, counts
