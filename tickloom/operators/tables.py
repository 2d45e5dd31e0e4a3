"""Tables that streams keep: written a batch at a time, each batch once however often it runs.

A batch's rows lie in a folder of its number, which a run again overwrites, so its effect is once. What a batch reads is
what the batches before it wrote, and never its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .durable import durable


class Versions:
    """Rows by batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType):
        self.spark, self.folder = spark, folder
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, rows: DataFrame, batch: int, *partitions: str) -> None:
        names = self.schema.names
        rows.select(*names, *[p for p in partitions if p not in names]).write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.folder}/batch={batch}")

    def read(self, before: int | None = None, extra: str = "") -> DataFrame:
        """All rows with their batch, or those of the batches before one; none, if nothing was written yet."""
        schema = StructType(self.schema.fields).add("batch", "integer")
        for f in StructType.fromDDL(extra).fields if extra else ():
            schema = schema.add(f)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.folder)
        return rows if before is None else rows.where(F.col("batch") < before)

    def at(self, batch: int) -> DataFrame:
        """The rows of one batch."""
        return self.read().where(F.col("batch") == batch).drop("batch")


class Latest(Versions):
    """A keyed table: of each key the row of its last batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str]):
        super().__init__(spark, folder, schema)
        self.keys = keys

    def upsert(self, rows: DataFrame, batch: int) -> None:
        self.write(rows, batch)

    def current(self, before: int | None = None) -> DataFrame:
        others = [c for c in self.schema.names if c not in self.keys]
        last = self.read(before).groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
        return last.select(*self.keys, "_row.*")

    def compacted(self, folder: str, upto: int) -> Latest:
        """The same table in a new folder, the batches up to one as a single one of that number."""
        new = Latest(self.spark, folder, self.schema, self.keys)
        new.write(self.current(upto + 1), upto)
        for row in self.read().where(F.col("batch") > upto).select("batch").distinct().collect():
            new.write(self.at(row.batch), row.batch)
        return new


#: Bits for each key of a filter and how many of them a key sets: of a hundred thousand new keys about two are looked up in vain.
BITS, MARKS = 24, 12


def _marks(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The places that each key sets, a row a key."""
    a, b = h1.view(np.uint64)[:, None], (h2.view(np.uint64) | np.uint64(1))[:, None]
    with np.errstate(over="ignore"):
        return ((a + b * np.arange(MARKS, dtype=np.uint64)) >> np.uint64(11)) % np.uint64(bits)


class KeyedStore(Versions):
    """Rows of distinct keys that only grow, in folders by a hash of the key, with Bloom filters for each batch and folder.

    A batch asks the filters first, a few bytes a key: keys that no filter knows are new, and the folders of the others,
    which are mostly those that do repeat, are the only ones whose keys are read."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: str, folders: int = 256):
        super().__init__(spark, f"{folder}/rows", schema)
        self.key, self.folders = key, folders
        self.filters = Versions(spark, f"{folder}/filters", "place int, bits int, filter binary")

    def _place(self) -> Column:
        return F.pmod(F.crc32(F.col(self.key).cast("string").cast("binary")), F.lit(self.folders)).cast("int")

    def place_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self.folders

    def _hashed(self, rows: DataFrame) -> DataFrame:
        text = F.col(self.key).cast("string")
        return rows.select(self.key, self._place().alias("place"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Appends rows, whose keys the store doesn't have, and their filters."""
        placed = rows.select(*self.schema.names, self._place().alias("place"))
        self.write(placed, batch, "place")
        each = self._hashed(self.at_place(batch)).groupBy("place").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for place, keys in zip(b.column("place").to_pylist(), b.column("keys")):
                    h1, h2 = (keys.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    bits = max(64, BITS * len(h1))
                    marks = np.zeros(bits, bool)
                    marks[_marks(h1, h2, bits).ravel()] = True
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([bits], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], ["place", "bits", "filter"])

        self.filters.write(each.mapInArrow(run, "place int, bits int, filter binary"), batch)

    def at_place(self, batch: int) -> DataFrame:
        return self.read(extra="place int").where(F.col("batch") == batch)

    def perhaps(self, rows: DataFrame, batch: int) -> DataFrame:
        """Of the rows' keys (key, place) those that the batches before may have."""
        keys = self._hashed(rows).distinct().groupBy("place").agg(F.collect_list(F.struct(self.key, "h1", "h2")).alias("keys"))
        met = keys.join(self.filters.read(batch), "place").select("place", "keys", "bits", "filter")
        kind = rows.schema[self.key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for place, keys, bits, packed in zip(b.column("place").to_pylist(), b.column("keys"), b.column("bits").to_pylist(), b.column("filter").to_pylist()):
                    values = keys.values
                    h1, h2 = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                    marks = np.unpackbits(np.frombuffer(packed, np.uint8))[:bits].astype(bool)
                    on = pa.array(marks[_marks(h1, h2, bits)].all(axis=1))
                    some = values.field(0).filter(on)
                    yield pa.RecordBatch.from_arrays([some, pa.array([place] * len(some), pa.int32())], ["key", "place"])

        return met.mapInArrow(run, f"key {kind}, place int").distinct().withColumnRenamed("key", self.key)

    def held(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows' keys that the batches before one have; only the folders of keys that may be there are read."""
        some = durable(self.perhaps(rows, batch))
        places = [r.place for r in some.select("place").distinct().collect()]
        found = self.read(batch, "place int").where(F.col("place").isin(*places)).select(self.key, "place").join(some, [self.key, "place"], "left_semi").select(self.key).distinct()
        return found
