"""Processed articles and their graph as tables that streams and batches write: inserts, point reads, status changes.

Each write is a batch of tables.Latest: run again, it says the same once more, and of a row the last batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Latest

#: The columns of a processed article; fixed names.
PROCESSED = (
    "id long, raw_id long, summary string, event_type string, sentiment string, magnitude string, confidence double, key_quotes array<string>, score double, is_critical boolean, "
    "rule_hits array<string>, llm_reason string, model_used string, extracted_at timestamp, push_status string"
)
#: The columns of a relation between entities; fixed names.
RELATIONS = "subject_id long, predicate string, object_id long, source_news_id long, confidence double, valid_from timestamp, valid_until timestamp"
#: What a row is until it is pushed; fixed value.
PENDING = "pending"


class Processed:
    """Processed articles by id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Latest(spark, folder, PROCESSED, ["id"])

    def insert(self, rows: DataFrame, batch: int) -> None:
        """Adds rows, whose columns may be any of the table's: those without are null, and the status is pending. The first
        row of an id that a batch has stands, by the time it was extracted."""
        given = {c.lower() for c in rows.columns}
        fields = self.table.schema.fields
        full = rows.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).withColumn("push_status", F.coalesce("push_status", F.lit(PENDING)))
        others = [f.name for f in fields if f.name != "id"]
        one = full.groupBy("id").agg(F.min_by(F.struct(*others), F.struct(F.coalesce("extracted_at", F.to_timestamp(F.lit("9999-12-31"))), "raw_id")).alias("_row"))
        self.table.upsert(one.select("id", "_row.*"), batch)

    def mark(self, statuses: DataFrame, batch: int) -> None:
        """Sets the push status of rows (id, push_status); ids that aren't there are no-ops."""
        new = statuses.groupBy("id").agg(F.max("push_status").alias("_status"))
        changed = self.table.current(batch).join(new, "id").withColumn("push_status", F.col("_status")).drop("_status")
        self.table.upsert(changed, batch)

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of ids (id), null where there is none."""
        return ids.select("id").join(self.table.current(), "id", "left")

    def pending(self) -> DataFrame:
        return self.table.current().where(F.col("push_status") == PENDING)


class Relations:
    """Relations of entities by what they say and the article that says it; the last insert's confidence and dates count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Latest(spark, folder, RELATIONS, ["subject_id", "predicate", "object_id", "source_news_id"])

    def insert(self, rows: DataFrame, batch: int) -> None:
        given = set(rows.columns)
        full = rows.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.table.schema.fields])
        values = [c for c in self.table.schema.names if c not in self.table.keys]
        best = full.groupBy(*self.table.keys).agg(F.max_by(F.struct(*values), F.coalesce("confidence", F.lit(-1.0))).alias("_row"))
        self.table.upsert(best.select(*self.table.keys, "_row.*"), batch)

    def valid(self, at) -> DataFrame:
        """The relations that hold at a time; an open end is for ever."""
        rows = self.table.current()
        return rows.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
