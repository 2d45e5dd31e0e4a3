"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder that the cluster names.

    The session's ``spark.checkpoint.dir`` is used. Where it is unset, a local session (tests) takes a temporary folder;
    on a cluster, whose executors don't share one, that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be one of ``taken``, whatever the case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """The text less the given characters."""
    return F.translate(text, characters, "")


#: Rows up to which a table of a few columns, such as one row for each source, is broadcast.
BROADCAST_ROWS = 50_000


def lookup(df: DataFrame) -> DataFrame:
    """A table of groups, made durable, and broadcast if it is counted to be small; else it is joined by shuffling."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
