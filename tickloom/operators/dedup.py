"""Exact and near-duplicate elimination of articles by url hash and title simhash.

Hash values meet in bands, and only values of the same or of neighbouring periods of the look-back's length; so what is
compared is what a day or two of titles share a band with, not the whole history. Rows don't meet in pairs: the rows of a
value and of the values near it are ordered by time once, and each row is passed once. A title that comes four thousand
times costs four thousand rows, in time too."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming
from . import asof
from .components import components
from .durable import durable

WINDOW_HOURS = 24
#: Blocks of time that a window is cut into, so that rows of one title go to as many tasks.
BLOCKS = 16


def bands(column: str, distance: int):
    """The 64 bits in distance + 1 bands, numbered: two hashes within the distance agree on one at least."""
    cuts = [64 * i // (distance + 1) for i in range(distance + 2)]
    parts = [F.struct(F.lit(i).alias("band"), F.call_function("shiftrightunsigned", F.col(column), F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return F.array(*parts)


def placed(rows: DataFrame, hours: int) -> DataFrame:
    """rows with _at (microseconds) and _k, the period of so many hours."""
    at = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return rows.withColumn("_at", at).withColumn("_k", F.floor(F.col("_at") / (hours * 3_600_000_000)))


def near_values(rows: DataFrame, distance: int) -> DataFrame:
    """h1, k1, h2, k2: values within the distance, equal ones too, of the same period or of the one before (k1)."""
    keyed = rows.select("simhash", "_k").distinct().select("simhash", "_k", F.inline(bands("simhash", distance)))
    a = keyed.select(F.col("simhash").alias("h1"), F.col("_k").alias("k1"), "band", "bits", F.explode(F.array(F.col("_k"), F.col("_k") + 1)).alias("k2"))
    b = keyed.select(F.col("simhash").alias("h2"), F.col("_k").alias("k2"), "band", "bits")
    close = a.join(b, ["k2", "band", "bits"]).where(hamming(F.col("h1"), F.col("h2")) <= distance)
    return close.select("h1", "k1", "h2", "k2").distinct()


def looked_back(rows: DataFrame, near: DataFrame, hours: int) -> DataFrame:
    """rows (id, simhash, _at, _k, ...) with ``first``: the first earlier row, as a struct (_at, id, simhash), near enough and
    within the hours; null if there is none.

    The first row of a window that slides is the next one after the window's beginning: an as-of join backwards in time, in
    which each row is passed once, however many are in the window. Titles that come very often are cut into blocks of time."""
    seen = rows.select("simhash", "_k", "_at", "id").join(near, (F.col("simhash") == F.col("h1")) & (F.col("_k") == F.col("k1")))
    seen = seen.select(F.col("h2").alias("_h"), F.col("k2").alias("_b"), "_at", "id", F.struct("_at", "id", "simhash").alias("_one"))
    asks = rows.select("*", F.col("simhash").alias("_h"), F.col("_k").alias("_b"))
    window = hours * 3_600_000_000
    found = asof.joined(asks, seen, ["_h", "_b"], window - F.col("_at"), -F.col("_at"), F.col("_one"), -F.col("id"), max(1, window // BLOCKS), True)
    earlier = F.struct("_found._at", "_found.id") < F.struct("_row._at", "_row.id")
    return found.select(*[F.col("_row")[c].alias(c) for c in rows.columns], F.when(earlier, F.col("_found")).alias("first"))


def near_pairs(rows: DataFrame, distance: int = 4, hours: int = WINDOW_HOURS) -> DataFrame:
    """later, earlier, distance: of each row (id, simhash, fetched_at) that has any, its first neighbour within the distance
    and the time window. A row each at most, however often a title comes."""
    rows = placed(rows.select("id", "simhash", "fetched_at"), hours)
    found = looked_back(rows, near_values(rows, distance), hours).where("first is not null")
    return found.select(F.col("id").alias("later"), F.col("first.id").alias("earlier"), hamming(F.col("simhash"), F.col("first.simhash")).alias("distance"))


def chained(rows: DataFrame, near: DataFrame) -> DataFrame:
    """rows (id, url_hash, simhash, _at, _k) with ``chain``: rows that can bear on each other's decision share it.

    Links are between values and periods, not rows: values near each other in the same or neighbouring periods, and what
    has the same url. So a title that comes all year is as many nodes as days, and what lies more than a window apart is
    in different chains."""
    node = lambda h, k: F.concat_ws(":", h.cast("string"), k.cast("string"))
    links = near.where("h1 <> h2 OR k1 <> k2").select(node(F.col("h1"), F.col("k1")).alias("a"), node(F.col("h2"), F.col("k2")).alias("b"))
    shared = rows.groupBy("url_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND url_hash IS NOT NULL").select("url_hash")
    urls = rows.join(shared, "url_hash").select(node(F.col("simhash"), F.col("_k")).alias("a"), F.concat(F.lit("u"), "url_hash").alias("b")).distinct()
    found = components(links.unionByName(urls)).select(F.col("node").alias("_node"), "component")
    named = rows.withColumn("_own", node(F.col("simhash"), F.col("_k"))).join(found, F.col("_own") == F.col("_node"), "left")
    return named.withColumn("chain", F.coalesce("component", "_own")).drop("_own", "_node", "component")


class Register:
    """The new rows of a chain so far: by url for ever, by value for a window."""

    def __init__(self, distance: int, window: int):
        self.distance, self.window = distance, window
        self.cuts = [64 * i // (distance + 1) for i in range(distance + 2)]
        self.urls: dict[str | None, int] = {}
        self.near: dict[tuple[int, int], deque[tuple[int, int, int]]] = {}

    def keys(self, value: int) -> list[tuple[int, int]]:
        bits = value & (1 << 64) - 1
        return [(a, bits >> a & (1 << b - a) - 1) for a, b in zip(self.cuts, self.cuts[1:])]

    def decide(self, id_: int, url: str | None, value: int, at: int) -> tuple[str, int | None]:
        """new, url_hash or simhash, and the first new row that it repeats; a new row is registered."""
        if (twin := self.urls.get(url)) is not None and url is not None:
            return "url_hash", twin
        keys, found = self.keys(value), None
        for key in keys:
            held = self.near.get(key)
            if held is None:
                continue
            while held and held[0][0] < at - self.window:
                held.popleft()
            if not held:
                del self.near[key]
            for one in held:
                if found is not None and one >= found:
                    break
                if ((one[2] ^ value) & (1 << 64) - 1).bit_count() <= self.distance:
                    found = one
                    break
        if found is not None:
            return "simhash", found[1]
        self.urls[url] = id_
        for key in keys:
            self.near.setdefault(key, deque()).append((at, id_, value))
        return "new", None


def check_and_register(rows: DataFrame, distance: int = 4, hours: int = WINDOW_HOURS) -> DataFrame:
    """id, decision (new, url_hash or simhash), duplicate_of for rows (id, url_hash, simhash, fetched_at).

    Rows are taken by (fetched_at, id). One is new if no earlier new row has its url hash and none of the last hours is
    within the distance; rejected rows never stand for others, and of several twins the first counts. A null url is no
    url. Rows that can bear on each other form chains, which are found on values and periods; each chain's rows stream
    once through a task in order, with the new rows of the last hours as its state. So the number of jobs does not depend
    on how often a title comes again; a chain is decided one row after another, as the rule says."""
    held = durable(placed(rows.select("id", "url_hash", "simhash", "fetched_at"), hours))
    near = durable(near_values(held, distance))
    window = hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, register = None, Register(distance, window)
        for batch in batches:
            out = []
            for c, *row in zip(*(batch.column(n).to_pylist() for n in ("chain", "id", "url_hash", "simhash", "_at"))):
                if c != chain:
                    chain, register = c, Register(distance, window)
                out.append(register.decide(*row))
            decisions, of = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decisions, pa.string()), pa.array(of, pa.int64())], ["id", "decision", "duplicate_of"])

    dealt = chained(held, near).select("chain", F.col("id").cast("long").alias("id"), "url_hash", "simhash", "_at").repartition("chain").sortWithinPartitions("chain", "_at", "id")
    return dealt.mapInArrow(run, "id bigint, decision string, duplicate_of bigint")
