"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's target is its weighted share of all words, at most ``most_passes`` times what it has. Blocks of equally
many words are the seats: they go to the highest quotients target / (2 * seats + 1), first among the sources, then
among the shards of each source, where a shard can't take more than ``most_passes`` times its words. A shard's quota is
then filled with whole passes over its documents and, for the rest, with the leading blocks of the documents in seeded
random order. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

#: Documents a shard should have, and the most shards a source is dealt to: the apportionment of one source is
#: a window over at most that many rows, however large the source is.
SHARD_DOCS, MOST_SHARDS = 64, 4096
#: A block has at most this part of the smallest target, and at most so many words.
BLOCK_PART, BLOCK_WORDS = 200, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3) -> DataFrame:
    """From (source, size): source, source_size, target. Sources by code point, null last, get the weights in turn.

    The excess of sources at their limit is shared again by weight. At the fixed point a source has
    min(level * weight, limit): with the sources by limit / weight, the limits hold up to the one at which the rest of
    the words over the rest of the weights no longer passes the next limit. The window's rows are sources, whose number
    someone has set weights for; documents are summed before."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    one = Window.partitionBy()
    table = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(table, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", most_passes * F.col("source_size"))
    tight = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(one)).withColumn("weights", F.sum("weight").over(one))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(tight), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(tight), F.lit(0))))
    # the first source, in this order, that stays below its limit sets the level for all
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(one)
    per = per.withColumn("level", free["level"])
    return per.withColumn("target", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")), F.col("limit").cast("double")))


def apportion(parties: DataFrame, key: list[str], votes: str, seats: str, most: str, within: list[str], out: str) -> DataFrame:
    """Sainte-Lague: adds ``out``, the seats of each party, out of ``seats`` in all for the parties of a group.

    Seats go to the highest quotients votes / (2k + 1), ties to the smaller key; no party gets more than ``most``. A
    party's number of seats is near its exact share: what could change it is less than a seat for each party, spread
    by size. So each party is given its share less that margin, and only the seats within the margin are laid out as
    rows and ranked: a few for each party, however many seats there are."""
    group = Window.partitionBy(*within)
    per = parties.withColumn("_all", F.sum(votes).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all") * F.col(seats)).otherwise(0.0)
    margin = F.ceil(F.col("_share") * F.col("_n") / F.greatest(F.col(seats), F.lit(1))) + 2
    per = per.withColumn("_share", share).withColumn("_margin", margin)
    low = F.least(F.greatest(F.floor("_share") - F.col("_margin"), F.lit(0)), F.col(most)).cast("long")
    high = F.least(F.ceil("_share") + F.col("_margin"), F.col(most)).cast("long")
    per = per.withColumn("_low", low).withColumn("_high", high).withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    rows = per.select("*", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))).alias("_k"))
    ranked = Window.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("_k"))
    won = rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    joined = per.alias("p").join(won.alias("w"), same, "left")
    return joined.select(*[f"p.{c}" for c in parties.columns], (F.col("p._low") + F.coalesce("w._won", F.lit(0))).alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each row of (doc_id, text, source).

    A null or blank text has size 0 and nothing is taken of it; a text of any length is one document, of which a part may be
    taken; repeated rows are rows of their own, ordered
    among themselves by nothing that shows; an empty table gives an empty result; other columns are not read. Each
    shard takes its quota to the word, so a source's taken words differ from its target by a block at most, and by what
    rounding at the limit costs its shards."""
    sized = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per = source_targets(sized.select("source", "size"), weights, most_passes)
    one = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(one) / BLOCK_PART))).cast("long")
    per = per.withColumn("block", F.coalesce(block, F.lit(1))).withColumn("seats", F.round(F.sum("target").over(one) / F.col("block")).cast("long"))
    per = per.withColumn("most", F.ceil(F.col("limit") / F.col("block")).cast("long"))
    per = per.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_docs") / SHARD_DOCS))).cast("int"))
    per = durable(apportion(per.withColumn("every", F.lit(0)), ["source"], "target", "seats", "most", ["every"], "quota"))

    shards = per.select(F.col("source").alias("s"), "shards")
    dealt = sized.join(shards, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    draw = F.xxhash64(F.lit(seed), "doc_id")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards").cast("long"))).drop("shards")
    held = dealt.groupBy("source", "shard").agg(F.sum("size").alias("held"))
    held = held.join(per.select(F.col("source").alias("s"), "source_size", "target", "block", "quota"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    held = held.withColumn("most", F.floor(most_passes * F.col("held") / F.col("block")).cast("long"))
    quotas = apportion(held, ["source", "shard"], "held", "quota", "most", ["source"], "blocks")
    # a shard that gets all it may take has no rest for a last block that would not fit
    room = F.when(F.col("blocks") >= F.col("most"), F.least(F.col("blocks") * F.col("block") + F.col("block") - 1, most_passes * F.col("held")))
    exact = F.when(F.col("target") >= most_passes * F.col("source_size"), most_passes * F.col("held"))
    quotas = quotas.withColumn("words", F.coalesce(exact, room, F.col("blocks") * F.col("block")))

    q = quotas.select(F.col("source").alias("s"), F.col("shard").alias("h"), "held", "words", "source_size", "target")
    line = dealt.join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h")
    order = Window.partitionBy("source", "shard").orderBy(draw, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    passes = F.when(F.col("held") > 0, F.floor(F.col("words") / F.col("held"))).otherwise(0)
    rest = F.when(F.col("held") > 0, F.col("words") % F.col("held")).otherwise(0)
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return line.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs as the mix takes them: each document as often as ``taken`` has its size, rounded.

    Only the document at the end of a shard's quota is taken in part; rounding makes it whole or leaves it out. A
    document without words is neutral to the mix and stays once. Rows that share a doc_id are taken alike. Columns are
    carried under their own names, whatever they are; an empty table gives an empty result."""
    taken = mix(docs, weights, most_passes, seed).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1)).cast("int").alias("times"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(taken, F.col("row.doc_id").eqNullSafe(F.col("doc_id"))).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
