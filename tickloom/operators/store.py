"""Tables that grow: logs, dead letters, alert history, retention, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_or_get(held: DataFrame, rows: DataFrame, key: str | list[str], order: list[str], id_col: str = "id") -> DataFrame:
    """key, id, is_new, stored for each distinct key of rows: the id under which the key is held, or else the id of the
    first of its rows by ``order``, which is what an insert adds (``stored`` is that row; null for held keys)."""
    keys = [key] if isinstance(key, str) else key
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("stored"))
    known = held.groupBy(*keys).agg(F.min(id_col).alias("_held"))
    out = first.join(known, keys, "left")
    is_new = F.col("_held").isNull()
    return out.select(*keys, F.coalesce("_held", F.col("stored")[id_col]).alias("id"), is_new.alias("is_new"), F.when(is_new, F.col("stored")).alias("stored"))


def insert_new(held: DataFrame, rows: DataFrame, key: str | list[str], order: list[str] | None = None) -> DataFrame:
    """The rows whose key isn't held, one of each key (the first by ``order``, or by all columns): what an insert-or-get adds."""
    keys = [key] if isinstance(key, str) else key
    fresh = rows.join(held.select(*keys).distinct(), keys, "left_anti")
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return fresh.distinct()
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*(order or others))).alias("_first"))
    return first.select(*keys, "_first.*").select(*rows.columns)


def newest(log: DataFrame, n: int, at: str = "created_at", ordinal: str = "id") -> DataFrame:
    return log.orderBy(F.col(at).desc(), F.col(ordinal).desc()).limit(n)


def looked_up(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Point reads: each key asked for with its row's columns, null where there is none."""
    return asked.join(rows, keys, "left")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key; an error if a key has more than one."""
    others = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_r"))
    sure = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row of a key"))).otherwise(F.col("_r"))
    return one.withColumn("_r", sure).select(*keys, "_r.*")


def resolve(letters: DataFrame, ids: DataFrame, at: Column, column: str = "resolved_at") -> DataFrame:
    """Rows (dead letters, a digest's items) with those of the ids marked as done; ids that aren't there are no-ops."""
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    return letters.join(done, "id", "left").withColumn(column, F.when(F.col("_done"), F.coalesce(column, at)).otherwise(F.col(column))).drop("_done")


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows that are at most so many days old."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def canonical(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """A name column replaced by its canonical name, whatever its case; aliases (alias, name) may be of any size, and the least name
    of an alias stands."""
    known = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.min("name").alias("_c"))
    return rows.join(known, F.lower(column) == F.col("_a"), "left").withColumn(column, F.coalesce("_c", column)).drop("_a", "_c")


def history(alerts: DataFrame, snapshot: list[str]) -> DataFrame:
    """Alerts with their snapshot as JSON text, as the history keeps them."""
    return alerts.select(*[c for c in alerts.columns if c not in snapshot], F.to_json(F.struct(*snapshot)).alias("snapshot"))


def bumped(states: DataFrame, held_back: DataFrame) -> DataFrame:
    """states (rule_id, ticker, ..., count_today) with the number of held-back hits (rule_id, ticker) added; a hit whose
    state isn't there changes nothing."""
    n = held_back.groupBy("rule_id", "ticker").agg(F.count(F.lit(1)).alias("_n"))
    return states.join(n, ["rule_id", "ticker"], "left").withColumn("count_today", F.col("count_today") + F.coalesce("_n", F.lit(0))).drop("_n")


def daily_triggers(fires: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """rule_id, ticker, day, n: triggers of each local day."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("epoch"), zone))
    return fires.groupBy("rule_id", "ticker", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def watch(entries: Column, add: Column | None = None, remove: Column | None = None) -> Column:
    """A watchlist with a ticker added or removed; doing it twice changes nothing."""
    out = entries if add is None else F.array_union(entries, F.array(add))
    return out if remove is None else F.array_remove(out, remove)


def reset(states: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Source states with the named ones as if nothing had happened: no pause, no errors."""
    named = keys.select(key).distinct().withColumn("_reset", F.lit(True))
    out = states.join(named, key, "left").withColumns({"paused_until": F.when(F.col("_reset").isNull(), F.col("paused_until")), "errors": F.when(F.col("_reset"), F.lit(0).cast("bigint")).otherwise(F.col("errors"))})
    return out.drop("_reset")


def zero_filled(rows: DataFrame, key: str, known: list[str]) -> DataFrame:
    """name, n: the rows of each known key, 0 where there are none; keys that aren't known are left out."""
    counts = rows.where(F.col(key).isin(*known)).groupBy(F.col(key).alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    names = rows.sparkSession.createDataFrame([(k,) for k in known], "name string")
    return names.join(counts, "name", "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


def effective(watched: DataFrame, settings: DataFrame) -> DataFrame:
    """market, ticker of watched (market, by_rules, ticker): the rules' entries where settings (market, rules_on) say so,
    else the model's."""
    return watched.join(settings, "market").where(F.col("by_rules") == F.col("rules_on")).select("market", "ticker")
