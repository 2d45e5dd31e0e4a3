"""What becomes of each article: the modes of processing, and the plans that processed ones are pushed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import burst


def status(rules_on: bool, model_on: bool, matched: Column, failed: Column, empty: Column, gray_dropped: Column | None = None) -> Column:
    """An article's status: skipped_rules without a match (where rules are on), dead if the model failed, skipped if it had
    nothing to say, skipped_grayzone if its score lies in a gray zone that is dropped, else processed.

    With the rules off and no model nothing can be processed, which is an error of the settings."""
    if not rules_on and not model_on:
        raise ValueError("rules or the model must be on")
    out = F.when(F.lit(rules_on) & ~matched, "skipped_rules")
    if model_on:
        out = out.when(failed, "dead").when(empty, "skipped")
    if gray_dropped is not None:
        out = out.when(gray_dropped, "skipped_grayzone")
    return out.otherwise("processed")


def pushed(plans: DataFrame, window: float, threshold: int) -> DataFrame:
    """plan, id, outcome (sent, suppressed or digest) of plans (plan, id, at, immediate, tickers), in order of (at, plan).

    Each immediate plan passes the burst rule by itself, so an article for two markets counts twice for its tickers. Plans
    that aren't immediate become one row of the digest for each article: its first."""
    now = plans.where("immediate").select(F.col("plan").alias("id"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("epoch"), "tickers")
    sent = burst(now, window, threshold).select(F.col("id").alias("plan"), F.when(F.col("sent"), "sent").otherwise("suppressed").alias("outcome"))
    later = plans.where("not immediate").groupBy("id").agg(F.min("plan").alias("plan")).select("plan", "id", F.lit("digest").alias("outcome"))
    return plans.select("plan", "id").join(sent, "plan").unionByName(later)
