"""What a language model adds to articles: prompts out, lenient parsing of what comes back, costs and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_json

#: Allowed values and the default that anything else becomes; fixed values.
ENUMS = {
    "event_type": (("earnings", "m_and_a", "policy", "price_move", "downgrade", "upgrade", "filing", "other"), "other"),
    "sentiment": (("bullish", "bearish", "neutral"), "neutral"),
    "magnitude": (("low", "medium", "high"), "low"),
    "predicate": (("supplies", "competes_with", "owns", "regulates", "partners_with", "mentions"), "mentions"),
    "entity_type": (("company", "person", "event", "sector", "policy", "product"), "company"),
    "market": (("us", "cn"), None),
}
PAYLOAD = "struct<summary: string, related_tickers: array<string>, sectors: array<string>, event_type: string, sentiment: string, magnitude: string, confidence: double, key_quotes: array<string>>"


def lenient(value: Column, kind: str) -> Column:
    """A value of an enumeration in lower case; the default for unknown and missing ones."""
    allowed, default = ENUMS[kind]
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(F.lit(default).cast("string"))


def asked(articles: DataFrame, prompt: Column, client: Callable[[list[str]], list[str | None]], batch: int = 32) -> DataFrame:
    """articles with ``answer``: what the client returns for each prompt, null where it fails.

    The client is any function of a list of prompts; it runs in the tasks, so a test's stub and a model server's client
    are used alike. A failed call costs its own batch only, and ``failure`` says why (null where it didn't fail)."""
    rows = articles.withColumn("_prompt", prompt)
    names = [c for c in articles.columns if c not in ("answer", "failure")]
    schema = articles.select(*names).schema.add("answer", "string").add("failure", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers: list[str | None] = []
            failures: list[str | None] = []
            prompts = pdf["_prompt"].tolist()
            for s in range(0, len(prompts), batch):
                n = len(prompts[s : s + batch])
                try:
                    got, why = list(client(prompts[s : s + batch])), None
                    if len(got) != n:
                        raise ValueError(f"{len(got)} answers to {n} prompts")
                except Exception as e:  # noqa: BLE001
                    got, why = [None] * n, f"{type(e).__name__}: {e}"
                answers, failures = answers + got, failures + [why] * n
            yield pdf[names].assign(answer=answers, failure=failures)

    return rows.mapInPandas(run, schema)


def extracted(answers: DataFrame) -> DataFrame:
    """answers with the fields of the payload, defaults filled in, and ``dead`` where no object could be read."""
    df = answers.withColumn("_p", best_json(F.col("answer"), PAYLOAD))
    none = F.array().cast("array<string>")
    fields = {c: F.coalesce(F.col("_p")[c], none) for c in ("related_tickers", "sectors", "key_quotes")}
    fields |= {c: lenient(F.col("_p")[c], c) for c in ("event_type", "sentiment", "magnitude")}
    fields |= {"summary": F.col("_p")["summary"], "confidence": F.coalesce(F.col("_p")["confidence"], F.lit(0.5)), "dead": F.col("_p").isNull() | F.col("_p")["summary"].isNull()}
    return df.withColumns(fields).drop("_p")


#: The first tier's answer, and what the third adds to the second's.
TITLE = "struct<relevant: boolean, tier_hint: string, watchlist_hit: boolean, reason: string>"
DEEP = "struct<entities: array<struct<type: string, name: string, ticker: string, market: string, aliases: array<string>>>, relations: array<struct<subject_name: string, object_name: string, predicate: string, confidence: double>>>"


def titled(answers: DataFrame) -> DataFrame:
    """answers with the first tier's fields, defaults filled in, and ``dead`` where no object could be read."""
    df = answers.withColumn("_p", best_json(F.col("answer"), TITLE))
    no, p = F.lit(False), F.col("_p")
    fields = {"relevant": F.coalesce(p["relevant"], no), "tier_hint": F.coalesce(p["tier_hint"], F.lit("tier1")), "watchlist_hit": F.coalesce(p["watchlist_hit"], no), "reason": F.coalesce(p["reason"], F.lit("")), "dead": p.isNull()}
    return df.withColumns(fields).drop("_p")


def deep(answers: DataFrame) -> DataFrame:
    """answers with the second tier's fields (a missing summary is empty here), and entities and relations: entities without
    a name go, and relations whose ends aren't entities of the answer; of entities with one name the last counts."""
    df = extracted(answers).withColumn("_d", best_json(F.col("answer"), DEEP)).withColumns({"dead": F.col("_d").isNull(), "summary": F.coalesce("summary", F.lit(""))})
    none = F.array().cast("array<string>")
    named = F.filter(F.coalesce(F.col("_d")["entities"], F.array()), lambda e: F.coalesce(e["name"], F.lit("")) != "")
    entities = F.transform(named, lambda e: F.struct(lenient(e["type"], "entity_type").alias("type"), e["name"].alias("name"), e["ticker"].alias("ticker"), lenient(e["market"], "market").alias("market"), F.coalesce(e["aliases"], none).alias("aliases")))
    df = df.withColumn("entities", F.filter(entities, lambda e, i: ~F.exists(F.slice(entities, i + 2, F.size(entities)), lambda x: x["name"] == e["name"])))
    known = F.transform("entities", lambda e: e["name"])
    relations = F.filter(F.coalesce(F.col("_d")["relations"], F.array()), lambda r: F.array_contains(known, r["subject_name"]) & F.array_contains(known, r["object_name"]))
    relations = F.transform(relations, lambda r: F.struct(r["subject_name"].alias("subject"), lenient(r["predicate"], "predicate").alias("predicate"), r["object_name"].alias("object"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence")))
    return df.withColumn("relations", relations).drop("_d")


def judged(answers: DataFrame) -> DataFrame:
    """answers with the judge's is_critical and reason; an answer that can't be read is not critical."""
    p = best_json(F.col("answer"), "struct<is_critical: boolean, reason: string>")
    return answers.withColumn("_p", p).withColumns({"is_critical": F.coalesce(F.col("_p")["is_critical"], F.lit(False)), "reason": F.coalesce(F.col("_p")["reason"], F.lit(""))}).drop("_p")


def chosen_model(configured: Column, premium_ready: bool, fallback: str, prefix: str = "claude-") -> Column:
    """client, model: a premium model without its client falls back to the other client's cheap one."""
    premium = configured.startswith(prefix)
    return F.struct(F.when(premium & F.lit(premium_ready), "premium").otherwise("standard").alias("client"), F.when(premium & ~F.lit(premium_ready), fallback).otherwise(configured).alias("model"))


def costs(calls: DataFrame, prices: DataFrame, ceiling: float) -> DataFrame:
    """day, cost, remaining, reached, warned for calls (model, at, tokens_in, tokens_out) and prices per 1000 tokens; a
    model without a price costs nothing."""
    each = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1000
    day = calls.join(prices, "model", "left").groupBy(F.to_date("at").alias("day")).agg(F.sum(each).alias("cost"))
    return day.withColumns({"remaining": F.greatest(F.lit(0.0), F.lit(ceiling) - F.col("cost")), "reached": F.col("cost") >= ceiling, "warned": F.col("cost") >= 0.8 * ceiling})


def agreement(got: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """n, and for each field how often an extraction agrees with the gold set, and their mean."""
    g = gold.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    rates = [F.avg(F.col(f).eqNullSafe(F.col(f"_{f}")).cast("double")).alias(f) for f in fields]
    out = got.join(g, "id").agg(F.count(F.lit(1)).alias("n"), *rates)
    total = F.col(fields[0])
    for f in fields[1:]:
        total = total + F.col(f)
    return out.withColumn("mean", total / len(fields))
