"""Quality classifier by hierarchical empirical Bayes.

A logistic regression, trained on a bounded sample of the labelled documents, gives each document's own evidence. Hosts
and paths within hosts (here the source, and the language within it) get Beta posteriors from the evidence of all their
documents, by grouped sums: a path is shrunk towards its host and a host towards the corpus, by as much as their means
vary beyond chance. A document's posterior odds are its own evidence times the prior odds of its path, from which its
own part is taken out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, durable, fresh, lookup, without, words

#: Labelled rows that the regression is trained on at most: those with the smallest hashes of their ids.
MOST_LABELLED = 5_000
#: A document is rejected if its posterior probability of being good is below this.
THRESHOLD = 0.5
FEATURES = ("symbols", "capitals", "exclaimed", "variety", "length", "variety_length", "word_length")


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``x``, numbers that tell prose from junk (an array), null for a text without words."""
    df = docs.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_w", words(F.col("_t")))
    df = df.withColumns({"_s": without(F.col("_t"), BLANKS), "_n": F.size("_w"), "_d": F.size(F.array_distinct("_w"))})
    chars, n = F.length("_s"), F.col("_n")
    share = lambda a, b, most: F.least(a / b, F.lit(most))
    values = {
        "symbols": share(chars - F.length(without(F.col("_s"), "#*$%&|<>{}=~^")), chars, 0.2),
        "capitals": share(F.regexp_count("_s", F.lit(r"\p{Lu}")), chars, 0.4),
        "exclaimed": share(chars - F.length(without(F.col("_s"), "!")), n, 1.0),
        "variety": F.col("_d") / n,
        "length": F.log10(n.cast("double")),
        "variety_length": F.col("_d") / n * F.log10(n.cast("double")),
        "word_length": F.least(F.abs(chars / n - 5.2), F.lit(4.0)),
    }
    x = F.array(*[values[f].cast("double") for f in FEATURES])
    return df.withColumn("x", F.when(n > 0, x)).drop("_t", "_w", "_s", "_n", "_d")


def train(rows: np.ndarray, good: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> tuple[list[float], float, float]:
    """Weights, intercept (both for plain features) and base log-odds of a logistic regression, by Newton's method."""
    if not len(rows) or good.min() == good.max():
        return [0.0] * len(FEATURES), 0.0, 0.0
    mean, spread = rows.mean(0), np.maximum(rows.std(0), 1e-6)
    x = np.hstack([(rows - mean) / spread, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * len(rows) * 0.01 * np.eye(len(w)), x.T @ (p - good) + ridge * 0.01 * len(rows) * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    plain = w[:-1] / spread
    base = math.log(good.mean() / (1 - good.mean()))
    return plain.tolist(), float(w[-1] - plain @ mean), base


def trained(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float, float]:
    """Trains on the labelled documents with the smallest hashes; their features, MOST_LABELLED rows, go to the driver."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    sample = featured(docs.select("doc_id", "text").join(chosen, "doc_id")).where(F.col("x").isNotNull())
    pdf = sample.groupBy("doc_id").agg(F.max("x").alias("x"), F.max("good").alias("good")).orderBy("doc_id").toPandas()
    return train(np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(FEATURES)), pdf["good"].to_numpy(float))


def evidence(df: DataFrame, model: tuple[list[float], float, float]) -> DataFrame:
    """Adds own_odds, the log of how much likelier the text is for a good document than for a bad one; 0 without words."""
    weights, intercept, base = model
    z = F.lit(intercept - base)
    for i, w in enumerate(weights):
        z = z + F.lit(w) * F.col("x")[i]
    return df.withColumn("own_odds", F.when(F.col("x").isNotNull(), F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))).otherwise(0.0)).drop("x")


def chance(base: float) -> Column:
    """The probability of being good by own evidence and the base rate."""
    return 1 / (1 + F.exp(-(F.col("own_odds") + F.lit(base))))


def strength(mean: float, between: float, groups: int, n: float) -> float:
    """How many documents a prior counts as: the means' variance beyond what chance gives sets it (method of moments)."""
    spread = mean * (1 - mean)
    beyond = between - groups * spread / max(n, 1)
    return min(1e4, max(2.0, spread / beyond - 1)) if beyond > 1e-9 else 1e4


def sites(scored: DataFrame, base: float) -> tuple[DataFrame, dict[str, float]]:
    """One row for each (host, path) with the sums of both levels, and the numbers of the corpus's level."""
    paths = durable(scored.withColumn("p", chance(base)).groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum("p").alias("path_sum")))
    hosts = durable(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum")))
    n, total, count = hosts.agg(F.sum("host_n"), F.sum("host_sum"), F.count(F.lit(1))).first()
    mean = min(0.99, max(0.01, (total or 0) / n)) if n else 0.5
    joined = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    table = lookup(joined)
    off = lambda a, b: F.sum(F.col(f"{a}_n") * F.pow(F.col(f"{a}_sum") / F.col(f"{a}_n") - b, 2))
    among = hosts.agg(off("host", F.lit(mean))).first()[0] or 0.0
    within, parts = table.agg(off("path", F.col("host_sum") / F.col("host_n")), F.count(F.lit(1))).first()
    return table, {"mean": mean, "host": strength(mean, among / max(n or 0, 1), count, n or 0), "path": strength(mean, (within or 0) / max(n or 0, 1), parts, n or 0)}


def posterior(scored: DataFrame, table: DataFrame, corpus: dict[str, float], base: float) -> DataFrame:
    """Adds host_prior, path_prior (without the document's own part), posterior and kept. One broadcast join."""
    t = table.withColumnsRenamed({"host": "_h", "path": "_p"})
    df = scored.join(t, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left").drop("_h", "_p")
    df = df.withColumn("_own", chance(base))
    rest = lambda level, prior, k: (F.lit(k) * prior + F.col(f"{level}_sum") - F.col("_own")) / (F.lit(k) + F.col(f"{level}_n") - 1)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.02)), F.lit(0.98))
    df = df.withColumn("host_prior", clip(rest("host", F.lit(corpus["mean"]), corpus["host"])))
    df = df.withColumn("path_prior", clip(rest("path", F.col("host_prior"), corpus["path"])))
    odds = F.col("own_odds") + F.log(F.col("path_prior") / (1 - F.col("path_prior")))
    df = df.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return df.withColumn("kept", F.col("posterior") >= THRESHOLD).drop("_own", "host_n", "host_sum", "path_n", "path_sum")


#: What classify adds.
OUT = ("host", "path", "own_odds", "host_prior", "path_prior", "posterior", "kept")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns named in ``carry``, all by default) with OUT: host, path, own_odds, host_prior, path_prior,
    posterior and kept; a name that is carried gets further underscores, and docs' own column stays.

    Host and path default to the source and the language. A null or blank text has no evidence and follows its
    path; null hosts and paths are groups of their own; repeated rows count each, and rows with the same text and site are
    judged alike; without labels of both kinds all own odds are 0. A posterior at the threshold is kept. A text of any
    length is read whole, and texts are read once (besides the labelled sample) and never shuffled: what is carried, and
    the own odds beside it, is written once, which then gives the sums of all sites and each document's posterior. An empty
    table gives an empty result."""
    model = trained(docs, labels)
    columns = docs.columns if carry is None else carry
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("\x1f")).alias("row"), F.col("text").alias("text"), (F.col("source") if host is None else host).alias("host"), (F.col("lang") if path is None else path).alias("path"))
    scored = durable(evidence(featured(df), model).select("row", "host", "path", "own_odds"))
    table, corpus = sites(scored.select("host", "path", "own_odds"), model[2])
    judged = posterior(scored, table, corpus, model[2])
    kept = [F.col("row").getField(c).alias(c) for c in columns]
    return judged.select(F.struct(*kept, *[F.col(c).alias(n) for c, n in zip(OUT, fresh(columns, *OUT))]).alias("x")).select("x.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose posterior passes, with docs' own columns."""
    kept = fresh(docs.columns, *OUT)[-1]
    return classify(docs, labels).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
