"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch of a measure is a histogram over integer bins whose width grows with the value (a 32nd of it at most), so that
its quantiles have a bounded relative error. Sketches merge by adding counts: those of all sources of a language give the
language's, and those the whole corpus's. A group's limits are fences around its quartiles; a group of few documents
takes those of its language, or else the corpus's. The limits are joined to the documents, which are then judged.
Everything is DataFrame operations; the text is read once, and what is shuffled are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, durable, lookup, without, words

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

#: Measures in integers; the fences lie FENCE interquartile ranges outside the quartiles, and at least this far. Those of
#: the first kind have an upper fence only.
MEASURES = {"symbol_permille": 20, "dup_line_permille": 350, "repeat_permille": 200, "word_length_percent": 120}
BOTH_SIDES = ("word_length_percent",)
FENCE = 5
#: Documents with which a group has limits of its own.
LEAST_DOCS = 100


def repeated_words(w: Column) -> Column:
    """Words of an array in windows of 8 that occur twice or more in it.

    Windows are named by 64-bit hashes. Only where two windows agree are they sorted, the repeated ones picked by their
    neighbours, and the words under them counted, overlaps once."""

    def twice(s: Column) -> Column:
        same = lambda k, other: F.coalesce(s[k]["x"] == F.get(s, other)["x"], F.lit(False))
        picked = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), s[k]["i"]))
        return F.sort_array(F.filter(picked, lambda p: p.isNotNull()))

    def under(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        found = F.transform(F.array(ordered), twice)[0]
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), F.aggregate(found, start, step, lambda a: a["n"])).otherwise(F.lit(0).cast("long"))

    # an array of one element binds what is used more than once
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    def windows(h: Column) -> Column:
        begins = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(begins, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    h = bound(F.transform(w, lambda x: F.xxhash64(x)), windows)
    return bound(h, under)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts of each text, and the measures that the limits are for."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*keep, text.alias("_t"))
    df = df.withColumn("_w", words(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    permille = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return df.withColumns({
        "symbol_permille": permille("n_symbols", "word_chars"),
        "dup_line_permille": permille("n_dup_lines", "n_lines"),
        "repeat_permille": permille("n_repeat_words", "n_words"),
        "word_length_percent": F.expr("100 * word_chars div greatest(n_words, 1)"),
    })


def bin_of(v: Column) -> Column:
    """The lower edge of the bin of an integer: its six leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(df: DataFrame, groups: list[str]) -> DataFrame:
    """groups, measure, edge, n: one histogram for each group and measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("edge")) for m in MEASURES])
    return df.select(*groups, F.inline(pairs)).groupBy(*groups, "measure", "edge").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Histograms of coarser groups, by adding."""
    return sketch.groupBy(*groups, "measure", "edge").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, groups: list[str], prefix: str) -> DataFrame:
    """One row for each group: its documents, and the low and high fence of each measure."""
    w = Window.partitionBy(*groups, "measure")
    df = sketch.withColumn("upto", F.sum("n").over(w.orderBy("edge"))).withColumn("total", F.sum("n").over(w))
    quarter = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("edge")))
    df = df.groupBy(*groups, "measure").agg(F.max("total").alias("docs"), quarter(1).alias("q1"), quarter(3).alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for p in MEASURES.items() for x in p]), F.col("measure"))
    margin = F.greatest(FENCE * (F.col("q3") - F.col("q1")), least)
    df = df.withColumn("low", F.col("q1") - margin).withColumn("high", F.col("q3") + margin)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    columns = [of(m, c).alias(f"{prefix}_{c}_{m}") for m in MEASURES for c in ("low", "high")]
    return df.groupBy(*groups).agg(F.max("docs").alias(f"{prefix}_docs"), *columns)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text, lang, source): the base counts, base_failed, the limits that hold for its
    group, and kept.

    A null text has no words and fails the base rules. Null languages and sources are groups of their own. Repeated
    rows count each; other columns are not read; an empty table gives an empty result. Documents that fail the base rules
    are not part of the sketches."""
    df = durable(measure(docs, ["doc_id", "lang", "source"]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    fine = durable(sketches(df.where(~F.col("base_failed")), ["lang", "source"]))
    own = limits(fine, ["lang", "source"], "own")
    lang = limits(merged(fine, ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "_l")
    every = limits(merged(fine.withColumn("_e", F.lit(0)), ["_e"]), ["_e"], "every").withColumnRenamed("_e", "_f")
    table = own.join(lang, F.col("lang").eqNullSafe(F.col("_l"))).join(every, F.col("_f") == F.lit(0))
    pick = lambda c: F.when(F.col("own_docs") >= LEAST_DOCS, F.col(f"own_{c}")).when(F.col("lang_docs") >= LEAST_DOCS, F.col(f"lang_{c}")).otherwise(F.col(f"every_{c}"))
    table = lookup(table.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[pick(f"{c}_{m}").alias(f"{c}_{m}") for m in MEASURES for c in ("low", "high")]))
    df = df.join(table, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    out = [F.col(m) > F.col(f"high_{m}") for m in MEASURES] + [F.col(m) < F.col(f"low_{m}") for m in BOTH_SIDES]
    outside = out[0]
    for x in out[1:]:
        outside = outside | x
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False)))
