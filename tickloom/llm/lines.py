"""Line dedup: a suffix array over the sequences of line ids, by prefix doubling, and its repeated runs.

A document is the sequence of the ids of its lines that have words; a suffix of it begins at each line. Suffixes are
sorted by their first line, and in each round by twice as many lines: the pair of ranks of a suffix and of the one 2^k
lines on is sorted, which gives the ranks by 2^(k+1) lines. A suffix whose rank is its own is in its final place and
leaves; rounds go on until no rank repeats. Suffixes of one rank are an interval with a longest common prefix of at
least so many lines, in order of their places: all but the first of them repeat an earlier run.

A line goes if it lies in a maximal repeated run, the longest prefix that a suffix shares with an earlier one, of MIN_WORDS words
or more. Such runs need not be measured line by line. A line, or a gap between lines, lies in one exactly if it lies in the
least window from some line on, or in the least window of two lines or more up to some line, that has the words and repeats
an earlier one: if the run up to the line has the words, it holds the window that ends there, and otherwise it holds
the window from its first line on, which goes further. A window of n lines is named by the ranks of its first and its last
2^k <= n lines, so it is sorted along with the pairs of its round.

Every sort has the place in its key, so a line that a third of all documents share is spread over tasks like any other; no
row is joined to a common line's. Line ids are 128 bits of SHA-256, so lines are equal where ids are, also by design.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, fresh
from .order import ranked

#: Words that a repeated run must have to be deleted.
MIN_WORDS = 10


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, tag (a hash of the text), seq, id, least: the lines with words of each document.

    least has a bit for each number of lines from here on that is a least window: with min_words words, and without them
    if its last line were left out, or its first; one of two lines is also least up to its last."""
    text = F.coalesce("text", F.lit(""))
    id_of = lambda x: F.substring(F.unhex(F.sha2(x.cast("binary"), 256)), 1, 16)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0)
    lines = F.transform(lines, lambda x: F.struct(id_of(x["x"]).alias("id"), x["n"].alias("n")))

    def least(first: Column, i: Column) -> Column:
        def more(a: Column, x: Column) -> Column:
            words, n = a["words"] + x["n"], a["n"] + 1
            hit = (words >= min_words) & ((a["words"] < min_words) | (n == 2) | ((n > 2) & (words - first["n"] < min_words)))
            return F.struct(words.alias("words"), n.alias("n"), F.when(hit, a["bits"] + F.pow(F.lit(2), n).cast("int")).otherwise(a["bits"]).alias("bits"))

        start = F.struct(*[F.lit(0).alias(c) for c in ("words", "n", "bits")])
        return F.aggregate(F.slice("rows", i + 1, max(2, min_words)), start, more, lambda a: a["bits"])

    df = docs.select("doc_id", F.xxhash64(text).alias("tag"), lines.alias("rows"))
    each = F.transform("rows", lambda x, i: F.struct(i.alias("seq"), x["id"].alias("id"), least(x, i).alias("least")))
    return df.select("doc_id", "tag", F.inline(each))


def suffix_ranks(docs: DataFrame, min_words: int) -> list[DataFrame]:
    """For each round, its sorted rows: doc_id, tag, seq, window, lines, rank, first, many.

    Rows that are no windows are suffixes by their first 2^k lines."""
    place = ["doc_id", "tag", "seq"]
    # rows that share id and text are one document
    rows = sequences(docs, min_words).distinct().withColumns({"window": F.lit(False), "lines": F.lit(1)})
    rounds, length = [ranked(rows, ["id"], place).drop("id")], 1
    while True:
        alive = rounds[-1].where(F.col("many") & ~F.col("window"))
        if alive.isEmpty():
            return rounds
        line = Window.partitionBy("doc_id", "tag").orderBy("seq")
        at = lambda d: F.first("rank").over(line.rangeBetween(d, d)) if d else F.col("rank")

        def pair(window: bool, lines: int) -> Column:
            least = F.lit(None).cast("int") if window else F.col("least")
            return F.struct(F.lit(window).alias("window"), F.lit(lines).alias("lines"), F.col("rank").alias("a"), at(lines - length).alias("b"), least.alias("least"))

        found = [pair(False, 2 * length)]
        for n in range(length, min(2 * length - 1, max(2, min_words)) + 1):
            found.append(F.when(F.col("least").bitwiseAND(F.lit(1 << n)) != 0, pair(True, n)))
        rows = alive.select(*place, F.array(*found).alias("found")).select(*place, F.explode("found").alias("x")).where("x.b is not null").select(*place, "x.*")
        rounds.append(ranked(rows, ["window", "lines", "a", "b"], place).drop("a", "b"))
        length *= 2


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag, spans (ordered (from, to), numbers of lines among those with words: the maximal repeated runs with
    the words, those that overlap as one), longest (lines of the longest run, whatever its words, rounded down to a
    power of two), of the documents that repeat any line.

    Earlier is by doc_id (null first), then tag, then place."""
    later = reduce(DataFrame.unionByName, [r.where(~F.col("first")).select("doc_id", "tag", "seq", "window", "lines") for r in suffix_ranks(docs, min_words)])
    later = later.withColumn("to", F.when(F.col("window"), F.col("seq") + F.col("lines") - 1))
    w = Window.partitionBy("doc_id", "tag").orderBy(F.col("to").isNull(), "seq", "to")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("seq") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = later.groupBy("doc_id", "tag", F.when(F.col("to").isNotNull(), F.col("run")).alias("run")).agg(F.min("seq").alias("from"), F.max("to").alias("to"), F.max(F.when(~F.col("window"), F.col("lines"))).alias("longest"))
    spans = F.sort_array(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("from", "to"))))
    return runs.groupBy("doc_id", "tag").agg(spans.alias("spans"), F.max("longest").alias("longest"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less its repeated runs, and _lines, _removed (numbers of lines), _runs (of deleted stretches of
    lines) and _longest (see repeated_runs); a name that docs has gets further underscores, and docs' own column stays.

    Lines are what ``\\n`` separates; blank lines are no part of a sequence and stay, unless they lie within a deleted
    run. A null text stays null. Rows that share id and text are one document, so neither is the other's copy; a null
    doc_id counts before all others. Lines of fewer than min_words words go only as part of a run that has them. A text
    of any length is one row, and its lines are one task's. An empty table gives an empty result; other columns are
    carried along."""
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias("id"), "tag", "spans", "longest")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    df = packed.join(runs, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("tag")), "left")
    lines = F.split("row.text", "\n")
    df = df.select("row", "longest", lines.alias("lines"), F.when(F.size("spans") > 0, F.col("spans")).alias("spans"))
    # numbers of the lines with words, then the spans as numbers of lines, then what lies between them
    worded = F.filter(F.transform("lines", lambda x, i: F.when(F.translate(x, BLANKS, "") != "", i)), lambda i: i.isNotNull())
    df = df.withColumn("worded", F.when(F.col("spans").isNotNull(), worded))
    df = df.withColumn("gone", F.transform("spans", lambda s: F.struct(F.get("worded", s["from"]).alias("from"), F.get("worded", s["to"]).alias("to"))))
    gaps = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", begin(k), F.coalesce(F.get("gone", k)["from"], F.size("lines")) - begin(k) + 1))
    removed = F.aggregate("gone", F.lit(0), lambda n, s: n + s["to"] - s["from"] + 1)
    stretches = F.size(F.filter("gone", lambda s, i: (i == 0) | (s["from"] != F.get("gone", i - 1)["to"] + 1)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    counts = [F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(removed, F.lit(0)), F.when(F.col("gone").isNull(), 0).otherwise(stretches), F.coalesce("longest", F.lit(0))]
    names = fresh(docs.columns, "_lines", "_removed", "_runs", "_longest")
    new = F.struct(text.alias("text"), *[F.when(F.col("row.text").isNull(), 0).otherwise(c).alias(n) for c, n in zip(counts, names)])
    # a generator is computed once: a filter on its output isn't pushed below it, where it would repeat all of the above
    df = df.select("row", F.explode(F.array(new)).alias("new"))
    kept = [F.col("new.text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return df.select(*kept, *[F.col(f"new.{n}") for n in names])


def begin(k: Column) -> Column:
    """The first line (from 1) of what follows the deleted stretch before number k."""
    return F.coalesce(F.get("gone", k - 1)["to"], F.lit(-1)) + 2


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs less their repeated runs, n_chars counted anew; documents of which no word is left are dropped."""
    removed = fresh(docs.columns, "_lines", "_removed")[1]
    df = deduplicated(docs, min_words)
    df = df.where((F.col(removed) == 0) | (F.translate("text", BLANKS, "") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
