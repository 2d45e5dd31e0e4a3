"""Keyword rules: many patterns in every text, and what the matches add up to."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import batches as batches_of

@dataclass(frozen=True)
class Entry:
    """A watched ticker: what names it, and the sector and macro keywords it is tied to."""

    market: str
    ticker: str
    name: str
    aliases: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    macros: tuple[str, ...] = ()


@dataclass(frozen=True)
class Watchlist:
    entries: tuple[Entry, ...]
    sectors: dict[str, tuple[str, ...]] = field(default_factory=dict)
    macros: dict[str, tuple[str, ...]] = field(default_factory=dict)
    generics: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def patterns(self) -> list[tuple[str, bool, str, str, str]]:
        """(lower-case text, ascii, kind, market, owner) of all keywords, blank ones left out."""
        out = []
        for e in self.entries:
            out += [(e.ticker, "ticker", e.market, e.ticker), (e.name, "name", e.market, e.ticker), *((a, "alias", e.market, e.ticker) for a in e.aliases)]
        for kind, sets in (("sector", self.sectors), ("macro", self.macros), ("generic", self.generics)):
            out += [(k, kind, market, k) for market, words in sets.items() for k in words]
        return [(t.lower(), t.isascii(), kind, market, owner) for t, kind, market, owner in out if t]

    def tied(self) -> list[tuple[str, str, str]]:
        """(kind, lower-case keyword, ticker): which tickers a sector or macro keyword stands for, in any market."""
        return sorted({(kind, k.lower(), e.ticker) for e in self.entries for kind, ks in (("sector", e.sectors), ("macro", e.macros)) for k in ks})


#: Bytes of a part of the automaton, as it is sent to each executor. Larger sets of patterns are cut into several.
PART_BYTES = 64 << 20
#: Bytes of text that are matched at a time.
TEXT_BYTES = 1 << 20
Pattern = tuple[str, bool, str, str, str]


@dataclass(frozen=True)
class Compiled:
    """A version of the patterns: broadcast automata, of which each has some of the patterns, and the codes' meanings.

    Plans hold the broadcasts' numbers only, so they are alike for any patterns; a changed list is another version."""

    version: str
    parts: tuple[Broadcast, ...]
    meanings: Broadcast
    patterns: tuple[Pattern, ...]
    tied: tuple[tuple[str, str, str], ...]


def _automaton(patterns: list[tuple[int, str, bool]]) -> bytes:
    import ahocorasick

    found, by_text = ahocorasick.Automaton(), {}
    for code, text, ascii_ in patterns:
        by_text.setdefault(text, []).append((code, ascii_))
    for text, codes in by_text.items():
        found.add_word(text, (len(text), codes))
    found.make_automaton()
    return pickle.dumps(found)


_versions: dict[tuple[str, str, int], Compiled] = {}
_loaded: dict[tuple[str, int, int], object] = {}


def compiled(spark: SparkSession, patterns: list[Pattern], tied: list[tuple[str, str, str]] = (), most: int = PART_BYTES) -> Compiled:
    """The current version of these patterns (lower-case text, ascii, kind, market, owner); the same again if they are
    the same. No part is larger than ``most`` bytes, but for one of a single text."""
    version = hashlib.sha256(repr((patterns, tied)).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, version, most)
    if key not in _versions:
        texts = sorted({p[0] for p in patterns})
        n = max(1, sum(map(len, texts)) * 40 // most)
        while True:
            place = {t: i % n for i, t in enumerate(texts)}
            parts = [_automaton([(c, p[0], p[1]) for c, p in enumerate(patterns) if place[p[0]] == k]) for k in range(n)]
            if n >= len(texts) or max(map(len, parts)) <= most:
                break
            n = min(len(texts), 2 * n)
        send = spark.sparkContext.broadcast
        meanings = ([p[2:] for p in patterns], {})
        for kind, word, ticker in tied:
            meanings[1].setdefault((kind, word), []).append(ticker)
        _versions[key] = Compiled(version, tuple(map(send, parts)), send(meanings), tuple(patterns), tuple(tied))
    return _versions[key]


def _hits(version: str, part: int, parts: int, sent: Broadcast) -> Callable[[str | None], list[tuple[int, int, int]]]:
    """A function that finds a text's matches; each worker unpacks a version's automaton once, and keeps few."""
    key = (version, part, parts)
    if (found := _loaded.get(key)) is None:
        if len(_loaded) >= 2:
            _loaded.clear()
        found = _loaded[key] = pickle.loads(sent.value)
    word = lambda c: c.isascii() and c.isalnum()

    def one(text: str | None) -> list[tuple[int, int, int]]:
        low, out = (text or "").lower(), []
        for end, (size, codes) in found.iter(low) if len(found) else ():
            start = end - size + 1
            inside = (start > 0 and word(low[start - 1])) or (end + 1 < len(low) and word(low[end + 1]))
            out += [(c, start, end) for c, ascii_ in codes if not (inside and ascii_)]
        return out

    return one


MATCH = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("pattern", "start", "end")]))


def find_all(patterns: Compiled, part: int = 0) -> Callable[[Column], Column]:
    """A function of a text column: all occurrences of a part's patterns, overlapping ones too, by end; ends are inclusive.

    ASCII patterns count only between characters that are no ASCII letters or digits. A text is read once however many
    patterns there are."""
    version, sent, parts = patterns.version, patterns.parts[part], len(patterns.parts)

    @F.pandas_udf(MATCH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _hits(version, part, parts, sent)
        for texts in batches:
            yield texts.map(one)

    return run


VERDICT = T.StructType([T.StructField("matched", T.BooleanType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("tickers", "related_tickers", "sectors", "macros", "generic_hits", "markets"))])


def _verdicts_of(patterns: Compiled) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, article_market, text): what all of a text's matches add up to, where one automaton has all
    patterns. Texts leave Arrow a megabyte at a time."""
    version, sent, meanings = patterns.version, patterns.parts[0], patterns.meanings
    kinds = [to_arrow_type(f.dataType) for f in VERDICT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, (infos, tied) = _hits(version, 0, 1, sent), meanings.value

        def fold(text: str | None) -> tuple:
            hits = [infos[code] for code, _, _ in one(text)]
            of = lambda *kinds: sorted({owner for kind, _, owner in hits if kind in kinds})
            tickers, sectors, macros = of("ticker", "name", "alias"), of("sector"), of("macro")
            related = {t for kind, words in (("sector", sectors), ("macro", macros)) for w in words for t in tied.get((kind, w.lower()), ())}
            return bool(hits), tickers, sorted(related - set(tickers)), sectors, macros, [o for k, _, o in hits if k == "generic"], sorted({m for _, m, _ in hits})

        for batch in batches:
            for a, b in batches_of.ranges(batches_of.bounds(batch.column("text")), TEXT_BYTES):
                part = batch.slice(a, b - a)
                folded = zip(*(fold(t.as_py()) for t in part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("article_market"), *map(pa.array, folded, kinds)], ["id", "article_market", *VERDICT.names])

    return run


def _folded(texts: DataFrame, patterns: Compiled) -> DataFrame:
    """texts (id, article_market, text) with their verdicts for the text. As a table's operator, not a column's function,
    it runs once, however many of its columns are selected and filtered by."""
    kinds = T.StructType([texts.schema["id"], texts.schema["article_market"], *VERDICT])
    return texts.select("id", "article_market", "text").mapInArrow(_verdicts_of(patterns), kinds)


def _gathered(texts: DataFrame, patterns: Compiled) -> DataFrame:
    """id and verdict of texts (id, text) by one pass for each part, so that a worker holds one part at a time; the matches
    meet by id, and get their meanings by joins."""
    spark = texts.sparkSession
    found = [texts.select("id", F.explode(find_all(patterns, k)("text")).alias("m")).select("id", "m.*") for k in range(len(patterns.parts))]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    codes = spark.createDataFrame([(i, *p[2:]) for i, p in enumerate(patterns.patterns)], "pattern int, kind string, hit_market string, owner string")
    tied = spark.createDataFrame(list(patterns.tied), "kind string, word string, tied string")
    meant = hits.join(codes, "pattern").withColumn("word", F.lower("owner")).join(tied.groupBy("kind", "word").agg(F.collect_set("tied").alias("tied")), ["kind", "word"], "left")
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("owner"))))
    generic = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "generic", F.struct("end", "start", "pattern", "owner")))), lambda x: x["owner"])
    folded = meant.groupBy("id").agg(of("ticker", "name", "alias").alias("tickers"), of("sector").alias("sectors"), of("macro").alias("macros"), generic.alias("generic_hits"), F.array_sort(F.collect_set("hit_market")).alias("markets"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind").isin("sector", "macro"), F.col("tied"))))).alias("near"))
    folded = folded.withColumn("related_tickers", F.array_except(F.array_sort("near"), F.col("tickers")))
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return texts.select("id").join(folded, "id", "left").select("id", F.struct(F.col("tickers").isNotNull().alias("matched"), *map(none, VERDICT.names[1:])).alias("v"))


def verdicts(articles: DataFrame, watch: Watchlist, most: int = PART_BYTES) -> DataFrame:
    """id, matched, tickers, related_tickers, sectors, macros, generic_hits, markets, score_boost of every article.

    Where one automaton has all patterns, matches are folded within the row: no shuffle. Ids must be unique otherwise."""
    patterns = compiled(articles.sparkSession, watch.patterns(), watch.tied(), most)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("  "), F.coalesce("body", F.lit("")))
    texts = articles.select("id", F.col("market").alias("article_market"), text.alias("text"))
    if len(patterns.parts) == 1:
        df = _folded(texts, patterns)
    else:
        df = texts.select("id", "article_market").join(_gathered(texts.select("id", "text"), patterns), "id").select("id", "article_market", "v.*")
    some = lambda c, n: F.when(F.size(c) > 0, n).otherwise(0)
    boost = F.least(F.lit(100), some("tickers", 50) + some("sectors", 20) + some("macros", 15)).cast("double")
    return df.withColumn("score_boost", boost)


def importance(df: DataFrame) -> Column:
    """The weighted rules that an enriched article meets, as an array of (rule, weight)."""
    rules = [
        (F.col("first_party"), "first_party_source", 30),
        ((F.col("magnitude") == "high") & F.col("sentiment").isin("bullish", "bearish"), "high_magnitude", 40),
        (F.col("event_type").isin("earnings", "m_and_a", "downgrade", "upgrade"), "key_event", 20),
        (F.col("event_type") == "filing", "filing", 25),
    ]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(w).alias("weight"))) for c, n, w in rules]), lambda x: x.isNotNull())


def decision(score: Column, low: float = 40, high: float = 70) -> Column:
    """critical from high on, not below low, gray between."""
    return F.when(score >= high, "critical").when(score < low, "not_critical").otherwise("gray")
