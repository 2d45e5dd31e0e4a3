"""Token counts by overlap resynchronisation: huge texts are encoded in overlapping chunks, spread over tasks, and spliced.

A chunk's encoding is right but near its ends. Where the encodings of two neighbouring chunks have the same two tokens in
a row, at the same places, the text's own encoding has a border between them:

- If the first of the two ends a word of the pre-tokenizer in both (its id says so), both chunks begin a word at the same
  place, and words are found from left to right from there on, whatever came before.
- Else both chunks are within the same run of letters (or of signs). Byte-pair merges of lowest rank, and of those the
  leftmost, never cross a border between two tokens that they leave side by side when alone: the first merge across it
  would have been made in the two alone as well. So all neighbours of the spliced list, each seen in one of the chunks,
  stay as they are in the whole.

Chunks begin and end where no character composes with the one before, so normalising them is normalising the text, and
not within a special string, which is found before all else. Joints
without such a pair of tokens get overlaps of four times the width, and at last their chunks are made one.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lookup

#: Code points of a chunk; texts that have no more are encoded at once. Half of what two neighbours share at first.
CHUNK, WIDTH = 16_384, 64
#: Words whose counts a task remembers, and their greatest length.
REMEMBERED, SHORT = 500_000, 64
#: White space at which texts are cut before they are looked up; other white space is left to the library.
WORDS = re.compile(r"[^ \t\n\r]+")

_joining: set[str] = set()


def begins(c: str) -> bool:
    """Whether nothing before this character changes what it is normalised to, nor the other way round."""
    if c < "\u0300":
        return True
    if not _joining:
        pairs = (unicodedata.decomposition(chr(x)) for x in range(0x110000))
        _joining.update(chr(int(p.split()[1], 16)) for p in pairs if p and p[0] != "<" and " " in p)
        _joining.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _joining


class TokenCounter:
    """Counts and offsets by the tokenizers library. The tokenizer must drop white space before it merges."""

    def __init__(self, raw: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw)
        self.known: dict[str, int] = {}
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        apart = [i for w in ("ab", "'s", "c") for i in self.tokens(w)[0]]
        if self.tokens("ab \n's\tc")[0] != apart:
            raise ValueError("the tokenizer doesn't drop white space")

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.library.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def count(self, text: str) -> int:
        """Words between white space are encoded for themselves, and their counts remembered: no token reaches over."""
        words, known = WORDS.findall(text), self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in set(words) if w not in known]
        known.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False))))
        total = sum(map(known.__getitem__, words))
        for w in new:
            if len(w) > SHORT:
                del known[w]
        if len(known) > REMEMBERED:
            known.clear()
        return total

    def divides(self, text: str, i: int) -> bool:
        """Whether a text may be cut before its i-th character: normalised alike, and within no special string."""
        return i == 0 or i == len(text) or (begins(text[i]) and not any(text.find(s, max(0, i - len(s) + 1), i + len(s) - 1) >= 0 for s in self.specials))

    def borders(self, text: str, start: int, low: int, high: int) -> tuple[list[tuple[int, ...]], int]:
        """The borders between tokens of a chunk that begins at start, with both tokens within low to high, as (place of
        the second, the first's id and start, the second's id and end, index of the second); and the number of tokens."""
        ids, at = self.tokens(text)
        found = []
        for i in range(1, len(ids)):
            (a, b), (c, d) = at[i - 1], at[i]
            if b <= c and low <= a + start and d + start < high:
                found.append((c + start, ids[i - 1], a + start, ids[i], d + start, i))
        return found, len(ids)


def pieces(text: str, cuts: list[tuple[int, int]], chunk: int, divides: Callable[[str, int], bool]) -> list[tuple[int, int, int | None, int | None, int, int, int, int]]:
    """(start, end, cut before, cut after, width before, width after, end of the piece before, start of the next) of each
    overlapping piece, for cuts (place, width). Ends move outwards to where the text may be divided; a cut with no such
    place within half a chunk is left out."""
    n, joints = len(text), []
    for at, width in cuts:
        low, high = max(at - width, 0), min(at + width, n)
        least, most = max(at - chunk // 2, 0), min(at + chunk // 2, n)
        while not (here := divides(text, low)) and low > least:
            low -= 1
        while not (there := divides(text, high)) and high < most:
            high += 1
        if here and there:
            joints.append((at, width, low, high))
    before, after = [(None, 0, 0, 0), *joints], [*joints, (None, 0, n, n)]
    return [(a[2], b[3], a[0], b[0], a[1], b[1], a[3], b[2]) for a, b in zip(before, after)]


BORDER = "array<struct<place:int,before:int,from:int,after:int,until:int,more:int>>"
_FIELDS = ("place", "before", "from", "after", "until", "more")
_counters: dict[int, TokenCounter] = {}


def _counter(raw: str) -> TokenCounter:
    key = hash(raw)
    if key not in _counters:
        _counters[key] = TokenCounter(raw)
    return _counters[key]


def _spliced(texts: DataFrame, vocabulary, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (key, text, cuts): (key, n_tokens, failed) and (key, at, width, excess), excess being the tokens that two
    neighbouring pieces have beyond their splice, null where none is proven."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "before", "after", "width_before", "width_after", "low", "high", "piece"]
        kinds = [pa.string(), *[pa.int32()] * 7, pa.string()]
        divides = _counter(vocabulary.value).divides
        for batch in batches:
            for key, text, cuts in zip(*(batch.column(c) for c in ("key", "text", "cuts"))):
                text, out = text.as_py(), []
                for start, end, before, after, w0, w1, low, high in pieces(text, [(c["at"], c["width"]) for c in cuts.as_py()], chunk, divides):
                    out.append((key.as_py(), start, before, after, w0, w1, low, high, text[start:end]))
                for k in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 64]), kinds)], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                end = r["start"] + len(r["piece"])
                found, n = counter.borders(r["piece"], r["start"], r["start"], end + (r["after"] is None))
                head = [b for b in found if b[4] < r["low"]] if r["before"] is not None else []
                tail = [(*b[:5], n - b[5]) for b in found if b[2] >= r["high"]] if r["after"] is not None else []
                rows.append((r["key"], r["before"], r["after"], r["width_after"], n, *([dict(zip(_FIELDS, b)) for b in x] for x in (head, tail))))
            border = pa.list_(pa.struct([(f, pa.int32()) for f in _FIELDS]))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), border, border]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["key", "before", "after", "width", "n", "head", "tail"])

    cuts = texts.mapInArrow(cut, "key string, start int, before int, after int, width_before int, width_after int, low int, high int, piece string")
    # copies of a text are one; pieces of a text go to different tasks
    spread = cuts.dropDuplicates(["key", "start"])
    found = durable(spread.mapInArrow(encode, f"key string, before int, after int, width int, n bigint, head {BORDER}, tail {BORDER}"))
    a = found.where("after is not null").select("key", F.col("after").alias("at"), "width", "tail")
    b = found.where("before is not null").select("key", F.col("before").alias("at"), "head")
    bare = lambda c: F.transform(c, lambda x: x.dropFields("more"))
    common = F.array_intersect(bare(F.col("tail")), bare(F.col("head")))
    chosen = F.get(F.array_sort(common), F.floor(F.size(common) / 2).cast("int"))
    more = lambda c: F.get(F.filter(c, lambda x: x["place"] == F.col("chosen.place")), F.lit(0))["more"]
    joints = a.join(b, ["key", "at"]).withColumn("chosen", chosen).select("key", "at", "width", (more("tail") + more("head")).alias("excess"))
    parts = found.select("key", "n", F.lit(0).alias("failed")).unionByName(joints.select("key", (-F.coalesce("excess", F.lit(0))).cast("long").alias("n"), F.col("excess").isNull().cast("int").alias("failed")))
    return parts.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.sum("failed").alias("failed")), joints


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row, as the tokenizers library gives them without special tokens around.

    Texts of at most ``chunk`` code points are encoded where they are read. Longer ones go, chunk by chunk, to any task;
    what returns are the borders of tokens in the overlaps. Joints that find no common pair of tokens are widened, in
    rounds whose number depends on chunk and width only (a text that never aligns is one piece in the end, and held by
    one task, which it was as a row). A null text counts as empty; repeated rows are counted each, and equal long texts
    encoded once; ties don't arise; an empty table gives an empty result; other columns are not read. The vocabulary is read on the
    driver and broadcast (1.6 MB)."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "n": F.length("text")})
    kind = rows.schema["id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    at_once = rows.where(F.col("n") <= chunk).select("id", "text", "n_bytes").mapInArrow(short, f"id {kind}, n_bytes bigint, n_tokens bigint")
    long = rows.where(F.col("n") > chunk).withColumn("key", F.sha2("text", 256))
    first = F.transform(F.sequence(F.lit(chunk), F.col("n") - 1, F.lit(chunk)), lambda x: F.struct(x.alias("at"), F.lit(width).alias("width")))
    texts, totals = long.select("key", "text", first.alias("cuts")), None
    while True:
        counts, joints = _spliced(texts, shared, chunk)
        counts = durable(counts)
        done = counts.where("failed = 0").select("key", "n_tokens")
        totals = done if totals is None else totals.unionByName(done)
        left = counts.where("failed > 0").select("key")
        if left.isEmpty():
            break
        wider = F.when(F.col("excess").isNull(), 4 * F.col("width")).otherwise(F.col("width"))
        again = joints.join(left, "key", "left_semi").select("key", "at", wider.alias("width"))
        # a cut whose overlap would reach those of its neighbours goes: its chunks become one
        cuts = again.groupBy("key").agg(F.array_sort(F.collect_list(F.when(4 * F.col("width") <= chunk, F.struct("at", "width")))).alias("cuts"))
        texts = long.select("key", "text").join(durable(cuts), "key")
    counted = long.select("id", "n_bytes", "key").join(lookup(totals), "key").select("id", "n_bytes", "n_tokens")
    return at_once.unionByName(counted).withColumnRenamed("id", id_col)
