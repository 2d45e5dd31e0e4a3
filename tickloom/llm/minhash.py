"""MinHash near-dedup with HyperMinHash sketches.

A document's set of word shingles is hashed once; the leading bits of a hash choose one of 256 registers, which
keeps the smallest remainder in compressed form: its number of leading zeros and the ten bits after them. Bands of six
registers propose candidates, the share of agreeing registers, less what chance collisions explain, estimates their
similarity, and what may reach the threshold is compared on the full sets.

Documents with equal sets count as one from the start. Candidates are first each member of a band's bucket with
the smallest member. Members that the links so found connect need no further comparison among each other; what
remains are buckets whose members are still in different components, and there all pairs across components are
estimated, in blocks of bounded size, until no link is missing. So a group of thousands of near copies costs a few
comparisons for each member, and no bucket is cut off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import components
from .shingles import mix, shingle_sets

REGISTERS, MANTISSA, ROWS = 256, 10, 6
BANDS = REGISTERS // ROWS
EMPTY = np.uint16(65535)
#: Standard deviations of the estimate by which a pair may fall short before the full sets decide.
SLACK = 6.0
#: Partners of each member that are compared first in an unresolved bucket; if any has more, all others follow.
NEAREST = 16
#: Texts that a task hashes at once.
STEP_ROWS = 512
#: Members of an unresolved bucket that are compared with each other in one group; larger buckets are split in blocks.
BLOCK = 2048
#: Rows of buckets that a task compares, about, until there are so many tasks.
TASK_ROWS, MOST_TASKS = 1_000, 20_000
#: Pairs that a task has found before it looks which of them it keeps.
HELD_PAIRS = 200_000
#: Ids up to which a set of chosen documents is broadcast as a filter of the scan (counted first); else it is joined.
FILTER_IDS = 300_000


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(found):
        place = (found >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        rest = found[first] << np.uint64(8)
        zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62).astype(np.uint64)
        bits = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[place[first]] = ((zeros << np.uint64(MANTISSA)) | bits).astype(np.uint16)
    return out


_BAND = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For each register the order in which it looks at the others if it is empty.
_ORDER = np.random.Generator(np.random.PCG64(11)).permuted(np.tile(np.arange(REGISTERS, dtype=np.uint8), (REGISTERS, 1)), axis=1)


def densified(sketches: np.ndarray) -> np.ndarray:
    """Sketches as 64-bit registers whose empty ones borrow from the first filled register in an order of their own.

    So a band of a small set says as much as one of a large set: with empty registers left empty, one common
    shingle would make a bucket. Registers of two sets still agree with the probability of their similarity."""
    out = sketches.astype(np.uint64)
    for i in np.flatnonzero((sketches == EMPTY).any(axis=1)):
        filled, empty = np.flatnonzero(sketches[i] != EMPTY), np.flatnonzero(sketches[i] == EMPTY)
        if len(filled):
            source = filled[_ORDER[empty[:, None], filled[None, :]].argmin(axis=1)]
            out[i, empty] = out[i, source] + (source.astype(np.uint64) + np.uint64(1)) * np.uint64(1 << 16)
    return out


def band_keys(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each sketch and band, and whether the band has anything in it."""
    rows = densified(sketches)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    keys = mix((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :])
    return keys.view(np.int64), np.broadcast_to((sketches != EMPTY).any(axis=1)[:, None], keys.shape)


@lru_cache(maxsize=4096)
def _by_chance(a: float, b: float) -> float:
    """The chance that the registers of two unrelated sets agree, given the mean number of hashes in each's registers."""
    zeros = np.arange(0, 24)[:, None]
    step = 2.0 ** -(zeros + 1 + MANTISSA)
    low = 2.0 ** -(zeros + 1.0) + step * np.arange(1 << MANTISSA)[None, :]
    hit = lambda load: np.exp(-load * low) - np.exp(-load * (low + step))
    filled = max(1e-9, 1 - np.exp(-(a + b)))
    return float((hit(a) * hit(b)).sum() / filled)


def chances(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The same for paired set sizes, to the nearest quarter of a power of two."""
    grid = lambda n: np.rint(4 * np.log2(np.maximum(n, 1) / REGISTERS)).astype(np.int64)
    both, at = np.unique(grid(n1) * 4096 + grid(n2), return_inverse=True)
    value = lambda g: round(2 ** (g / 4), 4)
    split = [((x + 2048) // 4096, (x + 2048) % 4096 - 2048) for x in both.tolist()]
    return np.array([_by_chance(value(a), value(b)) for a, b in split])[at]


def may_reach(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray, chance: float | np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sketches of pairs leave the threshold possible.

    Where registers differ, so do the sets: at the threshold they differ in so many hashes at most as their sizes say.
    This bound is strict, and sharp for small sets; for large ones the estimate, corrected for collisions, decides. What
    the sizes alone rule out is out."""
    agree = ((a == b) & (a != EMPTY)).sum(axis=-1)
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    differ = filled - agree <= (n1 + n2) * (1 - threshold) / (1 + threshold) + 1e-9
    share = agree / np.maximum(filled, 1)
    estimate = (share - chance) / (1 - chance)
    slack = SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1)) + 1e-9
    return differ & (estimate >= threshold - slack) & (np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (of the set, null if empty), sketch of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(s, STEP_ROWS)
                n, prints, sketches = [], [], []
                for found in shingle_sets([t.encode() for t in batch.column("text").to_pylist()]):
                    n.append(len(found))
                    prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sketches.append(registers(found).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "fingerprint", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, fingerprint binary, sketch binary")


def buckets(sets: DataFrame) -> DataFrame:
    """id, n_shingles, key: a row for each set and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, full = band_keys(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            row, band = np.nonzero(full)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("n_shingles").take(at), pa.array(keys[row, band])], ["id", "n_shingles", "key"])

    return sets.select("id", "n_shingles", "sketch").mapInArrow(run, "id bigint, n_shingles bigint, key bigint")


def chosen(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among ids (one column, ``key``, distinct)."""
    kept = durable(ids)
    return df.join(F.broadcast(kept) if kept.count() <= FILTER_IDS else kept, key, "left_semi")


def estimated(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their sketches."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("na", "nb") >= int(100 * threshold) * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(may_reach(sa, sb, na, nb, chances(na, nb), threshold)))

    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = chosen(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids, "doc_id")
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last: tuple[str | None, np.ndarray | None] = (None, None)
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                for left, text in zip(shingle_sets([t.encode() for t in part.column("ta").to_pylist()]), part.column("tb").to_pylist()):
                    if text != last[0]:
                        last = (text, next(shingle_sets([text.encode()])))
                    both = len(np.intersect1d(left, last[1], assume_unique=True))
                    keep.append(100 * both >= percent * (len(left) + len(last[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint")


def across(members: DataFrame, threshold: float, most: int | None, tasks: int) -> DataFrame:
    """Distinct pairs (a, b) of different components within a bucket that may reach the threshold.

    A pair that shares several buckets comes from its first shared band only. With ``most``, only so many of each member,
    the most similar by estimate, and a row of nulls where that left some out: links of these join most components, which
    leaves few pairs for a call without. members: key, id, component, n_shingles, sketch, blocks (into how many the
    bucket is split). A group is a bucket, or two blocks of one; groups lie sorted in their partition, and a task works on
    as many at once as an Arrow batch holds. The number of tasks is given, as rows are few bytes and much work, so that
    sizes in bytes would put too many into one."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int")
    # a pair of blocks (i, j), i <= j, meets in one group
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    rows = members.withColumn("own", own).select("key", "own", "id", "component", "n_shingles", "sketch", F.inline(pairs))
    rows = rows.select(F.xxhash64("key", "i", "j").alias("group"), "key", F.when(F.col("i") != F.col("j"), F.col("own")).alias("own"), "id", "component", "n_shingles", "sketch")
    rows = rows.repartition(tasks, "group").sortWithinPartitions("group", "n_shingles")

    def compare(t: pa.Table) -> pa.RecordBatch:
        group, n, ids, component, key = (t.column(c).to_numpy() for c in ("group", "n_shingles", "id", "component", "key"))
        own = t.column("own").fill_null(-1).to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        found, left, gap, size, dropped = [np.empty((0, 3), np.int64)], np.arange(len(group)), 0, 0, False

        def merged() -> tuple[np.ndarray, bool]:
            """The distinct pairs found; with ``most``, those among the most similar ones of either end, and whether that
            leaves any out. What falls out here is not among them when more are found."""
            out = np.unique(np.concatenate(found), axis=0)
            if not most or not len(out):
                return out, False
            ends, agree = np.concatenate([out[:, 0], out[:, 1]]), np.tile(out[:, 2], 2)
            order = np.lexsort((-agree, ends))
            first = np.flatnonzero(np.concatenate(([True], ends[order][1:] != ends[order][:-1])))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            keep = np.unique(order[rank < most] % len(out))
            return out[keep], len(keep) < len(out)

        while len(left):
            # the row ``gap`` after: as sizes ascend, once it is of another group or too large, all further ones are
            gap += 1
            left = left[left + gap < len(group)]
            right = left + gap
            same = (group[left] == group[right]) & (n[left] >= threshold * n[right] - 1e-9)
            left, right = left[same], right[same]
            check = np.flatnonzero((component[left] != component[right]) & ((own[left] < 0) | (own[left] != own[right])))
            for s in range(0, len(check), 8192):
                x, y = left[check[s : s + 8192]], right[check[s : s + 8192]]
                a, b = sketch[x], sketch[y]
                hit = may_reach(a, b, n[x], n[y], chances(n[x], n[y]), threshold)
                a, b, x, y = a[hit], b[hit], x[hit], y[hit]
                # the first band that the two share must be this bucket's
                keys, full = band_keys(a)
                other, _ = band_keys(b)
                first = np.argmax((keys == other) & full, axis=1)
                here = keys[np.arange(len(x)), first] == key[x] if len(x) else np.empty(0, bool)
                a, b, x, y = a[here], b[here], x[here], y[here]
                agree = (a == b).sum(axis=1)
                found.append(np.stack([np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]), agree], axis=1))
                size += len(x)
                if size > HELD_PAIRS:
                    out, some = merged()
                    found, size, dropped = [out], 0, dropped or some
        out, some = merged()
        more = [None] * (dropped or some)
        return pa.RecordBatch.from_arrays([pa.array([*out[:, 0].tolist(), *more], pa.int64()), pa.array([*out[:, 1].tolist(), *more], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            if len(group) and held and group[-1] == held[-1].column("group")[-1].as_py():
                held.append(batch)  # one group goes on through all of it
            elif len(group):
                cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
                if held or cut:
                    yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct 5-word shingles (A-Z
    lower-cased; a text of fewer words has its whole sequence). A null or blank text has an empty set and is linked with
    nothing. component_id is the smallest doc_id reachable, and kept says that it is the row's own. Rows that share a
    doc_id are expected to share the text; a row without a
    doc_id takes the component of its text's group, if it has one, and is kept. Other columns are not
    read; an empty table gives an empty result. A pair at the threshold is missed by all bands with a probability
    of (1 - 0.85^6)^42, about 2 in a thousand million; at 80 percent, of (1 - 0.8^6)^42, about 3 in a million."""
    threshold = percent / 100
    rows = durable(sketched(docs))
    full = rows.where(F.col("fingerprint").isNotNull() & F.col("doc_id").isNotNull())
    same = durable(full.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    sets = full.join(same.withColumnRenamed("id", "doc_id"), ["fingerprint", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    sets = durable(sets.select(F.col("doc_id").cast("bigint").alias("id"), "n_shingles", "sketch"))
    several = buckets(sets).groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(buckets(sets).join(several, "key"))
    alike = 100 * F.least(F.col("n_shingles"), F.col("least.n_shingles")) >= percent * F.greatest(F.col("n_shingles"), F.col("least.n_shingles"))
    star = durable(shared.where((F.col("id") != F.col("least.id")) & alike).select(F.col("id").alias("a"), F.col("least.id").alias("b")).distinct())
    links = durable(confirmed(durable(estimated(star, sets, threshold)), docs, percent))
    linked, tested = components(links), star
    for most in (NEAREST, None):
        # buckets of three or more whose members are in different components; a bucket of two has been compared
        member = shared.where("n > 2").select("key", "id", "n").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = member.groupBy("key").agg(F.max("n").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        mixed = durable(mixed.select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        met = mixed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
        found = durable(across(member.drop("n").join(mixed.drop("n"), "key").join(sets, "id"), threshold, most, min(MOST_TASKS, max(1, -(-met // TASK_ROWS)))))
        pairs = durable(found.where("a is not null").distinct().join(tested, ["a", "b"], "left_anti"))
        new = durable(confirmed(pairs, docs, percent))
        if not new.isEmpty():
            links = durable(links.unionByName(new))
            linked = components(links)
        if found.where("a is null").isEmpty():
            break
        tested = tested.unionByName(pairs)
    reach = same.select("fingerprint", F.col("id").cast("bigint").alias("id")).join(linked.withColumnRenamed("node", "id"), "id", "left")
    reach = reach.select(F.col("fingerprint").alias("_f"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(reach, F.col("fingerprint") == F.col("_f"), "left").withColumn("component_id", F.coalesce("component_id", F.col("doc_id").cast("bigint")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their group, with docs' own columns, whatever their names.

    All rows that share the first's doc_id stay, as they are one document, and so do rows without a doc_id."""
    gone = durable(near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct())
    few = gone.count() <= FILTER_IDS
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row).join(F.broadcast(gone) if few else gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti")
    return out.select("row.*")
