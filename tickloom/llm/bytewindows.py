"""Suffix-array dedup: byte windows that also start in an earlier document, by a depth-limited radix sort.

Windows of 50 bytes are ordered only through their 50 bytes, most significant digit first, and a window leaves the sort as
soon as a digit tells it from all others. The first digit of a window is its anchor: the 20-byte gram in it with the
smallest scrambled hash, the leftmost of equals. Equal windows have equal anchors at equal places, and neighbouring
windows mostly share theirs, so the first pass sorts anchors, not bytes. The second digit is the segment, all the bytes of
the windows that share an anchor: a segment that an earlier document has is repeated as a whole. What is left are
segments whose anchor an earlier document has among other bytes, at the ends of repeated passages; the third pass sorts
their windows by all 50 bytes. Equal groups of the last two digits are exactly the repeated windows. (Digits of more than 8
bytes are compared by 64-bit hashes.)

Texts are dealt to batches once. What travels between batches and buckets (a bucket is a range of a digit's values) are
packed digits, each distinct one once for a batch, so a passage that very many documents share costs one record a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _BYTE, mix, powers

GRAM = 20
#: Bytes of text in a batch, of packed digits in a bucket, and of text hashed at once in a task; the least of both.
BATCH_BYTES, BUCKET_BYTES, STEP_BYTES, LEAST_GROUPS = 5 << 20, 12 << 20, 1 << 19, 24
#: Bytes that are sent of a gram, a segment and a window, besides what the bucket tells. Grams that agree by chance only
#: leave more segments to the third pass.
GRAM_SENT, SEGMENT_SENT, WINDOW_SENT = 5, 6, 7
LAST = (1 << 63) - 1
_SALT = np.uint64(0x5851F42D4C957F2D)


def pack(x: np.ndarray, size: int) -> bytes:
    """The low bytes of each number, so many."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def low_bytes(x: np.ndarray, size: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * size) - 1)


def pack_ids(x: np.ndarray) -> bytes:
    """Document ids in four bytes each where they fit, which the first byte tells."""
    small = not len(x) or (x.min() >= 0 and x.max() < 1 << 32)
    return b"\x04" + x.astype("<u4").tobytes() if small else b"\x08" + x.astype("<i8").tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[:1] == b"\x04" else "<i8", offset=1).astype(np.int64)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def least_of(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with these keys (the first counts most): the order that sorts them, where each distinct key begins in
    it, and the smallest id of each."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return order, begin, np.minimum.reduceat(ids[order], begin) if len(begin) else np.empty(0, np.int64)


class Batch:
    """The texts of a batch, the runs of their windows that share an anchor, and the distinct digits of these."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, buckets: int):
        self.ids, self.texts, self.window, self.buckets = ids, texts, window, buckets
        self.sums: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []
        for piece in self._pieces():
            found.append(self._runs(*piece))
        column = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.empty(0, kind)
        #: of each run: document, block, first and last window in the block, place of the block's byte 0 in the text
        self.doc, self.block, self.first, self.last, self.at = (column(k, np.int64) for k in range(5))
        gram, self.segment = column(5, np.uint64), low_bytes(column(6, np.uint64), SEGMENT_SENT)
        self.bucket, self.gram = bucket_of(gram, buckets), low_bytes(gram, GRAM_SENT)
        order, begin, self.least = least_of((self.bucket, self.gram, self.segment), ids[self.doc])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        self.one = order[begin]
        self.start = np.searchsorted(self.bucket[self.one], np.arange(buckets + 1, dtype=np.uint64))

    def _pieces(self) -> Iterator[tuple[list[int], list[int], bytes]]:
        """Blocks of whole texts, or of parts of a long text that overlap by a window less a byte."""
        docs: list[int] = []
        parts: list[bytes] = []
        held = 0
        for i, text in enumerate(self.texts):
            if len(text) < self.window:
                continue
            if held and held + len(text) > STEP_BYTES:
                yield docs, [0] * len(docs), parts
                docs, parts, held = [], [], 0
            if len(text) > STEP_BYTES:
                for s in range(0, len(text) - self.window + 1, STEP_BYTES):
                    yield [i], [s], [text[s : s + STEP_BYTES + self.window - 1]]
            else:
                docs.append(i)
                parts.append(text)
                held += len(text)
        if docs:
            yield docs, [0] * len(docs), parts

    def _runs(self, docs: list[int], offsets: list[int], parts: list[bytes]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        self.sums.append(total)
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
        # the smallest of each window's grams, with its place in the low half
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        width, span = self.window - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        size = np.array([len(p) for p in parts])
        end = np.cumsum(size)
        inside = np.ones(len(low), bool)  # windows that do not run over a text's end
        for k in range(1, self.window):
            at = end[:-1] - k
            inside[at[at >= 0]] = False
        start = np.flatnonzero(inside)
        anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        first, last, anchor = start[edge], start[np.append(edge[1:], len(start)) - 1], anchor[edge]
        shape = (last - first).astype(np.uint64) << np.uint64(32) | (anchor - first).astype(np.uint64)
        segment = mix((total[last + self.window] - total[first]) * down[first] + mix(shape + _SALT))
        own = np.searchsorted(end, first, "right")
        begin = end - size
        where = np.array(docs)[own]
        return where, np.full(len(first), len(self.sums) - 1), first, last, np.array(offsets)[own] - begin[own], mix(gram[anchor] + _SALT), segment

    def windows(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of one run of each of these distinct segments, by the run of the segment's first document:
        index of the segment, place in its run, hash."""
        run = self.one[group]
        n = self.last[run] - self.first[run] + 1
        index = np.repeat(np.arange(len(group)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, block, hashes = self.first[run][index] + place, self.block[run][index], np.zeros(len(index), np.uint64)
        for b in np.unique(block):
            k = np.flatnonzero(block == b)
            total, s = self.sums[b], at[k]
            hashes[k] = mix((total[s + self.window] - total[s]) * powers(len(total))[1][s] + _SALT)
        return index, place, hashes


KINDS = "batch int, pass int, bucket int, at binary, least binary, open binary"


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) for every row of (doc_id, text).

    A byte is removed if it is covered by a window of ``window`` bytes of UTF-8 that also starts in a document with a
    smaller doc_id; windows never cross texts, and are judged on the input. A null text is empty; a row without a doc_id
    counts as after all others; rows that share a doc_id remove nothing from each other. Other columns are not read; an
    empty table gives an empty result. A text is held by one task, and so are a batch's and a bucket's bytes, whose sizes
    don't depend on the data's; all three passes take the same exchange of the texts."""
    if window < GRAM:
        raise ValueError(f"windows have {GRAM} bytes at least")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(LEAST_GROUPS, -(-size // BATCH_BYTES))
    buckets = max(LEAST_GROUPS, -(-size // BUCKET_BYTES))
    texts = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).repartition(batches, "batch")

    def load(t: pa.Table) -> Batch:
        ids = np.array([LAST if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        return Batch(ids, t.column("text").to_pylist(), window, buckets)

    def table(found: list[tuple], names: str) -> pa.Table:
        kinds = [pa.int32() if k.split()[1] == "int" else pa.binary() for k in names.split(", ")]
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], [k.split()[0] for k in names.split(", ")])

    digits = "bucket int, batch int, gram binary, segment binary, ids binary"

    def first_digits(t: pa.Table) -> pa.Table:
        b, batch = load(t), t.column("batch")[0].as_py()
        found = []
        for k in np.flatnonzero(np.diff(b.start)):
            g = slice(b.start[k], b.start[k + 1])
            one = b.one[g]
            found.append((int(k), batch, pack(b.gram[one], GRAM_SENT), pack(b.segment[one], SEGMENT_SENT), pack_ids(b.least[g])))
        return table(found, digits)

    def joined(t: pa.Table, names: dict[str, int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The digits of a bucket from all batches, in order; from which row each is, and its place there."""
        t = t.sort_by("batch")
        ids = [unpack_ids(x) for x in t.column("ids").to_pylist()]
        n = np.array([len(x) for x in ids])
        columns = [np.concatenate([unpack(x, size) for x in t.column(c).to_pylist()]) for c, size in names.items()]
        row = np.repeat(np.arange(len(n)), n)
        return [*columns, np.concatenate(ids)], row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def answer(t: pa.Table, step: int, row: np.ndarray, place: np.ndarray, told: np.ndarray, least: np.ndarray, open_: np.ndarray) -> pa.Table:
        """For each batch, the places where an earlier document of another batch has the digit, that document, and the
        places that stay open."""
        order = t.sort_by("batch").column("batch").to_pylist()
        bucket = t.column("bucket")[0].as_py()
        found = []
        told, open_ = np.flatnonzero(told), np.flatnonzero(open_)
        told_from, open_from = (np.searchsorted(row[x], np.arange(len(order) + 1)) for x in (told, open_))
        for r, batch in enumerate(order):
            a, o = told[told_from[r] : told_from[r + 1]], open_[open_from[r] : open_from[r + 1]]
            if len(a) or len(o):
                found.append((batch, step, bucket, place[a].astype("<u4").tobytes(), pack_ids(least[a]), place[o].astype("<u4").tobytes()))
        return table(found, KINDS)

    def sort_segments(t: pa.Table) -> pa.Table:
        (gram, segment, ids), row, place = joined(t, {"gram": GRAM_SENT, "segment": SEGMENT_SENT})
        order, begin, low = least_of((gram, segment), ids)
        n = np.diff(np.append(begin, len(order)))
        least = np.empty(len(ids), np.int64)
        least[order] = np.repeat(low, n)
        # an anchor that is in segments of different bytes leaves the first of each open
        same = gram[order[begin]]
        shared = np.zeros(len(begin), bool)
        shared[1:] |= same[1:] == same[:-1]
        shared[:-1] |= same[1:] == same[:-1]
        several = np.empty(len(ids), bool)
        several[order] = np.repeat(shared, n)
        return answer(t, 1, row, place, least < ids, least, several & (least == ids))

    def replies(b: Batch, t: pa.Table, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for r in t.to_pylist():
            if r["pass"] == step:
                yield r["bucket"], np.frombuffer(r["at"], "<u4").astype(np.int64), unpack_ids(r["least"]), np.frombuffer(r["open"], "<u4").astype(np.int64)

    def open_windows(b: Batch, t: pa.Table) -> tuple[np.ndarray, ...]:
        """The open segments of a batch, and their windows with the distinct hashes' order."""
        group = np.sort(np.concatenate([b.start[k] + o for k, _, _, o in replies(b, t, 1)] or [np.empty(0, np.int64)]))
        index, place, hashes = b.windows(group)
        bucket, hashes = bucket_of(hashes, buckets), low_bytes(hashes, WINDOW_SENT)
        order, begin, least = least_of((bucket, hashes), b.least[group][index])
        return group, index, place, bucket, hashes, order, begin, least

    def last_digits(texts: pa.Table, replied: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if texts.num_rows and replied.num_rows:
            b, batch = load(texts), texts.column("batch")[0].as_py()
            _, _, _, bucket, hashes, order, begin, least = open_windows(b, replied)
            one = order[begin]
            cut = np.searchsorted(bucket[one], np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cut)):
                g = slice(cut[k], cut[k + 1])
                found.append((int(k), batch, pack(hashes[one[g]], WINDOW_SENT), b"", pack_ids(least[g])))
        return table(found, digits)

    def sort_windows(t: pa.Table) -> pa.Table:
        (hashes, ids), row, place = joined(t, {"gram": WINDOW_SENT})
        order, begin, low = least_of((hashes,), ids)
        least = np.empty(len(ids), np.int64)
        least[order] = np.repeat(low, np.diff(np.append(begin, len(order))))
        return answer(t, 2, row, place, least < ids, least, np.zeros(len(ids), bool))

    def remove(texts: pa.Table, replied: pa.Table) -> pa.Table:
        b = load(texts)
        least = b.least.copy()
        for k, at, low, _ in replies(b, replied, 1):
            least[b.start[k] + at] = low
        whole = least[b.group] < b.ids[b.doc]
        doc, start, stop = b.doc[whole], (b.first + b.at)[whole], (b.last + b.at)[whole] + window
        group, index, place, bucket, hashes, order, begin, low = open_windows(b, replied)
        if len(group):
            cut = np.searchsorted(bucket[order[begin]], np.arange(buckets + 1, dtype=np.uint64))
            for k, at, found, _ in replies(b, replied, 2):
                low[cut[k] + at] = found
            each = np.empty(len(order), np.int64)
            each[order] = np.repeat(low, np.diff(np.append(begin, len(order))))
            # these windows, in all runs of the open segments in their first document
            hit = each < b.least[group][index]
            spot = np.full(len(b.least), -1)
            spot[group] = np.arange(len(group))
            runs = np.flatnonzero((spot[b.group] >= 0) & (b.ids[b.doc] == b.least[b.group]))
            runs = runs[np.argsort(spot[b.group[runs]], kind="stable")]
            mine = spot[b.group[runs]]
            at, n = np.flatnonzero(hit), np.bincount(index[hit], minlength=len(group))
            base = np.cumsum(n) - n
            count = n[mine]
            run = np.repeat(runs, count)
            pick = at[np.repeat(base[mine], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            begin_at = (b.first + b.at)[run] + place[pick]
            doc, start, stop = np.append(doc, b.doc[run]), np.append(start, begin_at), np.append(stop, begin_at + window)
        by = np.lexsort((start, doc))
        doc, start, stop = doc[by], start[by], stop[by]
        edges = np.searchsorted(doc, np.arange(len(b.texts) + 1))
        removed, spans, kept = [], [], []
        for i, text in enumerate(b.texts):
            s, e = start[edges[i] : edges[i + 1]], stop[edges[i] : edges[i + 1]]
            if len(s):
                reach = np.maximum.accumulate(e)
                new = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
                s, e = s[new], reach[np.append(new[1:], len(e)) - 1]
                left = [text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)])]
                kept.append(b"".join(left))
            else:
                kept.append(text)
            removed.append(len(text) - len(kept[-1]))
            spans.append(len(s))
        sizes = [len(x) for x in b.texts]
        return pa.table([texts.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    replies_1 = texts.groupBy("batch").applyInArrow(first_digits, digits).groupBy("bucket").applyInArrow(sort_segments, KINDS)
    asked = texts.groupBy("batch").cogroup(replies_1.groupBy("batch")).applyInArrow(last_digits, digits)
    replies_2 = asked.groupBy("bucket").applyInArrow(sort_windows, KINDS)
    both = replies_1.unionByName(replies_2)
    return texts.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
