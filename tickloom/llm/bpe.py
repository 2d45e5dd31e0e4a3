"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token with which the encoding of that prefix ends.
The table of these last tokens is filled from left to right: the last token of a prefix is the one vocabulary
entry ending there that follows, without a merge across the border, the last token of the prefix before it.
Walking the table back from the end gives the encoding. As entries never change when bytes are appended, an
append continues the table, and an edit recomputes it from the edit on until it agrees with the old one again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Flush a result batch at this many bytes, so that a task holds a few megabytes whatever the texts' lengths are.
FLUSH_BYTES = 8 << 20
#: Distinct pre-tokens whose ids a task remembers, in each of two generations; those met again move to the younger.
REMEMBERED = 200_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Parses a rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


class PrefixEncoder:
    """Encodes byte strings by the table of last tokens; ``pattern`` splits texts before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, {r: b for b, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._free: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        #: finds the entries that end at each byte, longest first
        self.ends = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), r))
        self.ends.make_automaton()
        self.longest = max(map(len, ranks), default=1)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token was merged from; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([x]) for x in self.pieces[token]]
            while len(parts) > 2:
                found = [(self.ranks[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.ranks and self.ranks[m] < token]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two neighbouring tokens.

        Goes back in time on both sides of the border. A pair there would merge if its rank came before the
        merges that took in its parts; on equal ranks the merge further left is made first."""
        key = (left, right)
        if (known := self._free.get(key)) is not None:
            return known
        taken_left = taken_right = 1 << 62
        while True:
            rank = self.ranks.get(self.pieces[left] + self.pieces[right])
            if rank is not None and rank < taken_left and rank <= taken_right:
                free = False
                break
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                free = True
                break
            if b is None or (a is not None and left > right):
                taken_left, left = left, a[1]
            else:
                taken_right, right = right, b[0]
        if len(self._free) > 8 * REMEMBERED:
            self._free.clear()
        self._free[key] = free
        return free

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Continues the table of last tokens, in place, up to the whole of data or its first ``until`` bytes."""
        done, free, apart = len(last), self._free.get, self.apart
        start = max(0, done + 1 - self.longest)
        for end, (size, token) in self.ends.iter(data[start:until].decode("latin-1")):
            if (end := end + start) < done:
                continue
            if end > done:
                raise ValueError("the ranks lack a byte or are no BPE vocabulary")
            if size > end:
                if size > end + 1:
                    continue
            elif not ((known := free((last[end - size], token))) or (known is None and apart(last[end - size], token))):
                continue
            last.append(token)
            done += 1
        if done < (len(data) if until is None else until):
            raise ValueError("the ranks lack a byte or are no BPE vocabulary")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        ids, i = [], len(last)
        while i:
            ids.append(last[i - 1])
            i -= len(self.pieces[last[i - 1]])
        return ids[::-1]

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replaces data[start:end]; the table is recomputed from there until it agrees with the old one.

        Once as many neighbouring entries agree as the longest token has bytes, all later ones do."""
        changed, shift = data[:start] + new + data[end:], len(new) - (end - start)
        table, agreed = last[:start], 0
        while len(table) < len(changed):
            self.extend(changed, table, len(table) + 1)
            old = len(table) - 1 - shift
            agreed = agreed + 1 if len(table) > start + len(new) and last[old] == table[-1] else 0
            if agreed >= self.longest:
                table += last[old + 1 :]
        return changed, table

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one pre-token that is not in the younger generation."""
        if (ids := self._older.get(text)) is None:
            data = text.encode()
            token = self.ranks.get(data)
            ids = (token,) if token is not None else tuple(self.walk(self.extend(data, [])))
        if len(text) <= 64:
            if len(self._known) >= REMEMBERED:
                self._older, self._known = self._known, {}
            self._known[text] = ids
        return ids

    def forget(self) -> None:
        """Drops what is remembered of pre-tokens and borders."""
        self._known, self._older, self._free = {}, {}, {}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        piece = self.piece
        for part in self.pattern.findall(text):
            ids += self._known.get(part) or piece(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_encoders: dict[tuple[int, str], PrefixEncoder] = {}


def _encoder(raw: bytes, pattern: str) -> PrefixEncoder:
    key = (hash(raw), pattern)
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(read_ranks(raw), pattern)
    return _encoders[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_tokens, token_ids (packed little-endian unsigned 32-bit) and decoded (the bytes
    that the ids stand for).

    No shuffle: each task encodes the texts of its own scan. A null text counts as empty and has no tokens; repeated
    rows are encoded each; other columns of docs are not read. The rank file is read once and broadcast (under 1 MB)."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, token_ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            held, first = 0, 0
            for k, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py())
                packed, plain = np.array(ids, "<u4").tobytes(), encoder.decode(ids)
                for column, value in zip(out[1:], (len(ids), packed, plain)):
                    column.append(value)
                held += len(packed) + len(plain)
                if held >= FLUSH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, k + 1 - first), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["id", "n_tokens", "token_ids", "decoded"])
                    out, held, first = ([], [], [], []), 0, k + 1
        # workers go on to other stages, and would hold it beside what these need
        encoder.forget()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
