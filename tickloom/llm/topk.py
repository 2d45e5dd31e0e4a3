"""Exact top-k inner product search over integer vectors: norm-sorted blocks, SVD-rotated partial sums, residual bounds.

Vectors are rotated into the directions of the second-moment matrix of the candidates (its SVD, computed from a d x d sum
that Spark gathers), so the leading coordinates hold most of each inner product. Every query gets a first bound, its k-th
score among the longest candidates. By Cauchy-Schwarz it needs no candidate that is shorter than that bound over its own
length, so candidates lie in bands by length, queries in bands by the length they need, and only bands that may hold
a result meet: what is too short is not even sent. In a block, longest first, the leading coordinates give a partial
sum, and the residual lengths bound the remainder; only pairs that can still reach the k-th score get their exact integer
product. Rounding of the rotated sums is covered by a margin, so nothing that belongs to the result is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import durable

#: Rows of a candidate block and of a query block (each held by a task as one matrix), of a step within a block, and
#: of the head, the longest vectors, with which every query gets its first bound.
BLOCK_ROWS, QUERY_ROWS, STEP_ROWS, HEAD_ROWS = 8192, 2048, 2048, 2048
#: Length bands at most; their sizes and cuts go through the driver.
MOST_BANDS = 256
#: Sums of integers below this are exact in floating point; those of longer pairs are made of Python's integers.
EXACT = 2.0**52
#: Scaled components beyond this are as good as infinite.
MOST = 1e140


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (floor(scale * x) of each component, integers as doubles), length of the vectors that take part, one row
    for each id: of several vectors with one id the smallest, as arrays are ordered, stands."""
    x = F.transform(vector_col, lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= MOST), F.lit(False)))
    # below 2^53 a double has fractions to round down; above, it is an integer
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)
    rows = vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(x, whole).alias("v"))
    several = durable(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if not several.isEmpty():
        one = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        rows = rows.join(several, "id", "left_anti").unionByName(one)
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


def matrix(column: pd.Series, d: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), d))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def moments(rows: DataFrame, d: int) -> np.ndarray:
    """The d x d sum of v v' over all rows: one partial matrix for each task, added up by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            m = matrix(pdf["v"], d)
            m /= np.maximum(1.0, np.abs(m).max(axis=1, keepdims=True, initial=0.0) / 2.0**26)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(d * d), "x": total.ravel()})

    total = np.zeros(d * d)
    for i, x in rows.select("v").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x")).collect():
        total[i] = x
    return total.reshape(d, d)


def best(scores: list[int], ids: list[int], k: int) -> list[int]:
    """Indices of the k best: highest score, then smallest id."""
    return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]


def products(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows; ``most`` bounds each by the lengths."""
    out = np.concatenate([np.einsum("ij,ij->i", a[s : s + 65536], b[s : s + 65536]) for s in range(0, len(a), 65536)]) if len(a) else np.empty(0)
    large = np.flatnonzero(most >= EXACT)
    if len(large):
        out = out.astype(object)
        for i in large:
            out[i] = sum(int(x) * int(y) for x, y in zip(a[i], b[i]))
    return out


class Rotated:
    """A block of vectors, longest first, with leading coordinates and residual lengths in the rotated space."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, turn: np.ndarray, lead: int):
        length = np.linalg.norm(m, axis=1)
        order = np.lexsort((ids, -length))
        self.ids, self.m, self.length = ids[order], m[order], length[order]
        turned = self.m @ turn
        self.lead, self.rest = turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)


def search(q: Rotated, c: Rotated, bound: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each query with a chance here: its id, the ids and scores of its k best candidates of the block."""
    found: list[tuple[list[int], list[int]]] = [([], []) for _ in q.ids]
    bound = bound.copy()
    for at in range(0, len(c.ids), STEP_ROWS):
        part = slice(at, at + STEP_ROWS)
        longest = c.length[at]
        margin = 1e-9 * (1 + q.length * longest)
        live = np.flatnonzero(q.length * longest + margin >= bound)
        if not len(live):
            break
        upper = q.lead[live] @ c.lead[part].T + np.outer(q.rest[live], c.rest[part]) + margin[live, None]
        row, col = np.nonzero(upper >= bound[live, None])
        if not len(row):
            continue
        most = q.length[live[row]] * c.length[part][col]
        # where most pairs are left, one product of matrices costs less than a product for each pair
        if len(row) > 0.1 * upper.size and most.max() < EXACT:
            score = (q.m[live] @ c.m[part].T)[row, col]
        else:
            score = products(q.m[live[row]], c.m[part][col], most)
        ids = c.ids[part][col]
        keep = (ids != q.ids[live][row]) & (score >= (bound - margin)[live][row])
        row, score, ids = row[keep], score[keep], ids[keep]
        present, begins = np.unique(row, return_index=True)
        for r, a, b in zip(present, begins, np.append(begins[1:], len(row))):
            i = live[r]
            mine = score[a:b]
            if b - a > 4 * k and mine.dtype != object:
                # ties at the k-th score stay in
                mine = np.flatnonzero(mine >= np.partition(mine, -k)[-k]) + a
            else:
                mine = np.arange(a, b)
            all_ids, all_scores = found[i][0] + ids[mine].tolist(), found[i][1] + [int(x) for x in score[mine]]
            top = best(all_scores, all_ids, k)
            found[i] = ([all_ids[t] for t in top], [all_scores[t] for t in top])
            if len(top) == k:
                bound[i] = max(bound[i], float(all_scores[top[-1]]))
    for i, (ids, scores) in enumerate(found):
        if len(ids):
            yield int(q.ids[i]), ids, scores


def band_of(column: str, cuts: list[float]) -> Column:
    """The number of cuts that a value reaches: 0 below the first."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def edges(rows: DataFrame, column: str, bands: int) -> list[float]:
    """Quantiles that cut the rows into so many bands."""
    cuts = rows.agg(F.percentile_approx(column, [i / bands for i in range(1, bands)], 10_000)).first()[0] if bands > 1 else []
    return sorted(set(cuts or []))


def dealt(rows: DataFrame, asked: DataFrame, n: int, queries: int) -> tuple[DataFrame, DataFrame]:
    """Queries (part, block, id, v, bound) and candidates (part, block, id, v) as they are exchanged.

    asked has ``need``, the least length of a candidate that may reach the query's bound. A part holds queries of one band
    of needs, a block candidates of one band of lengths; of each two bands, all parts meet all blocks if the longest
    candidate has the least need, and none otherwise. What the driver holds is a row for each band."""
    length_cuts = edges(rows, "length", min(MOST_BANDS, max(1, -(-n // BLOCK_ROWS))))
    need_cuts = edges(asked, "need", min(MOST_BANDS, max(1, -(-queries // QUERY_ROWS))))
    lengths = rows.withColumn("band", band_of("length", length_cuts)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("edge")).orderBy("band").collect()
    needs = asked.withColumn("band", band_of("need", need_cuts)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("edge")).orderBy("band").collect()

    def numbered(bands: list[Row], size: int) -> dict[int, tuple[int, int]]:
        """The first group of each band, and its number of groups: a band of equal values may hold all rows."""
        out, base = {}, 0
        for b in bands:
            out[b["band"]] = (base, -(-b["n"] // size))
            base += out[b["band"]][1]
        return out

    blocks, parts = numbered(lengths, BLOCK_ROWS), numbered(needs, QUERY_ROWS)
    # needs ascend with the bands, so a candidate meets the parts up to a number, and a query the blocks from one on
    last_part = {b["band"]: max([parts[x["band"]][0] + parts[x["band"]][1] - 1 for x in needs if x["edge"] <= b["edge"]], default=-1) for b in lengths}
    first_block = {b["band"]: min([blocks[x["band"]][0] for x in lengths if x["edge"] >= b["edge"]], default=None) for b in needs}
    most = sum(c for _, c in blocks.values()) - 1
    look = lambda table, band: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), band)
    own = lambda table, band: (look({k: v[0] for k, v in table.items()}, band) + F.pmod(F.xxhash64("id"), look({k: v[1] for k, v in table.items()}, band).cast("long"))).cast("int")
    c = rows.withColumn("band", band_of("length", length_cuts)).withColumn("last", look(last_part, F.col("band"))).where("last >= 0").withColumn("block", own(blocks, F.col("band")))
    c = c.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last")))).select("part", "block", "id", "v")
    q = asked.withColumn("band", band_of("need", need_cuts)).withColumn("from", look(first_block, F.col("band"))).where("from is not null").withColumn("part", own(parts, F.col("band")))
    q = q.withColumn("block", F.explode(F.sequence(F.col("from"), F.lit(most)))).select("part", "block", "id", "v", "bound")
    return q, c


def bounded(rows: DataFrame, every: int, k: int, d: int) -> DataFrame:
    """id, v, bound (the k-th score among the longest vectors, less a margin; -inf with fewer), need of the queries."""
    head = rows.orderBy(F.col("length").desc(), "id").limit(HEAD_ROWS).select("id", "v").toPandas()
    first = rows.sparkSession.sparkContext.broadcast((head["id"].to_numpy(), matrix(head["v"], d)))
    asked = rows.where(F.col("id") % every == 0).select("id", "v", "length")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = first.value
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s : s + 256]
                score = matrix(part["v"], d) @ m.T
                score[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                got = np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(part), -np.inf)
                length = part["length"].to_numpy()
                bound = got - 1e-9 * (1 + length * np.linalg.norm(m, axis=1).max(initial=0.0))
                need = np.where(bound > 0, bound / np.maximum(length, 1e-300) * (1 - 1e-9), 0.0)
                yield part[["id", "v"]].assign(bound=bound, need=need)

    kind = f"id {asked.schema['id'].dataType.simpleString()}, v array<double>, bound double, need double"
    return durable(asked.mapInPandas(start, kind))


def top_k(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, lead: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best other rows.

    Scores are inner products of floor(scale * x); ties go to the smaller id; a query with fewer others gets them all.
    Vectors that are null or hold a null, NaN or infinity take no part, nor do those with a scaled component beyond 1e140
    or without an id; one shorter than others counts as ending in zeros. Of rows that share an id, the one with the
    smallest vector stands for all. Products of any size are exact; a score that a long can't hold is ranked by what it is,
    and written as the nearest long. Other columns are not read; an empty table gives an empty result."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    n, d, queries = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(F.col("id") % every == 0)).first()
    schema = "query_id long, vec_id long, score long, exact string"
    if not queries or not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = np.linalg.svd(moments(rows, d))[0]
    lead = lead or max(1, d // 4)
    asked, candidates = dealt(rows, bounded(rows, every, k, d), n, queries)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, str | None]] = []
        if len(left) and len(right):
            left = left.sort_values("id")
            ids, m, bound = left["id"].to_numpy(), matrix(left["v"], d), left["bound"].to_numpy()
            order = np.lexsort((ids, -np.linalg.norm(m, axis=1)))
            block = Rotated(right["id"].to_numpy(), matrix(right["v"], d), turn, lead)
            for query, found, scores in search(Rotated(ids, m, turn, lead), block, bound[order], k):
                out += [(query, int(i), max(-(1 << 63), min((1 << 63) - 1, s)), None if abs(s) < 1 << 63 else str(s)) for i, s in zip(found, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "exact"])

    near = asked.groupBy("part", "block").cogroup(candidates.groupBy("part", "block")).applyInPandas(meet, schema)
    # digits of a score beyond a long: more of them are further from zero
    beyond = F.when(F.col("exact").isNull(), F.lit("")).otherwise(F.concat(F.lpad(F.length("exact"), 4, "0"), "exact"))
    above, below = F.when(~F.col("exact").startswith("-"), beyond), F.when(F.col("exact").startswith("-"), beyond)
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.coalesce(above, F.lit("")).desc(), F.coalesce(below, F.lit("")), "vec_id")
    return near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
