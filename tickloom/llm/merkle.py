"""Merkle manifest of a dataset: a root over all rows, and for each row what proves that it belongs to it.

Rows are leaves of a tree for each group, the groups' roots those of one more tree. Aligned blocks of leaves are handled by
a task each: a traversal hands out every leaf's authentication path one after another, holding only the current
siblings of each level, those that come next, and the stacks that make them. Blocks' roots are leaves of a smaller tree
in turn, so that no task sees more than a block's nodes at any height; the path above a block is shared by all its leaves
and comes as one row before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, lookup

#: Fixed by the contract: nodes of a run. Levels of a block, so that it has 4,096 leaves.
FAN, DEEP = 8, 4


def digest(parts: list[bytes]) -> bytes:
    """Digests are lowercase hex text, and joined as such."""
    return sha256(b"".join(parts)).hexdigest().encode()


def levels(n: int, fan: int = FAN) -> int:
    """Levels above n leaves until one node is left."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


class Treehash:
    """Makes the nodes of one height from a range of leaves, one leaf after another; runs at the range's end may be short."""

    def __init__(self, height: int, leaves: list[bytes], start: int, end: int, fan: int):
        self.height, self.leaves, self.at, self.end, self.fan = height, leaves, start, min(end, len(leaves)), fan
        self.runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    @property
    def nodes(self) -> list[bytes]:
        return self.runs[self.height]

    def low(self) -> int:
        """The least height of a node that is still to be merged; the own height before the first, none at the end."""
        if self.at >= self.end:
            return 1 << 30
        return next((h for h in range(self.height) if self.runs[h]), self.height)

    def update(self) -> None:
        self.runs[0].append(self.leaves[self.at])
        self.at += 1
        last = self.at == self.end == len(self.leaves)
        for h in range(self.height):
            if len(self.runs[h]) == self.fan or (last and self.runs[h]):
                self.runs[h + 1].append(digest(self.runs[h]))
                self.runs[h] = []


class Traversal:
    """The authentication paths of a block's leaves in order.

    For each height there are the siblings in use and a stack that makes the next ones while the leaves go by. In each
    step, as many leaves are worked on as there are stacks, always in the stack whose lowest unmerged node is lowest; so
    nodes of one height are merged before another stack begins with such, and few are held at a time."""

    def __init__(self, leaves: list[bytes], height: int, fan: int = FAN):
        self.leaves, self.height, self.fan, self.late = leaves, height, fan, 0
        self.groups = [fan ** (h + 1) for h in range(height)]
        # the first siblings of each height, in one pass
        first: list[list[bytes]] = [[] for _ in range(height)]
        runs: list[list[bytes]] = [[] for _ in range(height + 1)]
        for k, leaf in enumerate(leaves):
            runs[0].append(leaf)
            for h in range(height):
                if len(runs[h]) == fan or (k + 1 == len(leaves) and runs[h]):
                    first[h] = first[h] or runs[h]
                    runs[h + 1].append(digest(runs[h]))
                    runs[h] = []
        self.root, self.inner = runs[height][0], first
        self.coming = [Treehash(h, leaves, g, 2 * g, fan) for h, g in enumerate(self.groups) if g < len(leaves)]

    def held(self) -> int:
        return sum(map(len, self.inner)) + sum(len(r) for t in self.coming for r in t.runs)

    def __iter__(self) -> Iterator[list[tuple[bytes, bytes]]]:
        """For each leaf and level, the digests to the left and to the right, joined; the same list is changed and given again."""
        path: list[tuple[bytes, bytes]] = [(b"", b"")] * self.height
        for k in range(len(self.leaves)):
            for h in range(self.height):
                below = self.groups[h] // self.fan
                if k % below:
                    break
                if k and k % self.groups[h] == 0:
                    stack = self.coming[h]
                    while stack.at < stack.end:  # never so, as tests show
                        stack.update()
                        self.late += 1
                    self.inner[h] = stack.nodes
                    self.coming[h] = Treehash(h, self.leaves, k + self.groups[h], k + 2 * self.groups[h], self.fan)
                run, i = self.inner[h], k % self.groups[h] // below
                path[h] = (b"".join(run[:i]), b"".join(run[i + 1 :]))
            yield path
            for _ in self.coming:
                least = min(self.coming, key=Treehash.low)
                if least.at < least.end:
                    least.update()


def leaf_hash(columns: list[Column]) -> Column:
    """The digest of a row: each value's bytes after their number and a colon, a dash for null."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]), 256).cast("binary")


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with _pos, the place within the tree (from 0), and _size, the tree's leaves: one range sort, and numbers of
    rows by partition and tree, of which there are as many as partitions and trees together."""
    found = durable(rows.orderBy(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    counts = found.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = lookup(counts.withColumns({"_before": before, "_size": F.sum("_n").over(whole)}))
    return found.join(counts, ["_part", tree]).withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_n", "_first", "_before")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (_tree, _pos, ...) block by block, a block in one task."""
    block = F.floor(F.col("_pos") / size).alias("_block")
    blocks = rows.select("*", block) if "_block" not in rows.columns else rows
    return blocks.repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_pos")


def _height(size: int, fan: int, deep: int) -> int:
    return deep if size > fan**deep else levels(size, fan)


def _runs(batches: Iterator[pa.RecordBatch], block: int, rows: bool) -> Iterator[tuple[dict | None, dict[str, list]]]:
    """Whole blocks of sorted batches, with the row before them if ``rows`` says that each has one (_pos = -1)."""
    head, held = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["_pos"] == -1 if rows else r["_pos"] % block == 0:
                if held:
                    yield head, held
                head, held = r, {k: [] for k in r}
                if rows:
                    continue
            for k, x in r.items():
                held[k].append(x)
    if held:
        yield head, held


def climbed(nodes: DataFrame, fan: int, deep: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of nodes (_tree, _pos, _size, _digest, ...) below the blocks' roots, and each tree's root (_tree, _digest)."""
    block = fan**deep

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, held in _runs(batches, block, False):
            run = held["_digest"]
            for _ in range(_height(held["_size"][0], fan, deep)):
                run = [digest(run[k : k + fan]) for k in range(0, len(run), fan)]
            out.append((held["_tree"][0], held["_pos"][0] // block, -(-held["_size"][0] // block), run[0]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["_tree", "_pos", "_size", "_digest"])

    tiers, roots = [nodes], None
    while True:
        above = durable(_blocks(tiers[-1].select("_tree", "_pos", "_size", "_digest"), block).mapInArrow(reduce, "_tree string, _pos bigint, _size bigint, _digest binary"))
        done = above.where("_size = 1").select("_tree", "_digest")
        roots = done if roots is None else roots.unionByName(done)
        above = above.where("_size > 1")
        if above.isEmpty():
            return tiers, roots
        tiers.append(above)


PATH = "array<struct<left:binary,right:binary>>"


def _paths(nodes: DataFrame, heads: DataFrame, fan: int, deep: int) -> DataFrame:
    """(_tree, _pos, _path, _subroot, _root) of the nodes of a tier; heads are the same of their blocks."""
    block = fan**deep

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, held in _runs(batches, block, True):
            upper = [(p["left"], p["right"]) for p in head["_path"]]
            full = [[dict(zip(("left", "right"), x)) for x in [*path, *upper]] for path in Traversal(held["_digest"], _height(held["_size"][0], fan, deep), fan)]
            n = len(full)
            path = pa.array(full, pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array(held["_tree"], pa.string()), pa.array(held["_pos"], pa.int64()), path, *(pa.array([head[c]] * n, pa.binary()) for c in ("_subroot", "_root"))], ["_tree", "_pos", "_path", "_subroot", "_root"])

    return _headed(nodes.select("_tree", "_pos", "_size", "_digest"), heads, block).mapInArrow(walk, f"_tree string, _pos bigint, _path {PATH}, _subroot binary, _root binary")


def _headed(nodes: DataFrame, heads: DataFrame, block: int) -> DataFrame:
    """nodes and, before each block's, its row of heads (_tree, _pos: the block's place, _path, _subroot, _root)."""
    first = heads.select("_tree", F.col("_pos").alias("_block"), F.lit(-1).cast("long").alias("_pos"), "_path", "_subroot", "_root")
    both = nodes.withColumn("_block", F.floor(F.col("_pos") / block)).unionByName(first, allowMissingColumns=True)
    return _blocks(both, block)


def _descended(tiers: list[DataFrame], outer: DataFrame, fan: int, deep: int) -> DataFrame:
    """The heads of the lowest tier's blocks, from the trees' own (outer: _tree, _path, _subroot, _root)."""
    block = fan**deep
    top = outer.withColumn("_pos", F.lit(0).cast("long"))
    # a tree's outer path stands above the tier in which one block holds it all
    sizes = [t.select("_tree", "_size").where("_pos = 0") for t in tiers]
    heads = None
    for tier, size in zip(reversed(tiers), reversed(sizes)):
        whole = top.join(size.where(F.col("_size") <= block).select("_tree"), "_tree", "left_semi")
        heads = whole if heads is None else heads.unionByName(whole)
        if tier is not tiers[0]:
            heads = durable(_paths(tier, heads, fan, deep))
    return heads


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None, where: Column | None = None, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """One row for each row of docs: the order column, leaf, subroot, root, proof_sha256, folded_root and verified.

    Leaves are in the order's order in their group (null first; rows that share a value by their digests, so that ties
    and repeated rows have a defined place, and rows alike in all columns are interchangeable), groups by name, null
    first. Digests are lowercase hex. ``changed`` gives other values for columns, as a tampered copy has them: the leaf is
    made of those and folded with the original siblings. Texts are hashed where they are read, whatever their length,
    and never shuffled; blocks, not groups, are dealt to tasks, so one group may have most of the rows. Nulls are
    hashed as a dash; an empty table gives an empty result; other columns are not read."""
    now = [(changed or {}).get(c, F.col(c)) for c in columns]
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    claimed = F.when(F.lit(False) if where is None else where, leaf_hash(now))
    leaves = docs.select(F.col(order).alias("_id"), tree.alias("_tree"), leaf_hash([F.col(c) for c in columns]).alias("_digest"), claimed.alias("_claimed"))
    leaves = placed(leaves, "_tree", ["_id", "_digest"])
    tiers, subroots = climbed(leaves, fan, deep)
    tops = placed(subroots.select(F.lit("").alias("_all"), F.col("_tree").alias("_name"), "_digest"), "_all", ["_name"])
    tops = durable(tops.select(F.col("_all").alias("_tree"), "_name", "_digest", "_pos", "_size"))
    upper, root = climbed(tops, fan, deep)
    outer = root.select("_tree", F.array().cast(PATH).alias("_path"), F.col("_digest").alias("_subroot"), F.col("_digest").alias("_root"))
    above = _paths(tops, _descended(upper, outer, fan, deep), fan, deep)
    outer = durable(above.join(tops.select("_pos", "_name", "_digest"), "_pos").select(F.col("_name").alias("_tree"), "_path", F.col("_digest").alias("_subroot"), "_root"))
    heads = _descended(tiers, outer, fan, deep)
    block = fan**deep
    kind = leaves.schema["_id"].dataType
    arrow = to_arrow_type(kind)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for head, held in _runs(batches, block, True):
            upper = [(p["left"], p["right"]) for p in head["_path"]]
            rest, root = b"".join(x for p in upper for x in p), head["_root"].decode()
            proofs, folded = [], []
            for leaf, claimed, path in zip(held["_digest"], held["_claimed"], Traversal(held["_digest"], _height(held["_size"][0], fan, deep), fan)):
                proofs.append(sha256(b"".join([*(x for p in path for x in p), rest])).hexdigest())
                claimed = claimed or leaf
                for left, right in (*path, *upper):
                    claimed = sha256(left + claimed + right).hexdigest().encode()
                folded.append(claimed.decode())
            n = len(proofs)
            hexes = [x.decode() for x in held["_digest"]]
            yield pa.RecordBatch.from_arrays([pa.array(held["_id"], arrow), *map(pa.array, (hexes, [head["_subroot"].decode()] * n, [root] * n, proofs, folded, [f == root for f in folded]))], names)

    proven = _headed(leaves.select("_tree", "_pos", "_size", "_digest", "_claimed", "_id"), heads, block).mapInArrow(prove, f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proven.withColumnRenamed("id", order)
