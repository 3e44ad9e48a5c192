"""Merkle manifest of a dataset: postorder logs by aligned builders, proofs by closed-form positions.

A tree over n leaves groups every ``arity`` consecutive nodes of a level into
one of the next. Its nodes are written in the order in which they complete
(postorder), so the place of each follows from n alone. A builder owns an
aligned run of ``arity ** depth`` nodes of one level and appends all nodes above
them to its segment of the log; the last nodes of the segments are the leaves
of the next tier of builders. No builder waits for another of its tier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import ship
from paneloom.operators.ranges import ranks
from paneloom.operators.verbs import attach, lookup
from paneloom.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Bytes of a digest in a segment.
DIGEST = 32


def level_sizes(n: int, arity: int = 3, height: int | None = None) -> list[int]:
    """Nodes of each level of a tree over n leaves: up to its one root, or of exactly ``height`` levels above the leaves."""
    sizes = [n]
    while len(sizes) <= height if height is not None else sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def position(level: int, index: int, n: int, arity: int = 3, height: int | None = None) -> int:
    """Place of a node in the postorder log of a tree over n leaves.

    Before a node stand its own subtree, all subtrees to its left, and the
    ancestors that those have completed.
    """
    end = min((index + 1) * arity**level, n)
    place, width, above = -1, 1, index
    for at in range(len(level_sizes(n, arity, height))):
        if at <= level:
            place += -(-end // width)  # nodes of this level that end at or before the node's end
        else:
            above //= arity
            place += above
        width *= arity
    return place


@lru_cache(maxsize=64)
def positions(n: int, arity: int, height: int | None) -> list[list[int]]:
    """Places of all nodes of a segment, by level."""
    sizes = level_sizes(n, arity, height)
    return [[position(level, i, n, arity, height) for i in range(size)] for level, size in enumerate(sizes)]


def complete(leaves: Sequence[bytes], arity: int = 3, height: int | None = None) -> bytes:
    """The postorder log of a tree over some leaves: 32-byte digests in completion order.

    A run that is full, or at the end of its level, closes into a node of the
    level above, at once.
    """
    sizes = level_sizes(len(leaves), arity, height)
    runs: list[list[str]] = [[] for _ in sizes]
    done = [0] * len(sizes)
    out = []
    for digest in leaves:
        for level in range(len(sizes)):
            out.append(digest)
            runs[level].append(digest.hex())
            done[level] += 1
            if len(runs[level]) < arity and done[level] < sizes[level]:
                break
            if level + 1 < len(sizes):
                digest = sha256("".join(runs[level]).encode()).digest()
                runs[level].clear()
    return b"".join(out)


def path_of(log: bytes, index: int, n: int, arity: int = 3, height: int | None = None) -> str:
    """Siblings on the way from a leaf to the segment's root: ``left,right`` of each level, joined by ``;``.

    Left and right are the hexadecimal digests of the run before and after the
    node, read at their positions in the log.
    """
    places, steps = positions(n, arity, height), []
    for level in places[:-1]:
        first = index - index % arity
        hexed = lambda nodes: "".join(log[p * DIGEST : (p + 1) * DIGEST].hex() for p in nodes)
        steps.append(f"{hexed(level[first:index])},{hexed(level[index + 1 : first + arity])}")
        index //= arity
    return ";".join(steps)


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for step in path.split(";") if path else ():
        left, right = step.split(",")
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def field(value: Column) -> Column:
    """A value as ``bytes:value``, a null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def join_paths(*parts: Column) -> Column:
    """Paths one after the other; empty ones (trees of one node) leave no step."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ";")


class Tree:
    """The logs of the trees over ``leaves`` (tree, index, size, digest), size being the leaves of the tree.

    ``tiers[t]`` has one row per builder: tree, block, the number n of its
    nodes, the levels above them, their root and the segment. ``roots`` has one
    row per tree.
    """

    def __init__(self, leaves: DataFrame, arity: int = 3, depth: int = 6):
        ship(leaves.sparkSession)
        self.arity, self.width = arity, arity**depth
        self.tiers: list[DataFrame] = []
        schema = "tree string, block long, size long, n int, height int, root string, log binary"
        width = self.width

        def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            nodes = [bytes.fromhex(h) for h in group.sort_values("index")["digest"]]
            size = int(group["size"].iloc[0])
            height = depth if size > width else len(level_sizes(size, arity)) - 1
            log = complete(nodes, arity, height)
            row = {"tree": key[0], "block": key[1], "size": size, "n": len(nodes), "height": height, "root": log[-DIGEST:].hex(), "log": log}
            return pd.DataFrame([row])

        level = leaves.select("tree", "index", "size", "digest")
        while True:
            blocks = level.withColumn("block", F.expr(f"index div {width}"))
            tier = cut_lineage(blocks.groupBy("tree", "block").applyInPandas(build, schema))
            self.tiers.append(tier)
            if (tier.agg(F.max("block")).first()[0] or 0) == 0:
                break
            level = tier.select("tree", F.col("block").alias("index"), F.ceil(F.col("size") / width).alias("size"), F.col("root").alias("digest"))
        self.roots = tier.select("tree", "root")

    def paths(self, tier: int) -> DataFrame:
        """tree, index, path: of every node of a tier, from its builder's segment."""
        arity = self.arity

        def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for tree, block, n, height, log in batch.itertuples(index=False):
                    found = [path_of(log, i, n, arity, height) for i in range(n)]
                    yield pd.DataFrame({"tree": tree, "block": block, "slot": np.arange(n), "path": found})

        found = self.tiers[tier].select("tree", "block", "n", "height", "log").mapInPandas(extract, "tree string, block long, slot long, path string")
        return found.select("tree", (F.col("block") * self.width + F.col("slot")).alias("index"), "path")

    def upper(self, tier: int = 0) -> DataFrame:
        """tree, block, upper: the path from the root of each segment of a tier to the root of its tree."""
        above = self.tiers[tier].select("tree", "block", F.col("block").alias("__at"), F.lit("").alias("upper"))
        for found in [self.paths(t) for t in range(tier + 1, len(self.tiers))]:
            above = lookup(above, found, {"tree": "tree", "__at": "index"}, {"path": "__path"}, how="inner")
            above = above.select("tree", "block", F.expr(f"__at div {self.width}").alias("__at"), join_paths(F.col("upper"), F.col("__path")).alias("upper"))
        return above.select("tree", "block", "upper")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    arity: int = 3,
    depth: int = 6,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position``: the Merkle manifest of a table.

    A row is a leaf: the SHA-256 of its fields, each as byte count, colon and
    value, or ``-``. Per source the leaves, by id, form a tree; the trees'
    roots, by source, form the top tree, whose root stands for the table. Every
    row's proof (the siblings of its path, left to right, from its leaf through
    the source's root to the root) is extracted from the log and folded again:
    for rows whose checksum of the id is even, with the leaf of a tampered text
    (line feeds deleted), else with its own. ``position`` is the row's place in
    the postorder log of its source.

    Only digests move. Builders get at most ``arity ** depth`` nodes, whatever a
    source's share, and ranks come from range partitions. Null ids and null
    sources come first; rows equal in id are in order of their digest, so equal
    rows are interchangeable; null and empty texts have different leaves; an
    empty table gives no rows; columns beyond ``fields`` are not read.
    """
    ship(docs.sparkSession)
    values = {c: F.col(c) for c in fields}
    cut = values | {text_col: F.translate(F.col(text_col), "\n", "")}
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    lean = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            field(F.col(source_col)).alias("tree"),
            leaf_digest(*values.values()).alias("leaf"),
            F.when(tampered & (F.instr(F.col(text_col), "\n") > 0), leaf_digest(*cut.values())).alias("shown"),
        )
    )
    sizes = cut_lineage(lean.groupBy("tree").agg(F.count("*").alias("size"), F.first("source").alias("source")))
    placed = cut_lineage(attach(ranks(lean.drop("source"), ["tree"], ["doc_id", "leaf"], "index"), sizes.select("tree", "size"), ["tree"]))
    trees = Tree(placed.select("tree", "index", "size", F.col("leaf").alias("digest")), arity, depth)

    sources = sizes.agg(F.count("*").alias("size"))
    subroots = ranks(lookup(trees.roots, sizes, ["tree"], ["source"]), [], ["source", "tree"], "index")
    subroots = cut_lineage(attach(subroots.select(F.col("tree").alias("own"), F.col("root").alias("subroot"), "index"), sources, []))
    top = Tree(subroots.select(F.lit("").alias("tree"), "index", "size", F.col("subroot").alias("digest")), arity, depth)
    first = lookup(top.paths(0).withColumn("block", F.expr(f"index div {top.width}")), top.upper(), ["tree", "block"], ["upper"])
    over = first.select("index", join_paths(F.col("path"), F.col("upper")).alias("over"))
    over = lookup(subroots, over, ["index"], ["over"]).select(F.col("own").alias("tree"), "subroot", "over")
    over = cut_lineage(attach(over, top.roots.select(F.col("root").alias("whole")), []))

    segments = lookup(lookup(trees.tiers[0], trees.upper(), ["tree", "block"], ["upper"]), over, ["tree"], ["subroot", "over", "whole"])
    segments = segments.select("tree", "block", "n", "height", "log", "subroot", "whole", join_paths(F.col("upper"), F.col("over")).alias("beyond"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    rows = placed.select(F.col("doc_id").cast("string").alias("doc_id"), "tree", "index", "size", "leaf", "shown", F.expr(f"index div {trees.width}").alias("block"))
    width = trees.width
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"

    def prove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, _, n, height, log, subroot, whole, beyond = next(right.itertuples(index=False))
        proofs, folded = [], []
        for index, leaf, shown in left[["index", "leaf", "shown"]].itertuples(index=False):
            path = path_of(log, index % width, n, arity, height)
            path = ";".join(filter(None, (path, beyond)))
            proofs.append(sha256(path.replace(",", "").replace(";", "").encode()).hexdigest())
            folded.append(fold(shown if isinstance(shown, str) else leaf, path))
        out = left[["doc_id", "leaf"]].assign(subroot=subroot, root=whole, proof_sha256=proofs, folded_root=folded)
        place, above = left["index"].to_numpy(np.int64), left["index"].to_numpy(np.int64)
        for _ in level_sizes(int(left["size"].iloc[0]), arity)[1:]:
            above = above // arity
            place = place + above
        return out.assign(verified=out["folded_root"] == whole, position=place)

    proven = rows.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInPandas(prove, schema)
    return proven.withColumn("doc_id", F.col("doc_id").cast(kind))
