"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import id_text, ship
from paneloom.llm.graph import components
from paneloom.session import cut_lineage

BITS = 64


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of a text's word shingles; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only the six blanks split
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(flat, seed)], "<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in batch["text"]], np.uint64).view(np.int64)
            yield batch.drop(columns="text").assign(fp=prints)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def correlated_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal width, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0) if len(bits) else bits
    norm = np.sqrt((centred**2).sum(axis=0))
    norm[norm == 0] = 1
    corr = np.abs((centred / norm).T @ (centred / norm))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS * (k + 1)) // parts - (BITS * k) // parts
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(sample: np.ndarray, rows: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """Parts and their thresholds (-1: not probed) with the least estimated work.

    If the thresholds e sum to radius - parts + 1, two fingerprints within the
    radius are within e of each other in some part. Work is the probes sent
    plus the candidates met, estimated from the pairs of the sample; dynamic
    programming over parts finds the best allocation for each number of parts.
    """
    best: tuple[float, list[list[int]], list[int]] | None = None
    scale = (rows / max(len(sample), 1)) ** 2 / 2
    for parts in range(1, radius + 3):
        groups = correlated_parts(sample, parts)
        total = radius - parts + 1
        options = range(-1, radius + 1)
        cost = []
        for g in groups:
            cut = sample & np.uint64(_mask(g))
            near = np.zeros(radius + 1)
            for row in cut:
                d = np.bitwise_count(cut ^ row)
                near += np.bincount(d[d <= radius], minlength=radius + 1)
            near[0] -= len(sample)
            pairs, ball, costs = np.cumsum(np.maximum(near, 0)), 0.0, {-1: 0.0}
            for e in range(radius + 1):
                ball += len(list(combinations(range(min(len(g), 64)), e))) if e <= 2 else np.inf
                floor = rows**2 * ball / 2.0 ** len(g) / 2
                costs[e] = rows * ball + max(pairs[e] * scale, floor)
            cost.append(costs)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for costs in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (sofar, chosen) in table.items():
                for e in options:
                    new = (sofar + costs[e], [*chosen, e])
                    if spent + e not in step or new[0] < step[spent + e][0]:
                        step[spent + e] = new
            table = step
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], groups, table[total][1])
    assert best
    return best[1], best[2]


def _flips(bits: list[int], radius: int) -> list[int]:
    """XOR masks of all changes of at most ``radius`` of the bits."""
    return [_signed(_mask(list(c))) for k in range(radius + 1) for c in combinations(bits, k)]


def _ball(value: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m)))


def near_links(prints: DataFrame, radius: int = 2, sample_rows: int = 1024, bucket_rows: int = 48) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within ``radius``.

    Parts and thresholds come from ``allocate`` on a bounded sample; they only
    decide the cost. Buckets of more than ``bucket_rows`` fingerprints are not
    paired. Their members (and those that probe them) go by midpoints: two
    fingerprints within an even radius share a code half-way between them, and
    all that share a code are within the radius, so each hangs on the smallest
    one. A code has at most as many members as its ball has codes, so no
    group grows with the data and no all-pairs step exists.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: codes half-way between two fingerprints are used")
    distinct = cut_lineage(prints.select("fp").distinct())
    rows = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy(np.int64)
    groups, thresholds = allocate(drawn.view(np.uint64), rows, radius)
    used = [(k, g, e) for k, (g, e) in enumerate(zip(groups, thresholds, strict=True)) if e >= 0]
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("key")) for k, g, e in used])
    index = distinct.select("fp", F.inline(keys))
    if any(e for _, _, e in used):
        sent = None
        for k, g, e in used:
            one = index.where(F.col("part") == k).select("fp", "part", _ball(F.col("key"), _flips(g, e)).alias("key"))
            sent = one if sent is None else sent.union(one)
    else:
        sent = index
    crowded = index.groupBy("part", "key").count().where(F.col("count") > bucket_rows).select("part", "key", F.lit(True).alias("hot"))
    mine = index.select(F.col("fp").alias("b"), "part", "key").join(crowded, ["part", "key"], "left_anti")
    pairs = (
        sent.select(F.col("fp").alias("a"), "part", "key")
        .join(mine, ["part", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    hot = sent.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
    codes = hot.select("fp", _ball(F.col("fp"), _flips(list(range(BITS)), radius // 2)).alias("code"))
    met = codes.groupBy("code").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """``doc_id, text_hash, fp, root``: fingerprint and class of each row.

    Words are lower-cased (A-Z), shingles of ``shingle`` words count as often
    as they occur; a text with fewer words is one shingle, one without words
    has fingerprint zero and links like any other. ``root`` is the smallest
    (signed) fingerprint that links of at most ``radius`` differing bits can
    reach. One row comes out per row, null ids included; null texts count as
    empty; repeated rows fall in one class; an empty table gives none; other
    columns are not read.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    base = id_text(docs, id_col, text_col)
    prints = cut_lineage(base.select("doc_id", F.xxhash64("text").alias("text_hash"), print_of("text").alias("fp")))
    nodes = components(near_links(prints, radius))
    named = prints.select("fp").distinct().join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: SimHash classes and their components.

    Words are lower-cased (A-Z), shingles of ``shingle`` words count as often
    as they occur; a text with fewer words is one shingle, one without words
    has fingerprint zero and links like any other. ``component_id`` is the
    smallest id that links of at most ``radius`` differing bits can reach.

    One row comes out per row; equal fingerprints are one node, so copies cost
    nothing in the search. Null texts count as empty; null ids get the
    smallest known id of their component (null if it has none); repeated rows
    fall in one component; an empty table gives none; other columns are not
    read.
    """
    ship(docs.sparkSession)
    base = id_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(base.mapInPandas(_fingerprints(shingle, seed), f"doc_id {kind}, fp long"))
    nodes = components(near_links(prints, radius))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = smallest.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
