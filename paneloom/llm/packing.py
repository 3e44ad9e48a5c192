"""Best-fit packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import id_text, ship
from paneloom.llm.tokens import encoder
from paneloom.session import cut_lineage


def fullest(room: int, free: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Counts of available lengths whose sum is the largest that fits ``room``.

    ``free`` holds (length, how many). Bit s of ``reach`` says that sum s is
    possible; each length adds shifted copies, in powers of two up to its
    count. The sets before each length lead back to the combination.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in free:
        if length > room:
            continue
        before, left, pack = reach, min(count, room // length), 1
        while left > 0:
            n = min(pack, left)
            reach |= (reach << (n * length)) & limit
            left, pack = left - n, pack * 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen.append((length, n))
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, count in each)]) until nothing is left.

    Each sequence starts with the longest length left; the rest of it is the
    fullest feasible combination. A combination is used as often as the
    lengths last, so the work depends on the capacity, not on the rows.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    lengths, plan = sorted(left, reverse=True), []
    for longest in lengths:
        while left[longest]:
            left[longest] -= 1
            free = [(k, left[k]) for k in lengths if k <= capacity - longest and left[k]]
            chosen = dict(fullest(capacity - longest, free)) if free else {}
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(left[k] // n for k, n in chosen.items())
            for k, n in chosen.items():
                left[k] -= times * n
            plan.append((times, sorted(chosen.items(), reverse=True)))
    return plan


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = encoder(path, words_only=True)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            encoded = library.each(batch["text"].tolist())
            for doc_id, ids in zip(batch["doc_id"], encoded, strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _placer(plan: list[tuple[int, list[tuple[int, int]]]]):
    """Sequence and offset of the r-th piece of a length, looked up in the plan."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, content in plan:
        offset = 0
        for length, n in content:
            table.setdefault(length, []).append((taken.get(length, 0), first, n, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += length * n
        first += times
    arrays = {k: np.array(v, np.int64).T for k, v in table.items()}

    def run(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        size, nth = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            start, base, each, at = arrays[int(size[rows[0]])]
            k = np.searchsorted(start, nth[rows], "right") - 1
            inside = nth[rows] - start[k]
            sequence[rows] = base[k] + inside // each[k]
            offset[rows] = at[k] + inside % each[k] * size[rows[0]]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with its sequence and place there.

    A document is its ids and an end id 0; only documents longer than
    ``capacity`` are cut. Sequences are filled by minimum bin slack. As lengths
    are at most ``capacity``, their histogram is all that the search needs:
    the driver gets that bounded histogram and returns a bounded plan, and the
    r-th piece of each length looks up its place. Ranks come from counts by
    (partition, length), so a length that a third of all rows share is not one
    task's work, and no text is shuffled.

    Null and empty texts are the end id alone (one piece of length 1); null
    ids stay; repeated rows are packed as often as they occur; an empty table
    gives none; other columns are not read.
    """
    ship(docs.sparkSession)
    base = id_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = cut_lineage(base.mapInPandas(_pieces(tokenizer, capacity), schema))
    counts = cut_lineage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part")
    ranks = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("earlier"))
    placed = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    place = F.pandas_udf(_placer(plan_bins(histogram, capacity)), "sequence_id long, offset long")
    return placed.withColumn("at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )
