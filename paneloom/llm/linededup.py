"""Line deduplication by pairwise alignment with earlier documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import let, ship, whole_number
from paneloom.session import cut_lineage

WORD = "[^\\x20\\x09-\\x0D]+"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned lines, in order.

    Equal lines at both ends of a stretch are aligned; then lines that occur
    once on both sides, kept in their longest increasing order, divide the
    stretch, and each part is aligned the same way.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        times, others = Counter(a[lo:hi]), Counter(b[low:high])
        place = {x: i for i, x in enumerate(a[lo:hi], lo) if times[x] == 1 and others.get(x) == 1}
        matched = [(place[x], j) for j, x in enumerate(b[low:high], low) if x in place]
        tails: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(matched):
            at = bisect_left(tails, i)
            back.append(piles[at - 1] if at else -1)
            if at == len(tails):
                tails.append(i)
                piles.append(k)
            else:
                tails[at], piles[at] = i, k
        k, chain = (piles[-1] if piles else -1), []
        while k >= 0:
            chain.append(matched[k])
            k = back[k]
        last = (lo, low)
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if chain:
            todo.append((last[0], hi, last[1], high))
    return sorted(out)


def longest_runs(a: list[int], b: list[int]) -> list[int]:
    """For each place of ``b`` the length of the longest run from there that ``a`` holds anywhere.

    A suffix automaton of ``a`` read backwards; linear, also for texts of repeated lines.
    """
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for x in reversed(a):
        new, at = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        while at >= 0 and x not in step[at]:
            step[at][x] = new
            at = link[at]
        if at >= 0:
            to = step[at][x]
            if size[to] != size[at] + 1:
                step.append(dict(step[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                copy = len(step) - 1
                while at >= 0 and step[at].get(x) == to:
                    step[at][x] = copy
                    at = link[at]
                link[to], to = copy, copy
            link[new] = to
        last = new
    out, at, n = [0] * len(b), 0, 0
    for j in range(len(b) - 1, -1, -1):
        while at and b[j] not in step[at]:
            at = link[at]
            n = size[at]
        if b[j] in step[at]:
            at, n = step[at][b[j]], n + 1
        out[j] = n
    return out


def common_blocks(a: list[int], b: list[int], telling: list[bool]) -> list[int]:
    """Lines of ``b`` in aligned blocks that hold a telling line.

    What the patience diff leaves (stretches without unique lines, moved or
    repeated blocks) is aligned by longest runs, so no telling line that ``a``
    holds stays.
    """
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(telling[x] for x in block):
                gone += block
            block = []
        block.append(j)
        last = (i, j)
    taken, held = set(gone), set(a)
    if any(t and x in held and j not in taken for j, (x, t) in enumerate(zip(b, telling, strict=True))):
        runs, j = longest_runs(a, b), 0
        while j < len(b):
            end = j
            while end < j + runs[j] and end not in taken:
                end += 1
            if any(telling[j:end]):
                gone += range(j, end)
                j = end
            else:
                j += 1
    return gone


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        gone = [common_blocks(list(a), list(b), list(t)) for a, b, t in zip(batch["a_lines"], batch["lines"], batch["telling"], strict=True)]
        yield batch[["id", "th"]].assign(gone=gone)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4, rare_share: float = 0.5
) -> DataFrame:
    """All columns and rows of ``docs`` with the text after deletion, plus ``n_lines`` and ``n_deleted_lines``.

    A line is telling if it has ``min_words`` words. A telling line is rare if
    at most ``rare_share`` of the documents hold it. Each rare line leads a
    document to the earliest document that holds it, so a line costs one pair
    for each holder and no group is paired in itself. The lines of a pair are
    aligned with patience diff, then by longest common runs, whatever their
    order and number; aligned runs with a telling line are deleted from the
    later document, so it keeps no rare line of an earlier one. The earliest copy of a line is never deleted:
    nothing before it holds that line.

    Earlier means a smaller id (null ids last), then a smaller hash of the
    text. Rows equal in id and text are one document: both keep the same
    lines. Null texts stay null and count 0 lines; empty texts have one empty
    line, which is not telling; a document whose lines all go becomes the empty
    text. An empty table gives none. Extra columns pass through, also with
    names like those used here (an input column n_lines or n_deleted_lines is
    replaced).

    Lines move as 64-bit hashes; texts are joined once with the line numbers
    to delete.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if whole_number(docs, id_col):
        kind, order_id = "long", F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    else:
        kind, order_id = "string", F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1"))
    lines = F.split(text, "\n", -1)
    base = cut_lineage(
        docs.select(
            order_id.alias("id"),
            F.xxhash64(text).alias("th"),
            F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
            F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)) >= min_words).alias("telling"),
        )
    )
    total = base.count()
    marked = F.filter(F.arrays_zip("lines", "telling"), lambda z: z["telling"])
    # the whole text is one more rare line, so that copies meet their first copy
    seeds = F.array_union(F.transform(marked, lambda z: z["lines"]), F.when(F.size(marked) > 0, F.array(F.col("th").bitwiseXOR(F.lit(1 << 40)))).otherwise(F.array().cast("array<long>")))
    held = base.select("id", "th", F.explode(F.array_distinct(seeds)).alias("line"))
    owners = cut_lineage(  # written, so that the next join stands on exchanges alone and a hot line is split
        held.groupBy("line")
        .agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("holders"))
        .where((F.col("holders") > 1) & (F.col("holders") <= F.lit(max(2.0, total * rare_share))))
        .select("line", "first")
    )
    pairs = (
        held.join(owners, "line")
        .where(F.struct("id", "th") > F.col("first"))
        .select("id", "th", F.col("first.id").alias("a_id"), F.col("first.th").alias("a_th"))
        .distinct()
    )
    unique = base.dropDuplicates(["id", "th"])
    earlier = unique.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), F.col("lines").alias("a_lines"))
    aligned = pairs.join(earlier, ["a_id", "a_th"]).join(unique, ["id", "th"]).select("id", "th", "a_lines", "lines", "telling")
    gone = aligned.mapInPandas(_align, f"id {kind}, th long, gone array<int>")
    deleted = gone.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    packed = docs.select(order_id.alias("id"), F.xxhash64(text).alias("th"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    joined = packed.join(deleted, ["id", "th"], "left")
    kept_lines = F.split(F.col("row")[text_col], "\n", -1)
    numbered = F.sequence(F.lit(0), F.size(kept_lines) - 1)
    keep = F.array_except(numbered, "gone")
    cleaned = F.when(F.size("gone") > 0, _picked(kept_lines, keep)).otherwise(F.col("row")[text_col])
    others = [F.col("row")[c].alias(c) if c != text_col else cleaned.alias(c) for c in docs.columns if c not in ("n_lines", "n_deleted_lines")]
    n_lines = F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size(kept_lines)).cast("long")
    return joined.select(*others, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted_lines"))


def _picked(lines, places):
    """The lines at the given places, joined again."""
    return let(lines, lambda ls: F.array_join(F.transform(places, lambda i: F.get(ls, i)), "\n"))
