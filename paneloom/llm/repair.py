"""Token ids in Re-Pair grammar files with random access."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import id_text, ship
from paneloom.llm.tokens import encoder
from paneloom.session import new_folder


def compress(ids: np.ndarray, terminals: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: the sequence over terminals and rules, and the rules (left, right).

    The most frequent pair of neighbours becomes a rule, again and again, until
    no pair occurs ``least`` times. The places of a pair are kept from when its
    younger symbol was made; later rules can only take some of them away. So a
    pair that comes up first tests its places, and goes back with its true
    count if others have used them. Runs of one symbol pair from the left. Work
    is the sort of the first pairs and what each rule touches.
    """
    n = len(ids)
    sym = np.append(ids.astype(np.int32), np.int32(-1))  # the last place is past the end; after[] may name it
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    places: dict[tuple[int, int], np.ndarray] = {}
    queue: list[tuple[int, int, int]] = []

    def by_symbol(key: np.ndarray) -> np.ndarray:
        """A stable order; symbols of 16 bits are sorted by counting."""
        return (key.astype(np.uint16) if terminals + len(rules) < 1 << 16 else key).argsort(kind="stable")

    def offer(key: np.ndarray, at: np.ndarray, pair_of: Callable[[int], tuple[int, int]], order: np.ndarray | None = None) -> None:
        """Pairs, told apart by a key, that occur often enough, with their places in order."""
        if len(at) < least:
            return
        if order is None:
            alike = key.astype(np.uint16) if terminals + len(rules) < 1 << 16 else key.copy()
            alike.sort()
            if not (alike[least - 1 :] == alike[: len(alike) - least + 1]).any():
                return  # no key is there so often
            order = by_symbol(key)
        key = key.take(order)
        cuts = np.concatenate(([0], (key[1:] != key[:-1]).nonzero()[0] + 1, [len(key)]))
        counts = cuts[1:] - cuts[:-1]
        for k in (counts >= least).nonzero()[0].tolist():
            pair = pair_of(int(key[cuts[k]]))
            places[pair] = at.take(order[cuts[k] : cuts[k + 1]])
            heappush(queue, (-int(counts[k]), *pair))

    rules: list[tuple[int, int]] = []
    if n > 1:
        # pairs in a crowded place of a hashed count, which are all frequent pairs and few others
        hashed = (sym[: n - 1] * np.int32(0x9E3B1) + sym[1:n]) & np.int32((1 << 20) - 1)
        at = (np.bincount(hashed) >= least).take(hashed).nonzero()[0]
        left, right = sym.take(at), sym.take(at + 1)
        order = by_symbol(right)
        order = order.take(by_symbol(left.take(order)))
        offer(left.astype(np.int64) << 32 | right, at, lambda key: (key >> 32, key & 0xFFFFFFFF), order)
    while queue:
        count, a, b = heappop(queue)
        at = places.pop((a, b))
        gone = after.take(at)
        still = (sym.take(at) == a) & (sym.take(gone) == b)
        left_over = np.count_nonzero(still)
        if left_over < least:
            continue
        if left_over < len(at):
            at, gone = at.compress(still), gone.compress(still)
        if a == b:
            # in a run of k places that follow each other every second one is taken
            starts = np.flatnonzero(np.concatenate(([True], after[at[:-1]] != at[1:])))
            second = (np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0
            at, gone = at.compress(second), gone.compress(second)
            if len(at) < least:
                continue
        if len(at) < -count and queue and -len(at) > queue[0][0]:
            places[a, b] = at
            heappush(queue, (-len(at), a, b))
            continue
        fresh = terminals + len(rules)
        rules.append((a, b))
        then = after.take(gone)
        sym[at], sym[gone] = fresh, -1
        after[at], before[then] = then, at
        prior = before.take(at)
        if prior[0] < 0:  # places are in order; before the first and after the last there may be none
            prior = prior[1:]
        left = sym.take(prior)
        other = left != fresh  # two fresh ones in a row count from the first
        offer(left.compress(other), prior.compress(other), lambda key: (key, fresh))
        if then[-1] == n:
            at, then = at[:-1], then[:-1]
        offer(sym.take(then), at, lambda key: (fresh, key))
    return sym[sym >= 0], np.array(rules, np.int64).reshape(-1, 2)


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.empty(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals])
    return out


class Grammar:
    """Decodes any range of a shard's ids."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> None:
        self.symbols = symbols
        size = np.concatenate((np.ones(terminals, np.int64), lengths))
        self.offset = np.concatenate(([0], np.cumsum(size)[:-1]))
        flat = np.empty(int(size.sum()), np.uint32)
        flat[:terminals] = np.arange(terminals)
        for k, (a, b) in enumerate(rules.tolist()):
            at, left = self.offset[terminals + k], size[a]
            flat[at : at + left] = flat[self.offset[a] : self.offset[a] + left]
            flat[at + left : at + left + size[b]] = flat[self.offset[b] : self.offset[b] + size[b]]
        self.size, self.flat = size, flat
        self.ends = np.cumsum(size[symbols])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: only the symbols that cover them are expanded."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(self.ends, (start, stop - 1), "right")
        part = self.symbols[first : last + 1]
        sizes = self.size[part]
        ends = np.cumsum(sizes)
        take = np.repeat(self.offset[part] - (ends - sizes), sizes) + np.arange(ends[-1])
        before = start - (self.ends[first] - self.size[self.symbols[first]])
        return self.flat[take[before : before + stop - start]]


def _writer(path: str, block_ids: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = encoder(path)
        terminals = max(library.library.get_vocab_size(with_added_tokens=True), 1)
        part, shard, done = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def block() -> pd.DataFrame:
            nonlocal shard, done, names, held, size
            ids = np.frombuffer(b"".join(held), "<u4")
            seq, rules = compress(ids, terminals, least)
            width = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
            row = {
                "part": part,
                "shard": shard,
                "start_in_part": done,
                "n_ids": len(ids),
                "terminals": terminals,
                "ids": names,
                "counts": np.array([len(h) // 4 for h in held], np.int64),
                "rules": rules.astype("<u4").tobytes(),
                "lengths": rule_lengths(rules, terminals).astype("<u4").tobytes(),
                "symbols": seq.astype(width).tobytes(),
                "width": int(width[2:]),
            }
            shard, done, names, held, size = shard + 1, done + len(ids), [], [], 0
            return pd.DataFrame([row])

        for batch in batches:
            encoded = library.each(batch["text"].tolist())
            for doc_id, ids in zip(batch["doc_id"], encoded, strict=True):
                names.append(None if pd.isna(doc_id) else doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= block_ids:
                    yield block()
        if held:
            yield block()

    return run


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            rules = np.frombuffer(r.rules, "<u4").reshape(-1, 2)
            symbols = np.frombuffer(r.symbols, f"<u{r.width}").astype(np.int64)
            ids = Grammar(symbols, rules, np.frombuffer(r.lengths, "<u4").astype(np.int64), r.terminals).ids(0, r.n_ids)
            counts = np.asarray(r.counts, np.int64)
            ends = np.cumsum(counts)
            raw = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pd.DataFrame({"part": r.part, "start_in_part": r.start_in_part + ends - counts, "doc_id": pd.Series(list(r.ids), dtype="object"), "n_tokens": counts, "ids_crc32": crc})


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 1 << 20,
    least: int = 64,
) -> None:
    """Writes the ids of all texts, each followed by id 0, in ascending id order.

    Documents are range-partitioned and sorted by id; a shard is the next run
    of them of about ``block_ids`` ids (a longer document is a shard alone).
    A shard is one row of the files: document ids and their numbers of ids,
    the rules, the expansion length of each rule, and the compressed symbols.
    Each shard has its own grammar, so any of them is decoded alone, and the
    expansion lengths lead to any range within it without decoding the rest.

    Null texts count as empty and give just the id 0; null ids come first;
    repeated rows are written as often as they occur; an empty table gives
    files without rows; other columns are not read.
    """
    ship(docs.sparkSession)
    base = id_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"part int, shard int, start_in_part long, n_ids long, terminals int, ids array<{kind}>, counts array<long>, rules binary, lengths binary, symbols binary, width int"
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(_writer(tokenizer, block_ids, least), schema).write.option("compression", "zstd").parquet(folder)


def read_token_files(docs_from: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the rows of token files.

    ``start`` counts the ids of all documents before. The driver sees one
    total for each partition that wrote.
    """
    spark = docs_from.sparkSession
    kind = docs_from.schema["ids"].dataType.elementType.simpleString()
    totals = docs_from.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    ship(spark)
    read = docs_from.select("part", "start_in_part", "n_ids", "terminals", "ids", "counts", "rules", "lengths", "symbols", "width")
    decoded = read.mapInPandas(_reader, f"part int, start_in_part long, doc_id {kind}, n_tokens long, ids_crc32 long")
    return decoded.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes token files into the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write_token_files(docs, tokenizer, folder, **options)
    return read_token_files(spark.read.parquet(folder))
