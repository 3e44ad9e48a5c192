"""Exact repeats of long byte strings, with run-length BWT indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import number_of, ship
from paneloom.session import cut_lineage

#: An odd multiplier and its inverse mod 2**64, for rolling hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: The bytes between words.
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of parts of a sequence of numbers, equal for equal parts."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, numbers: np.ndarray, starts, stops) -> np.ndarray:
        """The hashes of the parts from ``starts`` to ``stops``."""
        n = len(numbers)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(BASE, n + 1), _powers(INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((numbers.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[stops] - sums[starts]) * self.down[: n + 1][starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and stop."""
    edges = np.flatnonzero(np.diff(BLANK[np.frombuffer(text, np.uint8)].view(np.int8), prepend=1, append=1))
    return edges[::2], edges[1::2]


class Segments:
    """Cuts texts where the smallest hash inside a sliding window changes.

    Every string of ``length`` symbols has an anchor: of its substrings of
    ``gram`` symbols the leftmost one with the smallest hash. Equal strings
    have the same anchor at the same place. A segment holds all strings of a
    text that share one anchor, so equal strings lie in segments of equal
    anchors. Symbols are bytes, or hashes of words.
    """

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.rolling = Rolling()

    def of(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, start, stop and anchor of each segment; the texts stand one after the other in ``symbols``."""
        ends = np.cumsum(sizes)
        n = len(symbols)
        if n < self.length:
            return (np.empty(0, np.int64),) * 4
        h = self.rolling(symbols, slice(0, n + 1 - self.gram), slice(self.gram, n + 1))
        h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // self.width) * self.width, np.uint64(2**64 - 1))
        padded[: len(h)] = h
        blocks = padded.reshape(-1, self.width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.length + 1
        anchor = (np.minimum(right[:starts], left[self.width - 1 : self.width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(starts + 1, np.int32)  # starts of strings that stay in one text
        long = sizes >= self.length
        np.add.at(inside, (ends - sizes)[long], 1)
        np.add.at(inside, (ends - self.length + 1)[long], -1)
        anchor[np.cumsum(inside[:-1]) == 0] = -1
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts, [starts])) - 1
        kept = anchor[first] >= 0
        first, last = first[kept], last[kept]
        return np.searchsorted(ends, first, "right"), first, last + self.length, anchor[first]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(length: int, gram: int, words: int, word_gram: int, batch_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, word_cutter, rolling = Segments(length, gram), Segments(words, word_gram), Rolling()
        digest = xxhash.xxh3_64_intdigest

        def hashes(held: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
            return np.fromiter((digest(held[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)

        def of_bytes(group: list[bytes]) -> tuple[np.ndarray, ...]:
            held = b"".join(group)
            sizes = np.array([len(t) for t in group], np.int64)
            owner, a, b, p = cutter.of(np.frombuffer(held, np.uint8), sizes)
            begin = (np.cumsum(sizes) - sizes)[owner]
            return owner, hashes(held, p, p + gram) & -2, hashes(held, a, b), a - begin, b - begin

        def of_words(group: list[bytes]) -> tuple[np.ndarray, ...]:
            data = b" ".join(group)
            begin = np.cumsum([0] + [len(t) + 1 for t in group])
            starts, stops = word_places(data)
            symbols = rolling(np.frombuffer(data, np.uint8), starts, stops)
            owner, a, b, p = word_cutter.of(symbols, np.diff(np.searchsorted(starts, begin)))
            held = symbols.tobytes()
            return owner, hashes(held, 8 * p, 8 * (p + word_gram)) | 1, hashes(held, 8 * a, 8 * b), starts[a] - begin[owner], stops[b - 1] - begin[owner]

        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            ids, ths = batch["id"].to_numpy(), batch["th"].to_numpy()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= batch_bytes):
                    size += len(texts[stop])
                    stop += 1
                group = texts[at:stop]
                for owner, anchor, seg, a, b in (of_bytes(group), of_words(group)):
                    yield pd.DataFrame({"id": ids[at + owner], "th": ths[at + owner], "anchor": anchor, "seg": seg, "start": a, "stop": b})
                at = stop

    return run


def repeated_starts(parts: list[bytes] | list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each part the places where a string of ``length`` symbols starts that starts elsewhere too.

    Symbols are bytes, or numbers from 0. The parts are one text with an end
    mark after each. Its suffixes are sorted (doubling ranks), which gives the
    BWT; only at the ends of BWT runs is the match with the neighbour suffix
    measured. Inside a run a match is one symbol shorter than that of the
    symbol before, so a stream through the text gets all matching statistics
    from those samples.
    """
    numbers = [np.frombuffer(p, np.uint8) if isinstance(p, bytes) else p for p in parts]
    sizes = np.array([len(p) for p in parts], np.int64)
    n = int(sizes.sum()) + len(parts)
    ends = np.cumsum(sizes + 1) - 1
    sym = np.ones(n, np.int64)
    sym[ends] = 0
    sym[sym > 0] += np.concatenate(numbers)
    rest = np.repeat(ends, sizes + 1) - np.arange(n)
    bits, own = int(sym.max()).bit_length() or 1, n.bit_length()
    packed = max(3 * own, bits + own) <= 63  # a key and its place fit in one number
    first = max(1, min((63 - own * packed) // bits, 8, n))
    key = np.zeros(n, np.int64)
    for j in range(first):  # the first symbols, nothing beyond the part
        key[: n - j] |= np.where(rest[: n - j] > j, sym[j:], 0) << (bits * (first - 1 - j))
    ranks, h = [], first
    while True:
        if packed:
            key = np.sort(key << own | np.arange(n))
            order, key = key & ((1 << own) - 1), key >> own
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.diff(key, prepend=key[0]) != 0)
        ranks.append((h, rank))
        if h >= sizes.max() or rank[order[-1]] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - h] = np.where(rest[: n - h] > h, rank[h:].astype(np.int64) + 1, 0)
        key = rank.astype(np.int64) << own | after
        h *= 2
    before = np.empty(n, np.int64)
    before[1:] = sym[:-1]
    before[0] = 0
    bwt = before[order]
    heads = np.ones(n, bool)
    heads[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
    heads = np.flatnonzero(heads)
    p = order[heads]
    q = order[np.maximum(heads - 1, 0)]
    match = np.zeros(len(heads), np.int64)
    for step, rank in reversed(ranks):
        a, b = p + match, q + match
        inside = (match < rest[p]) & (match < rest[q])
        same = np.zeros(len(heads), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        match[same] += step
    match = np.minimum(match, np.minimum(rest[p], rest[q]))
    while True:  # what is left is shorter than the smallest step
        live = np.flatnonzero((match < rest[p]) & (match < rest[q]))
        live = live[sym[p[live] + match[live]] == sym[q[live] + match[live]]]
        if not len(live):
            break
        match[live] += 1
    match[heads == 0] = 0
    sampled = np.full(n, -n, np.int64)
    sampled[p] = match + p
    stream = np.maximum(np.maximum.accumulate(sampled) - np.arange(n), 0)
    along = stream[order]
    again = along >= length
    again[:-1] |= along[1:] >= length
    marked = np.zeros(n, bool)
    marked[order[again]] = True
    marked &= rest >= length
    return [np.flatnonzero(marked[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _runs(starts: np.ndarray, length: int) -> list[list[int]]:
    """Byte ranges that the strings at these starts cover."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate(([0], gaps + 1))]
    last = starts[np.concatenate((gaps, [len(starts) - 1]))] + length
    return np.stack((first, last), axis=1).tolist()


def _merged(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(r[0]), int(r[1])) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _index(length: int, words: int, index_bytes: int):
    def byte_ranges(parts: list[bytes]) -> list[list[list[int]]]:
        return [_runs(s, length) for s in repeated_starts(parts, length)]

    def word_ranges(parts: list[bytes]) -> list[list[list[int]]]:
        numbers: dict[bytes, int] = {}
        texts = [np.array([numbers.setdefault(w, len(numbers)) for w in p.split()], np.int64) for p in parts]
        out = []
        for p, s in zip(parts, repeated_starts(texts, words), strict=True):
            starts, stops = word_places(p) if len(s) else ((), ())
            out.append([[int(starts[a]), int(stops[b - 1])] for a, b in _runs(s, words)])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[tuple[int, int]] = []
        parts: list[bytes] = []
        size, last = 0, None

        def solve() -> pd.DataFrame:
            nonlocal names, parts, size
            rows = []
            for odd, ranges in ((0, byte_ranges), (1, word_ranges)):
                those = [k for k, (a, _) in enumerate(names) if a & 1 == odd]
                found = ranges([parts[k] for k in those]) if those else []
                rows += [(*names[k], r) for k, r in zip(those, found, strict=True) if r]
            names, parts, size = [], [], 0
            return pd.DataFrame(rows, columns=["anchor", "seg", "ranges"])

        for batch in batches:
            for anchor, seg, content in zip(batch["anchor"], batch["seg"], batch["content"], strict=True):
                if anchor != last and size >= index_bytes:
                    yield solve()
                last = anchor
                names.append((anchor, seg))
                parts.append(content)
                size += len(content)
        if parts:
            yield solve()

    return run


def _strings(length: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for anchor, seg, content in zip(batch["anchor"], batch["seg"], batch["content"], strict=True):
                if anchor & 1:
                    split, (starts, stops) = content.split(), word_places(content)
                    n = len(split) - words + 1
                    hashes = [_signed(digest(b" ".join(split[i : i + words]))) for i in range(n)]
                    starts, stops = starts[:n], stops[words - 1 :]
                else:
                    n = len(content) - length + 1
                    hashes = [_signed(digest(content[i : i + length])) for i in range(n)]
                    starts, stops = np.arange(n), np.arange(n) + length
                yield pd.DataFrame({"anchor": anchor, "seg": seg, "start": starts, "stop": stops, "string": hashes})

    return run


def _ranges(places: pd.Series) -> pd.Series:
    return pd.Series([_merged(p) for p in places])


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, marks, passages in zip(batch["text"], batch["marks"], batch["passages"], strict=True):
            data = text.encode()
            kept, removed, spans, at = hashlib.sha256(), 0, 0, 0
            for a, b in _merged(marks) if marks is not None else ():
                kept.update(data[at:a])
                removed, spans, at = removed + b - a, spans + 1, b
            kept.update(data[at:])
            words = sum(len(data[a:b].split()) for a, b in _merged(passages)) if passages is not None else 0
            rows.append((len(data), removed, spans, kept.hexdigest(), words))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def repeat_ranges(
    docs: DataFrame,
    length: int = 400,
    gram: int = 96,
    words: int = 51,
    word_gram: int = 8,
    batch_bytes: int = 1 << 20,
    index_bytes: int = 1 << 20,
    most_variants: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, th, marks, passages``: the byte ranges of each document that repeats cover.

    ``marks`` are the ranges of strings of ``length`` bytes that start
    elsewhere too, ``passages`` those of ``words`` words in a row that do,
    whatever their bytes and the blanks between them.

    Texts are cut into segments by anchors (see ``Segments``), once by bytes
    and once by words; a segment moves as two hashes, and its anchor is odd
    where it was cut by words. A segment whose content occurs twice is covered
    whole. Only where segments share the anchor but not the content is one
    copy of each content fetched and put, with the others of its anchor, into
    a run-length BWT index, whose matching statistics tell the strings that
    repeat. Anchors with more than ``most_variants`` contents are settled by
    counting their strings by hash instead, so no group has to fit in a task.

    The key is (id, hash of the text); rows equal in both are separate
    occurrences. Ids that are no whole numbers go by a hash of their text.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(number_of(docs, id_col), F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = cut_lineage(keyed.mapInPandas(_cut(length, gram, words, word_gram, batch_bytes), "id long, th long, anchor long, seg long, start int, stop int"))
    # written, so that the next join stands on exchanges alone and a hot anchor is split
    shared = cut_lineage(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    hits = cut_lineage(found.join(shared, "anchor", "left_semi"))
    contents = cut_lineage(
        hits.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "stop")).alias("one"))
    )
    variants = contents.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1")
    several = contents.join(variants, "anchor").select("anchor", "seg", "variants", "one.*")
    fetched = cut_lineage(
        keyed.join(several, ["id", "th"])
        .select("anchor", "seg", "variants", F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("stop") - F.col("start")).alias("content"))
        .dropDuplicates(["anchor", "seg"])  # rows equal in id and text fetch it twice
    )
    few = fetched.where(F.col("variants") <= most_variants).select("anchor", "seg", "content").repartition("anchor").sortWithinPartitions("anchor", "seg")
    kind = "anchor long, seg long, ranges array<array<int>>"
    indexed = few.mapInPandas(_index(length, words, index_bytes), kind)
    strings = fetched.where(F.col("variants") > most_variants).select("anchor", "seg", "content").mapInPandas(_strings(length, words), "anchor long, seg long, start int, stop int, string long")
    twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "string")
    again = strings.join(twice, ["anchor", "string"], "left_semi").groupBy("anchor", "seg").agg(F.collect_list(F.array("start", "stop")).alias("places"))
    counted = again.select("anchor", "seg", F.pandas_udf(_ranges, "array<array<int>>")("places").alias("ranges"))
    # blanks between equal words may differ, so the end is the occurrence's own
    whole = contents.where("n > 1").select("anchor", "seg", F.lit(None).cast("array<array<int>>").alias("ranges"))
    once = contents.where("n = 1").select("anchor", "seg")
    partly = indexed.union(counted).join(once, ["anchor", "seg"], "left_semi")
    ranges = F.coalesce("ranges", F.array(F.array(F.lit(0), F.col("stop") - F.col("start"))))
    marks = hits.join(whole.union(partly), ["anchor", "seg"]).select(
        "id", "th", (F.col("anchor") % 2 == 0).alias("by_bytes"), F.explode(F.transform(ranges, lambda r: F.array(F.col("start") + r[0], F.col("start") + r[1]))).alias("mark")
    )
    of = lambda kind: F.collect_set(F.when(F.col("by_bytes") == kind, F.col("mark")))
    return marks.groupBy("id", "th").agg(of(True).alias("marks"), of(False).alias("passages"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words`` after removal of repeats.

    Each byte that a string of ``length`` bytes covers goes if that string
    also starts elsewhere, in another document or the same one. Strings are
    judged on the input and never cross documents; texts are UTF-8 bytes.
    Passages of ``words`` words that also start elsewhere may have fewer bytes;
    they stay, and ``n_passage_words`` counts the words of the text in them.

    One row comes out per row. Null texts count as empty and keep the digest
    of nothing; repeated rows are repeats of each other; null ids stay; a text
    shorter than ``length`` loses nothing; an empty table gives none; other
    columns are not read.
    """
    marks = repeat_ranges(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(number_of(docs, id_col), F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    kind = keyed.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(marks, ["id", "th"], "left").select("doc_id", "text", "marks", "passages")
    return joined.mapInPandas(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
