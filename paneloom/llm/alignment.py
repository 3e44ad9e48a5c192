"""Alignment of two tokenizers over a corpus: inverted pair bitmaps with multiplicity planes.

Texts are cut into units that both tokenizers treat alone, so each different
unit is encoded and aligned once per worker. A task gathers its documents in
chunks of at most 65,536; per chunk and id pair it writes one bitmap of the
documents that hold the pair linked, and bit planes of how often more than once.
Bitmaps are counted over the corpus, and as postings they bring each pair's
count back to its documents.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import ship
from paneloom.llm.tokens import NOT_LATIN, Pieces, blocks, byte_level
from paneloom.operators.verbs import attach, lookup
from paneloom.session import cut_lineage

#: Documents of a chunk at most, so that a document's place takes 16 bits; and a bitmap's bytes.
CHUNK, BITSET = 1 << 16, 1 << 13

#: A blank or line feed between two characters that are no white space: both tokenizers part there.
CUT = re.compile(r"(?<=\S)([ \n])(?=\S)")

#: White space; and all of it but blank and line feed.
WHITE = re.compile(r"\s")
ODD = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")

#: Units that are encoded in one call.
AT_ONCE = 4096


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: ``<0xHH>`` is byte HH, U+2581 a blank."""
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def pack(slots: np.ndarray) -> bytes:
    """A compressed bitmap of sorted document places: 16-bit numbers while they are shorter, else one bit a document."""
    if 2 * len(slots) < BITSET:
        return slots.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < BITSET:
        return np.frombuffer(bitmap, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def _group_sums(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``, empty ones included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


class Aligner:
    """Units of text with their ids and links, of one Python worker."""

    def __init__(self, path_a: str, path_b: str, keep: int = 180_000, keep_pieces: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.pieces = Pieces.fitting(path_a, self.a, lower=False)
        self.line = self.a.encode("\n", add_special_tokens=False).ids[0] if self.pieces else -1
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars, vocab = byte_level(), self.a.get_vocab()
        self.size_b = self.b.get_piece_size()
        # ids with what follows them: next id, bar to B, next group, next unit
        self.marked = [f"{i}{mark}" for i in range(max(max(vocab.values()) + 1, self.size_b)) for mark in ",|;\n"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes([chars[c] for c in token]) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = list(map(piece_bytes, pieces))
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # a piece across a cut would tie two units together
        self.parts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.keep, self.keep_pieces = keep, keep_pieces
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)  # ids of a, ids of b, groups, whether the bytes agree
        self.first = np.zeros(1, np.int64)
        self.pairs = np.empty(0, np.int64)

    def units(self, text: str) -> list[str]:
        """A bare word stands for the word after a blank, as does the first one, which both put a blank before.

        One that begins with a line feed follows it; one that begins with a
        blank holds white space of any kind.
        """
        if not self.parts:
            return [" " + text]
        plain = text[0] not in " \n" and text[-1] not in " \n" and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
        if plain and not ODD.search(text):
            out: list[str] = []
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    words[0] = "\n" + words[0]
                out += words
            return out
        cut = CUT.split(text)
        return [" " + cut[0], *[w if sep == " " and not WHITE.search(w) else sep + w for sep, w in zip(cut[1::2], cut[2::2])]]

    def _ids_a(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units in another order, the ids of A of all of them in a row, and how many each has.

        Latin units come from their pieces, as bare words or after a line feed.
        """
        plain: list[str] = []
        lines: list[str] = []
        other: list[str] = []
        if self.pieces is None:
            other = new
        elif NOT_LATIN.search("".join(new)):
            for u in new:
                line = u[0] == "\n"
                (other if NOT_LATIN.search(u, line) else lines if line else plain).append(u)
        else:
            plain = new
        parts, sizes = [], []
        for units, prefix in ((plain, " "), ([u[1:] for u in lines], "")):
            if units:
                ids = np.frombuffer(self.pieces.of(units, prefix), "<u4").astype(np.int64)
                ends = np.flatnonzero(ids == self.pieces.END)
                n = np.diff(ends, prepend=-1) - 1
                if units is not plain:  # the line feed is a piece before
                    ids[ends] = self.line
                    ids, n = np.concatenate(([self.line], ids[:-1])), n + 1
                else:
                    ids = np.delete(ids, ends)
                parts.append(ids)
                sizes.append(n)
        for k in range(0, len(other), AT_ONCE):
            found = [e.ids for e in self.a.encode_batch_fast([u if u[0] in " \n" else " " + u for u in other[k : k + AT_ONCE]], add_special_tokens=False)]
            parts.append(np.fromiter(chain.from_iterable(found), np.int64))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        return plain + lines + other, np.concatenate(parts), np.concatenate(sizes)

    def _ids_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B of all texts in a row, and how many each has."""
        found: list[list[int]] = []
        for k in range(0, len(texts), AT_ONCE):
            # the library puts the blank itself; before a line feed it is no part of the unit
            found += self.b.encode([u[1:] if u[0] == " " else u for u in texts[k : k + AT_ONCE]], num_threads=1)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        cut = np.fromiter((u[0] != " " for u in texts), bool, len(texts)) & (n > 0)
        return np.delete(flat, (np.cumsum(n) - n)[cut]), n - cut

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns units that are not known yet.

        The good units are laid end to end. Ends of either tokenizer part the
        bytes into stretches; each stretch lies in one token of both, and is
        one link. Ends of both part the groups.
        """
        new, flat_a, n_a = self._ids_a(new)
        texts = [u if u[0] in " \n" else " " + u for u in new]
        flat_b, n_b = self._ids_b(texts)
        want = "".join(texts).encode()
        ends_of_want = np.cumsum(np.fromiter(map(len, map(str.encode, texts)), np.int64, len(texts)))
        spelled = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))]
        ends = [np.concatenate(([0], np.cumsum(length[ids])))[np.cumsum(n)] for length, ids, n in ((self.length_a, flat_a, n_a), (self.length_b, flat_b, n_b))]
        good = np.ones(len(new), bool)
        if not all(x == want and np.array_equal(e, ends_of_want) for x, e in zip(spelled, ends, strict=True)):
            # not all units come back byte for byte
            cut = lambda raw, ends: [raw[i:j] for i, j in zip([0, *ends], ends)]
            each = [cut(raw, e.tolist()) for raw, e in zip([want, *spelled], [ends_of_want, *ends], strict=True)]
            good = np.array([w == x == y for w, x, y in zip(*each, strict=True)])
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = np.diff(ends, append=-1) == 0
        both, stretch = ends[twice], ends[~twice]
        pairs = flat_a[np.searchsorted(ends_a, stretch)] * self.size_b + flat_b[np.searchsorted(ends_b, stretch)]
        unit_ends = np.cumsum(np.diff(ends_of_want, prepend=0) * good)
        links, groups = (np.diff(np.searchsorted(x, unit_ends, "right"), prepend=0) for x in (stretch, both))
        said = self._say(flat_a, ends_a, flat_b, ends_b, both, unit_ends)
        self.index.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        if good.all():
            self.groups += said
        else:
            spoken = iter(said)
            self.groups += [next(spoken) if ok else "" for ok in good.tolist()]
        counts = np.column_stack([n_a, n_b, groups, good]).astype(np.int64).reshape(-1, 4)
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, pairs])

    def _say(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, both: np.ndarray, unit_ends: np.ndarray) -> list[str]:
        """The groups of each unit as text, built in one go: every id is followed by the mark that its place asks for."""
        last_a, last_b = np.isin(ends_a, both, assume_unique=True), np.isin(ends_b, both, assume_unique=True)
        unit_b = np.isin(ends_b, unit_ends)
        marked = np.concatenate([4 * a + last_a, 4 * b + np.where(unit_b, 3, 2 * last_b)])
        # by group, then A before B, then in order
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        return "".join(map(self.marked.__getitem__, marked[order].tolist())).split("\n")[:-1]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text (ids of a, ids of b, groups, links) and the checksum of its groups; and postings: (pair, text) and links of it.

        A posting is ``pair * CHUNK + place of the text``, sorted.
        """
        if len(self.index) > self.keep:
            self.forget()
        if self.pieces is not None and len(self.pieces.known) > self.keep_pieces:
            self.pieces.forget()
        split = [self.units(t) if t else [] for t in texts]
        flat_units = list(chain.from_iterable(split))
        here = set(flat_units)
        if new := list(here.difference(self.index)):
            self.learn(new)
        known = dict(zip(here, map(self.index.__getitem__, here)))  # small, so that it stays near
        at = np.concatenate(([0], np.cumsum(list(map(len, split)), dtype=np.int64)))
        flat = np.fromiter(map(known.__getitem__, flat_units), np.int64, len(flat_units))
        del known, here, flat_units
        found = np.stack([_group_sums(at, self.counts[flat, k]) for k in range(4)], axis=1)
        fits = (found[:, 3] == np.diff(at)) & (np.diff(at) > 0)
        sums = []
        for ok, i, j in zip(fits.tolist(), at.tolist(), at[1:].tolist()):
            sums.append(sha256(";".join(map(self.groups.__getitem__, flat[i:j].tolist())).encode()).hexdigest() if ok else "")
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        inside = fits[owner]
        inside = np.sort(owner[inside] * len(self.groups) + flat[inside])
        starts = np.flatnonzero(np.diff(inside, prepend=-1))
        held, times = inside[starts], np.diff(starts, append=len(inside))
        owner, unit = np.divmod(held, max(len(self.groups), 1))
        size = (self.first[unit + 1] - self.first[unit]).astype(np.int64)
        start = np.repeat(self.first[unit] - np.cumsum(size) + size, size)
        keys = self.pairs[start + np.arange(int(size.sum()))] * CHUNK + np.repeat(owner, size)
        links = np.bincount(owner, size * times, len(texts)).astype(np.int64)
        out = np.column_stack([found[:, :3] * fits[:, None], links])
        return out, sums, *_merged(keys, np.repeat(times, size))


def _merged(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sum of their links."""
    order = np.argsort(keys, kind="stable")
    keys, links = keys[order], links[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[firsts], np.add.reduceat(links, firsts) if len(firsts) else links


_aligners: dict[tuple[str, str], Aligner] = {}


def _bitmaps(keys: np.ndarray, links: np.ndarray, size_b: int) -> dict[str, np.ndarray | list[bytes]]:
    """Bitmaps of a chunk's postings: plane 0 says that a pair is linked, plane k holds bit k - 1 of how often more."""
    more = links - 1
    cols: dict[str, list[np.ndarray]] = {"a": [], "b": [], "plane": [], "n": []}
    bitmaps: list[bytes] = []
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        held = keys if plane == 0 else keys[(more >> (plane - 1)) & 1 > 0]
        pair, slots = np.divmod(held, CHUNK)
        cuts = np.flatnonzero(np.diff(pair, prepend=-1, append=-1))
        first, n = pair[cuts[:-1]], np.diff(cuts)
        for name, col in (("a", first // size_b), ("b", first % size_b), ("plane", np.full(len(n), plane)), ("n", n)):
            cols[name].append(col)
        raw = slots.astype("<u2").tobytes()
        bitmaps += [raw[2 * i : 2 * j] if 2 * (j - i) < BITSET else pack(slots[i:j]) for i, j in zip(cuts.tolist(), cuts[1:].tolist())]
    return {name: np.concatenate(col) for name, col in cols.items()} | {"bitmap": bitmaps}


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _index(path_a: str, path_b: str, chunk_docs: int, postings: int, chars: int):
    """Documents with their place (chunk, slot) and counts, and after each chunk its bitmaps; one stream of rows."""

    def table(kind: pa.DataType, n: int, known: dict) -> pa.RecordBatch:
        fields = [("chunk", pa.int64()), ("slot", pa.int32()), ("doc_id", kind), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())]
        fields += [*[(c, pa.int32()) for c in ("a", "b", "plane")], ("n", pa.int64()), ("bitmap", pa.binary())]
        arrays = [pa.array(known[name], of) if name in known else pa.nulls(n, of) for name, of in fields]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        chunk, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            keys, links = map(np.concatenate, zip(*held))
            held.clear()
            cols = _bitmaps(*_merged(keys, links), aligner.size_b)
            return table(kind, len(cols["bitmap"]), cols | {"chunk": np.full(len(cols["bitmap"]), chunk)})

        for batch in batches:
            texts, kind = batch.column("text"), batch.column("doc_id").type
            for i, j in blocks(pc.utf8_length(texts).to_pylist(), chars):
                for k in range(i, j, chunk_docs):
                    part = texts.slice(k, min(chunk_docs, j - k)).to_pylist()
                    if held and (used + len(part) > chunk_docs or sum(len(x) for x, _ in held) > postings):
                        yield closed()
                        chunk, used = chunk + 1, 0
                    counts, sums, keys, links = aligner.align(part)
                    known = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts.T)) | {"groups_sha256": sums, "doc_id": batch.column("doc_id").slice(k, len(part))}
                    yield table(kind, len(part), known | {"chunk": np.full(len(part), chunk), "slot": np.arange(used, used + len(part))})
                    held.append((keys + used, links))
                    used += len(part)
        if held:
            yield closed()
        # an idle worker keeps the vocabularies only
        aligner.forget()
        if aligner.pieces is not None:
            aligner.pieces.forget()
        _give_back()

    return run


def _scores(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of each document of a chunk, from the bitmaps of its pairs."""
    slots = [unpack(b) for b in group["bitmap"]]
    n = list(map(len, slots))
    at = np.concatenate(slots)
    weight = np.where(group["plane"] > 0, 1 << np.maximum(group["plane"].to_numpy() - 1, 0), 1)
    out = {"slot": np.unique(at)}
    for name, value in (("n_best", group["best"].to_numpy(np.int64)), ("count_sum", group["docs"].to_numpy(np.int64))):
        total = np.zeros(CHUNK, np.int64)
        np.add.at(total, at, np.repeat(weight * value, n))
        out[name] = total[out["slot"]]
    return pd.DataFrame(out).assign(chunk=group["chunk"].iloc[0])


def pair_index(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = CHUNK, postings: int = 400_000, chars: int = 300_000
) -> tuple[DataFrame, DataFrame]:
    """The documents' counts (chunk, slot, doc_id, ...) and the inverted index (chunk, a, b, plane, n, bitmap).

    Both come from one written table, so a chunk's places are fixed. A chunk
    ends at ``chunk_docs`` documents, or at the first block of about ``chars``
    characters after ``postings`` postings.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, slot int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, plane int, n long, bitmap binary"
    rows = cut_lineage(base.mapInArrow(_index(path_a, path_b, min(chunk_docs, CHUNK), postings, chars), schema))
    return rows.where("slot IS NOT NULL").drop("a", "b", "plane", "n", "bitmap"), rows.where("slot IS NULL").select("chunk", "a", "b", "plane", "n", "bitmap")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, docs, links, best: documents and links of each pair; best says that no other pair of a is in more documents."""
    weight = F.expr("CASE WHEN plane > 0 THEN shiftleft(1L, plane - 1) ELSE 1L END")
    pairs = index.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), F.sum(weight * F.col("n")).alias("links"))
    pairs = cut_lineage(pairs)
    highest = pairs.groupBy("a").agg(F.max("docs").alias("__most"))
    return attach(pairs, highest, ["a"]).selectExpr("a", "b", "docs", "links", "docs = __most AS best")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: two tokenizers' ids of each text, aligned.

    A is a byte-level vocabulary of the tokenizers library and encodes the text
    after a blank; B is a sentencepiece model, which puts that blank itself.
    Strings of special tokens are plain text. Byte offsets where tokens of both
    end part them into groups; a link is a pair of tokens whose bytes overlap.
    A pair's count is the number of documents that hold it linked; n_best
    counts the links whose pair has the highest count of its A id (ties
    included), count_sum sums the counts of all links.

    Null and empty texts, and texts that either vocabulary does not give back
    byte for byte, have no tokens: zeros and an empty checksum. One row comes
    out per row, repeated rows and null ids included, and each row counts as a
    document; an empty table gives no rows; other columns are not read.

    Only bitmaps of a chunk's pairs and sums per document are shuffled. The
    rows of a pair are one per chunk and plane, so no pair is a hot key.
    """
    found, index = pair_index(docs, path_a, path_b, id_col, text_col, **limits)
    scored = lookup(index, cut_lineage(pair_counts(index)), ["a", "b"], ["docs", "best"], how="inner")
    sums = scored.select("chunk", "plane", "bitmap", "docs", "best").groupBy("chunk").applyInPandas(_scores, "slot int, n_best long, count_sum long, chunk long")
    out = lookup(found, sums, ["chunk", "slot"], ["n_best", "count_sum"])
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return out.select(*kept, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
