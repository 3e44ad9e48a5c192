"""Token ids of whole texts, with a cache of words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stands between words that are encoded in one call, where the vocabulary drops white space.
MARK = "\x01"

#: White space beyond blank and line feed, where a word may depend on its neighbours, the mark, and the start of an added token.
ODD = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + MARK + "]|<\\|")

#: Words that are encoded in one call.
TOGETHER = 512

#: Latin letters and numbers up to U+017F, and what is neither these nor white space nor another printable character
#: there (the capital with a dot is left out: its lower case takes two characters).
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼-¾"
LATIN = "!-~¡-įı-ſ"
NOT_LATIN = re.compile(f"[^{LATIN}]")

#: What both public vocabularies' pre-tokenizers say, and the same for words of such characters; a line feed ends a word.
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_SPLIT = re.compile(f"{SHORT}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\n")
WORD_SPLIT = re.compile(f"{SHORT}|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+|\n")
BYTE_STEPS = [None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]
WORD_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SHORT + "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def blocks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` characters (or one text)."""
    first, size = 0, 0
    for k, n in enumerate(lengths):
        if k > first and size + n > most:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


class Pieces:
    """Ids of words of Latin letters, numbers and signs, from the pieces that the pre-tokenizer cuts them into.

    The library's normalizer and pre-tokenizer take most of the time of a rare
    word. Both do little to such words: ``of`` does the same with one pass over
    all of them, so that the library's model sees only pieces, each once.
    """

    #: Follows the ids of each word.
    END = 0xFFFFFFFF

    @classmethod
    def fitting(cls, path: str, library: Tokenizer, lower: bool | None = None) -> Pieces | None:
        """None where the vocabulary normalizes or cuts words in another way, or not by the steps with (without) ``lower``."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [told["normalizer"], told["pre_tokenizer"]]
        if told["model"].get("type") != "BPE" or steps not in (BYTE_STEPS, WORD_STEPS) or lower not in (None, steps == WORD_STEPS):
            return None
        return cls(library, steps == WORD_STEPS)

    def __init__(self, library: Tokenizer, lower: bool) -> None:
        self.model = library.model
        self.lower = lower
        self.split = WORD_SPLIT if lower else BYTE_SPLIT
        self.spelled = np.zeros(256, "<u2")
        for char, byte in byte_level().items():
            self.spelled[byte] = ord(char)
        self.spelled[ord("\n")] = ord("\n")
        self.forget()

    def forget(self) -> None:
        self.known = {"\n": np.array([self.END], "<u4").tobytes()}

    def _learn(self, new: list[str]) -> list[bytes]:
        spelled = self.spelled[np.frombuffer("\n".join(new).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")
        ids: list[int] = []
        ends = [0]
        for piece in spelled:
            ids += [token.id for token in self.model.tokenize(piece)]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        self.known.update(zip(new, out, strict=True))
        return out

    def of(self, words: list[str], prefix: str) -> bytes:
        """Ids of ``prefix`` and each word, one word after the other, with ``END`` after each."""
        text = prefix + f"\n{prefix}".join(words) + "\n"
        found = self.split.findall(text.lower() if self.lower else text)
        if new := list(set(found).difference(self.known)):
            self._learn(new)
        return b"".join(map(self.known.__getitem__, found))

    def table(self, words: str, line: bytes) -> pa.Array:
        """Ids of words in a row, each with its blank or line feed before it, as bytes. ``line``: those of a line feed."""
        found = pa.array(self.split.findall(words), pa.large_string()).dictionary_encode()
        pieces = found.dictionary.to_pylist()
        ids = list(map(self.known.get, pieces))
        if new := [k for k, known in enumerate(ids) if known is None]:
            for k, learnt in zip(new, self._learn([pieces[k] for k in new]), strict=True):
                ids[k] = learnt
        if "\n" in words:
            ids[pieces.index("\n")] = line
        raw = pa.array(ids, pa.large_binary()).take(found.indices)
        first = pc.match_substring_regex(found.dictionary, "\\A[ \n]").to_numpy(zero_copy_only=False).take(found.indices.to_numpy())
        at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1)
        cuts = np.append(at[:-1][first], at[-1])
        return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), raw.buffers()[2]])


#: Characters of the texts that are encoded in one call, and in one whose words Arrow tells apart.
CHARS, ARROW_CHARS = 2_000_000, 16_000_000

_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words_only: bool = False) -> Encoder:
    """The encoder of this Python worker, which later tasks find warm."""
    if (path, words_only) not in _encoders:
        _encoders[path, words_only] = Encoder(path, words_only)
    return _encoders[path, words_only]


class Encoder:
    """Ids of texts by the tokenizers library, which sees each word once.

    The pre-tokenizers of both public vocabularies never join text across a
    change from a word to white space, so a text's ids are those of its words
    in a row: a word after a blank is encoded with the blank, a word after a
    line feed without it, after the id of the line feed (``words_only``: white
    space has no ids). New words are encoded by the library in one call, with
    marks between them whose id tells them apart, and kept as bytes; Latin
    words are put together from their pieces (see ``Pieces``). Texts with runs
    of white space, unusual white space or an added token's string are encoded
    in one go; a word of theirs shows it. Where white space has ids, Arrow cuts
    the texts and numbers their words, so that only different words are seen
    here, and only pieces and words that are not Latin are kept.
    """

    def __init__(self, path: str, words_only: bool = False, keep: int = 900_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces = Pieces.fitting(path, self.library)
        self.words_only = words_only
        self.keep = keep
        self.mark = MARK if words_only else "\n"
        marked = self.library.encode(self.mark, add_special_tokens=False).ids
        self.simple = len(marked) == 1
        self.mark_id = marked[0] if marked else -1
        self.line = np.array(marked, "<u4").tobytes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        if self.words_only:
            self.known[""] = b""
        else:
            self.odd |= {"", "\n"}
            self.known |= dict.fromkeys(self.odd, b"")
        if self.pieces is not None:
            self.pieces.forget()

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, words: list[str], prefix: str) -> dict[str, bytes]:
        """Ids of ``prefix`` and a word, without those of white space, for each word."""
        known: dict[str, bytes] = {}
        if self.pieces is not None:
            other = list(filter(NOT_LATIN.search, words)) if NOT_LATIN.search("".join(words)) else []
            if other:
                words = list(set(words).difference(other))
            raw = self.pieces.of(words, prefix) if words else b""
            ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == Pieces.END)).tolist()
            known.update(zip(words, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)], strict=True))
            words = other
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        between = f" {self.mark} " if self.words_only else self.mark + prefix
        texts = [prefix + between.join(g) for g in groups]
        for group, found in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(group) - 1:
                raise ValueError("the vocabulary has no id of its own for the mark between words")
            raw, at = ids.tobytes(), 0
            for word, cut in zip(group, [*cuts.tolist(), len(ids)], strict=True):
                known[word] = raw[4 * at : 4 * cut]
                at = cut + 1
        return known

    def _learn(self, new: list[str]) -> None:
        if ODD.search(" ".join(new)):
            odd = set(filter(ODD.search, new))
            self.odd |= odd
            self.known |= dict.fromkeys(odd, b"")
            new = list(set(new) - odd)
        if self.words_only:
            self.known |= self._ids(new, "")
            return
        self.known |= self._ids([w for w in new if w[0] != "\n"], " ")
        firsts = self._ids([w[1:] for w in new if w[0] == "\n"], "")
        self.known |= {"\n" + w: self.line + ids for w, ids in firsts.items()}

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text and an end id 0, in calls of about ``CHARS`` (``ARROW_CHARS``) characters."""
        for i, j in blocks(list(map(len, texts)), CHARS if self.words_only else ARROW_CHARS):
            yield from self.batch(texts[i:j])

    def batch(self, texts: list[str], end: bytes = b"\0\0\0\0") -> list[bytes]:
        """Little-endian 32-bit ids of each text, followed by ``end``."""
        if not self.simple:
            return [self._encode(t) + end for t in texts]
        return self._words_only(texts, end) if self.words_only else self._with_blanks(texts, end)

    def _words_only(self, texts: list[str], end: bytes) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.keep:
            self.forget()
        here = set().union(*split)
        if new := list(here.difference(self.known)):
            self._learn(new)
        known = dict(zip(here, map(self.known.__getitem__, here))).__getitem__  # small, so that it stays near
        odd = here & self.odd
        out: list[bytes] = []
        for text, words in zip(texts, split, strict=True):
            if odd and not odd.isdisjoint(words):
                out.append(self._encode(text) + end)
            else:
                out.append(b"".join(map(known, words)) + end)
        return out

    def _with_blanks(self, texts: list[str], end: bytes) -> list[bytes]:
        if max(len(self.known), len(self.pieces.known) if self.pieces is not None else 0) > self.keep:
            self.forget()
        kind = pa.large_string()
        # a word after a line feed, and the first one, keep a line feed
        lines = pc.replace_substring(pa.array(texts, kind), "\n", " \n")
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", kind), lines, pa.scalar("", kind)), " ")
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        if self.pieces is None:
            latin = np.zeros(len(words), bool)
        else:
            known = pc.match_substring_regex(words, f"\\A\\n?[{LATIN}]+\\z")
            latin = pc.and_not(known, pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        parts = []
        if latin.any():
            plain = words.filter(pa.array(latin))
            blank = pc.if_else(pc.starts_with(plain, "\n"), pa.scalar("", kind), pa.scalar(" ", kind))
            plain = pc.binary_join_element_wise(blank, plain, pa.scalar("", kind))
            parts.append(self.pieces.table(pc.binary_join(pa.LargeListArray.from_arrays([0, len(plain)], plain), pa.scalar("", kind))[0].as_py(), self.line))
        others = words.filter(pa.array(~latin)).to_pylist()
        if new := list(set(others).difference(self.known)):
            self._learn(new)
        parts.append(pa.array(list(map(self.known.__getitem__, others)), pa.large_binary()))
        place = np.empty(len(words), np.int64)
        place[latin] = np.arange(len(words) - len(others))
        place[~latin] = np.arange(len(words) - len(others), len(words))
        ids = pa.concat_arrays(parts).take(pa.array(place.take(codes)))
        cuts = split.offsets.to_numpy()
        odd = set()
        if not self.odd.isdisjoint(others):
            shows = np.zeros(len(words), bool)
            shows[~latin] = [w in self.odd for w in others]
            odd = set((np.searchsorted(cuts, np.flatnonzero(shows.take(codes)), "right") - 1).tolist())
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[cuts].tolist()
        raw, first = memoryview(ids.buffers()[2] or b""), len(self.line)
        return [self._encode(texts[k]) + end if k in odd else bytes(raw[at[k] + first : at[k + 1]]) + end for k in range(len(texts))]
