import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from paneloom.llm.tokens import NOT_LATIN, Encoder, Pieces, blocks

ODD = ["", " ", "\n", "a", " a", "a ", "a\n", "a  b", "a\n\nb", "a \nb", "a\n b", "don't won't 'll", "a\tb", "a\x1cb", "<|endoftext|>", "x\x01y", "Ünḯ ẞ Σας", "1234 5,6", "a b", "a　b"]


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_same_ids(name, words):
    rnd = random.Random(3)
    letters = "abcXYZéßñç'.,!#$ \n\n   0123́\t"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["\n".join(" ".join(rnd.choice(ODD[3:4] + ["b,", "'s", "été.", "42", "a-b"]) for _ in range(5)) for _ in range(3)) for _ in range(300)]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    mine = Encoder(public_tokenizers.path(name), words, keep=500)
    for k in range(0, len(texts), 100):
        for t, ids in zip(texts[k : k + 100], mine.batch(texts[k : k + 100], b""), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert [int.from_bytes(ids[j : j + 4], "little") for j in range(0, len(ids), 4)] == want, repr(t)


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_latin_words_come_from_their_pieces(name, words):
    """Words of each Latin character give the library's ids, without a call of its normalizer and pre-tokenizer."""
    path = public_tokenizers.path(name)
    library, mine = Tokenizer.from_file(path), Encoder(path, words)
    chars = [c for c in map(chr, range(0x21, 0x180)) if not NOT_LATIN.search(c)]
    assert len(chars) > 300
    texts = [f"{c} a{c}b {c}{c} 1{c}2\n{c}'s don't{c} {c}'LL" for c in chars]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]

    class NoLibrary:
        def encode_batch_fast(self, texts, add_special_tokens):
            assert not texts
            return []

    mine.library = NoLibrary()
    found = mine.batch(texts, b"")
    for t, ids, w in zip(texts, found, want, strict=True):
        assert [int.from_bytes(ids[j : j + 4], "little") for j in range(0, len(ids), 4)] == w, repr(t)


def test_only_words_that_are_not_latin_are_kept():
    """Words of one call are told apart by Arrow; texts that need the library as a whole may stand between others."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), Encoder(path)
    texts = ["été a-b\n'sword a-b", "a  b", "Σας été Σας\nΣας", "", "été <|endoftext|> x", "été", "été", "\nété", "x\ty a-b", "z"]
    found = mine.batch(texts, b"")
    assert len(found) == len(texts)
    for t, ids in zip(texts, found, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert [int.from_bytes(ids[j : j + 4], "little") for j in range(0, len(ids), 4)] == want, repr(t)
    assert {w for w in mine.known if w not in mine.odd} == {"Σας", "\nΣας"}
    assert list(mine.each([])) == []
    assert mine.batch([""], b"..") == [b".."]


def test_other_vocabularies_have_no_pieces(tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    library.save(str(tmp_path / "other.json"))
    assert Pieces.fitting(str(tmp_path / "other.json"), library) is None


def test_blocks_of_characters():
    assert list(blocks([5, 5, 1, 30, 0, 2], 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(blocks([], 10)) == []
