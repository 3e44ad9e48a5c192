from collections import Counter

import numpy as np
import pytest

from paneloom.llm import repair


@pytest.mark.parametrize("seed", range(4))
def test_narrow_and_wide_symbols_give_one_grammar(seed):
    """Symbols beyond 16 bits are sorted another way; the grammar is the same, gives the ids back and leaves no frequent pair."""
    rnd = np.random.default_rng(seed)
    words = [rnd.integers(0, 40, rnd.integers(1, 6)) for _ in range(30)]
    ids = np.concatenate([words[k] for k in rnd.zipf(1.5, 3000) % 30] + [np.full(50, 7)]).astype(np.uint32)
    narrow, wide = repair.compress(ids, 50, 4), repair.compress(ids, 1 << 16, 4)
    assert len(narrow[1])
    shift = lambda x: np.where(x >= 50, x - 50 + (1 << 16), x)
    assert np.array_equal(shift(narrow[0]), wide[0]) and np.array_equal(shift(narrow[1]), wide[1])
    seq, rules = narrow
    grammar = repair.Grammar(seq.astype(np.int64), rules, repair.rule_lengths(rules, 50), 50)
    assert np.array_equal(grammar.ids(0, len(ids)), ids)
    pairs = Counter((a, b) for a, b in zip(seq.tolist(), seq[1:].tolist()) if a != b)
    assert max(pairs.values()) < 4


def test_symbols_that_outgrow_16_bits():
    ids = np.tile(np.arange(400, dtype=np.uint32), 50)
    terminals = (1 << 16) - 100
    seq, rules = repair.compress(ids, terminals, 3)
    assert len(rules) > 100
    grammar = repair.Grammar(seq.astype(np.int64), rules, repair.rule_lengths(rules, terminals), terminals)
    assert np.array_equal(grammar.ids(0, len(ids)), ids)


@pytest.mark.parametrize("terminals", [50_000, 1 << 17])
def test_pairs_that_share_a_hashed_place(terminals):
    """Pairs that are frequent only together make no rule; one that is frequent alone makes one."""
    place = lambda a, b: (a * 0x9E3B1 + b) & 0xFFFFF
    other = next(a for a in range(2, terminals) if place(a, 0) - place(1, 2000) & 0xFFFFF > 0xFFFFF - 2000)
    alike = (2000 + place(1, 0) - place(other, 0)) & 0xFFFFF
    assert alike < terminals and place(other, alike) == place(1, 2000)
    apart = iter(range(3000, 12000))
    rows = lambda a, b, n: [x for _ in range(n) for x in (a, b, next(apart))]
    rare = np.array(rows(1, 2000, 9) + rows(other, alike, 9), np.uint32)
    assert len(repair.compress(rare, terminals, 10)[1]) == 0
    often = np.array(rows(1, 2000, 10) + rows(other, alike, 9), np.uint32)
    seq, rules = repair.compress(often, terminals, 10)
    assert rules.tolist() == [[1, 2000]]
    assert repair.Grammar(seq.astype(np.int64), rules, repair.rule_lengths(rules, terminals), terminals).ids(0, len(often)).tolist() == often.tolist()
