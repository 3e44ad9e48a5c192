"""Mixing against a plain water level and sequential cuts."""

import hashlib
import re
from fractions import Fraction

import pytest

from paneloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, most=2):
    """Targets by repeated sharing: full sources leave, the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
        left, open_ = left - sum(out[s] for s in full), open_ - full
    return out


def brute_mix(rows, weights=(5, 2, 1), seed=7):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, size):
        sizes[s] = sizes.get(s, 0) + n
    goal, out = brute_targets(sizes, weights), []
    for s in sizes:
        mine = [(hashlib.md5(f"{seed}|{'' if d is None else d}|{t or ''}".encode()).hexdigest(), n, d) for (d, t, x), n in zip(rows, size) if x == s]
        budget = int(goal[s])
        taken = [0] * len(mine)
        mine.sort(key=lambda r: r[:2])
        while budget > 0 and sizes[s]:
            for k, (_, n, _) in enumerate(mine):
                take = min(n, budget)
                taken[k], budget = taken[k] + take, budget - take
        out += [(str(d), str(s), n, sizes[s], float(goal[s]), t) for (_, n, d), t in zip(mine, taken)]
    return sorted(out)


def test_mix(any_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in any_docs.collect()]
    got = sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(any_docs).collect())
    assert got == brute_mix(rows)
    assert all(t <= 2 * n for _, _, n, _, _, t in got)


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 9)])
def test_targets(spark, weights):
    sizes = {None: 40, "a": 0, "b": 1, "c": 1000, "d": 7, "é": 33, "z": 12, "Z": 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["top"] / r["bottom"] for r in mixing.targets(df, weights).collect()}
    assert got == pytest.approx({s: float(t) for s, t in brute_targets(sizes, weights).items()}, rel=1e-12)


def test_partitions_do_not_matter(sf_docs):
    once, again = (sorted(map(tuple, mixing.mix(d).collect())) for d in (sf_docs, sf_docs.repartition(13)))
    assert once == again


def test_budget_is_met(sf_docs):
    per = {}
    for r in mixing.mix(sf_docs).collect():
        per.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(sum(taken) == int(target) for (_, target), taken in per.items())


def test_text_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "one two three", "s", 1), ("b", "four", "t", 2), (None, None, None, 3)], "doc_id string, text string, source string, size int")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(df).collect()}
    assert got.keys() == {"a", "b", None} and got[None] == (0, 0) and got["a"] == (3, 4) and got["b"] == (1, 1)
