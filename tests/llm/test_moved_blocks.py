"""Moved and repeated blocks in line deduplication."""

import random
from collections import Counter

import pytest

from paneloom.llm import linededup


@pytest.mark.parametrize(
    ("a", "b", "kept"),
    [("hPQmPQt", "gPQk", "gk"), ("hPQt", "gPQkPQm", "gkm"), ("PQRS", "gRSkPQm", "gkm"), ("PQPQ", "QPQPPQ", ""), ("hPPPt", "gPPPPPk", "gk")],
)
def test_moved_and_repeated_blocks(a, b, kept):
    gone = set(linededup.common_blocks([ord(x) for x in a], [ord(x) for x in b], [True] * len(b)))
    assert "".join(x for i, x in enumerate(b) if i not in gone) == kept


@pytest.mark.parametrize("seed", range(20))
def test_longest_runs(seed):
    rnd = random.Random(seed)
    a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(30))] for _ in range(2))
    within = lambda run: any(a[i : i + len(run)] == run for i in range(len(a)))
    want = [max(n for n in range(len(b) - j + 1) if n == 0 or within(b[j : j + n])) for j in range(len(b))]
    assert linededup.longest_runs(a, b) == want


def test_no_rare_line_stays(spark):
    """The first document that holds a line keeps it; later ones lose it, whatever the order and number."""
    rnd = random.Random(3)
    pool = [f"line number {i} of many such lines" for i in range(60)]
    rows = [(d, "\n".join([f"only document {d} has this line", *rnd.choices(pool, k=rnd.randrange(1, 12)), "short"])) for d in range(60)]
    holders = Counter(x for _, t in rows for x in set(t.split("\n")))
    seen, want = set(), {}
    for d, t in rows:
        lines = t.split("\n")
        want[d] = [x for x in lines if x not in seen and x != "short"]
        seen |= {x for x in lines if holders[x] <= 30}
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: [x for x in r["text"].split("\n") if x != "short"] for r in got} == want
