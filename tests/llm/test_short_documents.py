"""Decontamination of documents that are shorter than an item."""

import random
from collections import Counter

from test_pairs import PLAIN, brute_leaks, leaks, same

from paneloom.llm import decontaminate


def brute_short(docs, items, k=5, least=0.8):
    """Leaks of documents with fewer words than the item: one window, all words."""
    out = {}
    for d, text in docs:
        words = PLAIN.findall(text.lower())
        for i, item in items:
            mine = PLAIN.findall(item.lower())
            n = min(k, len(mine))
            if n <= len(words) < len(mine):
                x, y = (Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for w in (words, mine))
                common = sum((x & y).values())
                if (sim := common / (x.total() + y.total() - common)) >= least:
                    out[d, i] = (sim, 0)
    return out


def test_short_documents(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.choice([6, 20, 60, 90])))) for i in range(10)]
    docs = []
    for d in range(90):
        item = items[d % 10][1].split()
        start, end = rnd.randrange(1 + len(item) // 25), len(item) - rnd.randrange(1 + len(item) // 25)
        docs.append((d, " ".join(item[start:end])))
    docs += [(200, " ".join(items[2][1].split()[:3])), (201, "w1")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    short = brute_short(docs, items)
    assert len(short) > 10 and same(leaks(got), brute_leaks(docs, items) | short)
    words = {d: len(t.split()) for d, t in docs}
    assert all(r["n_words"] == words[r["doc_id"]] for r in got.collect() if (r["doc_id"], r["item_id"]) in short)
