"""Row-wise operators against brute force: quality, personal data, tokens, packing, shards."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paneloom.llm import packing, pii, quality, repair, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def texts(docs):
    return sorted(({"doc_id": r["doc_id"], "text": r["text"] or ""} for r in docs.collect()), key=key)


def brute_quality(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "base_failed": len(words) < 50 or 100 * len(again) > 50 * len(words),
    }


def test_quality_base(any_docs):
    got = sorted(rows_of(quality.quality(any_docs)), key=key)
    for r, d in zip(got, texts(any_docs), strict=True):
        want = brute_quality(d["text"])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert r["kept"] in ((False,) if want["base_failed"] else (False, True))


def test_quality_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.execute(entry.oracle_sql()["op1_quality_rules"]).df()
    got = entry.queries()["op1_quality_rules"](spark, folder).toPandas()
    assert set(got.columns) == set(want.columns)
    names = list(want.columns)
    assert got.sort_values("doc_id")[names].values.tolist() == want.sort_values("doc_id")[names].values.tolist()


def test_quality_lines(spark):
    clean = "A plain sentence of some words, and it ends.\n" * 1 + " ".join(f"word{i}" for i in range(60)) + "."
    nav = "home | news | sport | about | contact"
    junk = " ".join(f"w{i}###" for i in range(60))
    docs = spark.createDataFrame([(1, clean + "\n" + nav), (2, clean + "\n" + junk), (3, clean + "\nAll rights reserved.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert got[1]["cleaned"] == clean and got[1]["kept"] and got[1]["n_failed_lines"] == 1
    assert not got[2]["kept"] and got[2]["cleaned"] == clean
    assert got[3]["cleaned"] == clean and got[3]["kept"]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= sum(c.isdigit() for c in m.group()) <= 19 and luhn(m.group()):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


HARD = [
    "a@b.c@d.e.f x@@y.z q@r @a.b a.b-c%d+e@x-y.z..w a@b.c.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.3.0004 999.9.9.9.1.1.1.1 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 0000000000000 12-",
    "+1 (555) 010-9999. +1.2 +12 +123456789012345678 +1 (098) 555-0174 as +4-4-4-4-4-4-4-4-4 ++1234567890",
    "é+33 1 23 45 67 89 1.1.1.1x5.5.5.5 tél: +49-30-1234567-",
    "iban DE89 3704 0044 0532 0130 00. Account no: 1234-5678-90; ftp://bob:pw@host.example/x 12 Long Oak Street, Hauptstraße 5",
]


def test_pii_base(spark, any_docs):
    hard = spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for docs in (any_docs, hard):
        got = sorted(rows_of(pii.personal_data(docs)), key=key)
        for r, d in zip(got, texts(docs), strict=True):
            want = brute_base(d["text"])
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (d["text"][:200], r["spans"], said)
            assert Counter(k for k, _, _ in want) == Counter({k: r[f"n_{k}"] for k in pii.BASE_KINDS if r[f"n_{k}"]})
            assert set(filter(None, said.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_pii_more_kinds():
    spans = pii.find_spans(HARD[-1], pii._automaton())
    found = {k: HARD[-1][a:b] for k, a, b in spans}
    assert found["url_login"] == "ftp://bob:pw@host.example/x"
    assert "DE89 3704 0044 0532 0130 00" in [HARD[-1][a:b] for k, a, b in spans if k == "account"]
    assert {"12 Long Oak Street", "Hauptstraße 5"} <= {HARD[-1][a:b] for k, a, b in spans if k == "address"}


def encoded(docs, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(d["doc_id"], [*t.encode(d["text"], add_special_tokens=False).ids, 0]) for d in texts(docs)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(any_docs):
    got = rows_of(repair.token_round_trip(any_docs, public_tokenizers.path("byte_bpe_50k.json"), block_ids=5000, least=4))
    got.sort(key=lambda r: r["start"])
    at, want = 0, []
    for doc_id, ids in encoded(any_docs, "byte_bpe_50k.json"):
        want.append({"doc_id": doc_id, "start": at, "n_tokens": len(ids), "ids_crc32": crc(ids)})
        at += len(ids)
    assert got == want


def test_repair_random_access():
    rnd = np.random.default_rng(3)
    ids = np.tile(rnd.integers(0, 50, 40), 100)
    ids[rnd.integers(0, len(ids), 200)] = 999
    seq, rules = repair.compress(ids, 1000, 2)
    assert len(seq) < len(ids) / 3
    g = repair.Grammar(seq.astype(np.int64), rules, repair.rule_lengths(rules, 1000), 1000)
    assert (g.ids(0, len(ids)) == ids).all()
    for a, b in ((0, 1), (17, 17), (5, 900), (len(ids) - 3, len(ids))):
        assert (g.ids(a, b) == ids[a:b]).all()
    assert repair.compress(np.zeros(1, np.int64), 10, 2)[0].tolist() == [0]


def plain_repair(ids, terminals, least):
    """Re-Pair by counting anew before each rule; pairs in a run count from the left."""
    seq, rules = list(ids), []
    while True:
        places, last = defaultdict(list), {}
        for i, pair in enumerate(zip(seq, seq[1:])):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                places[pair].append(i)
                last[pair] = i
        most = max(map(len, places.values()), default=0)
        if most < least:
            return seq, rules, most
        pair = min(p for p, at in places.items() if len(at) == most)
        taken, out, i = set(places[pair]), [], 0
        while i < len(seq):
            out.append(terminals + len(rules) if i in taken else seq[i])
            i += 2 if i in taken else 1
        seq, rules = out, [*rules, pair]


def test_repair_to_the_end():
    """No pair is left that occurs often enough; sizes are those of counting anew before each rule."""
    for seed in range(30):
        rnd = np.random.default_rng(seed)
        ids = rnd.integers(0, rnd.integers(1, 6), rnd.integers(2, 400))
        ids = np.concatenate([ids, np.tile(ids[:20], rnd.integers(0, 10))])
        least = int(rnd.integers(2, 6))
        seq, rules = repair.compress(ids, 10, least)
        want, known, _ = plain_repair(ids.tolist(), 10, least)
        assert plain_repair(seq.tolist(), 10 + len(rules), least)[2] < least
        assert abs(len(seq) - len(want)) <= 0.15 * len(want) + 4
        g = repair.Grammar(seq.astype(np.int64), rules, repair.rule_lengths(rules, 10), 10)
        assert (g.ids(0, len(ids)) == ids).all()
    copies = np.tile(np.arange(500), 2000)
    assert len(repair.compress(copies, 500, 64)[0]) < 200


def test_packing(any_docs):
    for cap in (2048, 97):
        got = rows_of(packing.pack(any_docs, public_tokenizers.path("word_bpe_49k.json"), capacity=cap))
        want = Counter()
        for doc_id, ids in encoded(any_docs, "word_bpe_49k.json"):
            for k, a in enumerate(range(0, len(ids), cap)):
                want[doc_id, k, a, len(ids[a : a + cap]), crc(ids[a : a + cap])] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= cap
        total = sum(r["length"] for r in got)
        assert len(bins) <= -(-total // cap) * 1.25 + 1


def test_fullest():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        room = int(rnd.integers(5, 60))
        free = [(int(k), int(rnd.integers(1, 4))) for k in sorted(set(rnd.integers(2, 30, 5)), reverse=True)]
        sums = {0}
        for k, n in free:
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        chosen = packing.fullest(room, free)
        assert sum(k * n for k, n in chosen) == max(sums)
        assert all(n <= dict(free)[k] for k, n in chosen)


def test_shards(any_docs):
    got = rows_of(sharding.shard(any_docs, shards=7))
    want = Counter((d["doc_id"], len(d["text"].encode()) + 16, zlib.crc32(d["text"].encode())) for d in texts(any_docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert 0 <= r["shard"] < 7 and r["law"] == "bytes" and r["grown_shard"] is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if len(got) > 100:
        mean, largest = sum(sizes.values()) / 7, max(r["size"] for r in got)
        assert max(sizes.values()) <= mean * 1.02 + largest and min(sizes.values()) >= mean * 0.98 - largest


def test_shard_groups(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot text' else concat('t', id div 2) end as text")
    got = rows_of(sharding.shard(docs, shards=5, whole_group_share=0.05))
    sizes, homes = Counter(), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 100
    assert sorted(map(len, homes.values()))[:-1] == [1] * (len(homes) - 1)  # only the hot group is divided


def test_toxicity(spark, edge_docs, empty_docs):
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        body = [words[(i * 7 + k * 13) % 200] for k in range(40)]
        toxic = i % 5 == 0
        if toxic:
            body[i % 40] = ("scoundrel", "wretchish", "wretchful")[i % 3]
        rows.append((i, " ".join(body) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert all(got[i]["predicted"] == truth[i] and got[i]["predicted"] == int(got[i]["score"] >= 0.7) for i in held)
    grammar = toxicity.fit_grammar(docs, marks)
    assert len(toxicity.scores(edge_docs, grammar).collect()) == edge_docs.count()
    assert toxicity.toxicity(empty_docs, marks).count() == 0
    alone = toxicity.toxicity(edge_docs, marks.where("false")).collect()
    assert len(alone) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in alone)


def test_clause_contexts():
    stems = {"fool": 2.0}

    def kinds(text):
        return [k for k, _ in toxicity.clause_matches(*toxicity.letters(text.split(), stems))]

    assert kinds("you fool") == ["aimed"]
    assert kinds("a foolish fool walks") == ["plain", "plain"]
    assert kinds("not a fool") == ["negated"]
    assert kinds("critics said fool") == ["reported"]
    assert kinds("kill you") == ["threat_aimed"]
    assert kinds("they will kill") == ["threat_aimed"] and kinds("will kill") == ["threat"]
    assert kinds("he said he would kill you") == ["threat_reported"]
    assert kinds("i will not kill you") == ["threat_negated"]


def brute_features(text, stems):
    """Looks back and forth from each word of each clause, without a state."""
    found, direct = Counter(), []
    for clause in re.split(r"[.!?;:\n|]", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        held = [max((s for s in stems if (w == s[:-1] if s.endswith("$") else w.startswith(s))), key=len, default=None) for w in words]
        is_in = [[held[k] is None and w in c for k, w in enumerate(words)] for c in (toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS)]
        threat, target, negation, report = is_in
        target = [t and not x for t, x in zip(target, threat)]
        negation = [n and not (x or t) for n, x, t in zip(negation, threat, target)]
        report = [r and not (x or t or n) for r, x, t, n in zip(report, threat, target, negation)]
        for k, stem in enumerate(held):
            if stem is None and not threat[k]:
                continue
            near = any(target[:k]) or any(target[k + 1 : k + 4])
            state = "negated" if any(negation[max(k - 2, 0) : k]) else "reported" if any(report[:k]) else "aimed" if near else "plain"
            if stem is None:
                found["threat" if state == "plain" else "threat_" + state] += 1
            else:
                found[state] += stems[stem]
                direct += [stems[stem]] * (state in ("plain", "aimed"))
    logs = [np.log1p(found[k]) for k in toxicity.KINDS]
    return [*logs, max(direct, default=0.0), np.log1p(1000 * len(direct) / (len(text.lower()) + 1000))]


def test_clauses_against_brute_force(sf_docs):
    stems = {"fool": 2.0, "foolis": 1.5, "wretch$": 3.0, "scu": 1.0, "que": 0.5, "las": 0.25, "die$": 0.75}
    cues = toxicity.automaton(stems)
    rnd = random.Random(3)
    some = ["fool", "foolish", "wretch", "wretched", "scum", "kill", "you", "not", "said", "and", "x1", "½fool", "été", "die", "diet", "fool_fool", "", "a"]
    seen = ["you " + "word " * 300 + "fool", "he said " + "word " * 3000 + "kill him", "fool", "", "not", "." * 900 + "scum", "|".join(["you", "fool"] * 50)]
    seen += ["".join(rnd.choice(some) + rnd.choice("     ,.!\n|'") for _ in range(rnd.randrange(60))) for _ in range(800)]
    seen += [r["text"] or "" for r in sf_docs.collect()]
    for text in seen:
        assert np.allclose(toxicity.features(text, stems, cues), brute_features(text, stems)), text
    first = dict(zip(toxicity.FEATURES, toxicity.features(seen[0], stems, cues)))
    assert first["aimed"] > 0 and first["plain"] == 0


def test_bounded_weights():
    rnd = np.random.default_rng(4)
    x = rnd.poisson(0.5, (3000, len(toxicity.FEATURES))).astype(float)
    truth = np.array([1.0, 1.2, 2.0, -0.5, 0.4, 0.8, 0.1, 0.9, 0.0, 0.3])  # negated and threat_reported would pass their bounds
    y = (rnd.random(3000) < 1 / (1 + np.exp(3 - x @ truth))).astype(float)
    start, *w = toxicity._fit(x, y)
    w = dict(zip(toxicity.FEATURES, w))
    assert all(w[low] <= w[high] for low, high in toxicity.NOT_ABOVE)
    assert w["negated"] == w["plain"] > 1 and w["threat_reported"] == w["threat"] > 0.4
    assert abs(w["aimed"] - 1.2) < 0.3 and abs(w["reported"] + 0.5) < 0.3 and abs(w["threat_negated"] - 0.1) < 0.3


def test_repeated_ids_in_the_fit(spark):
    rows = [(i % 300, "a scoundrel walks" if i % 5 == 0 else "a person walks") for i in range(900)]
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    one, two = (toxicity.fit_grammar(spark.createDataFrame(r, "doc_id long, text string"), marks) for r in (rows, rows[::-1]))
    assert one == two and "scoundrel$" in one.stems
