"""Toxicity from composed finite-state transducers over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import id_text, ship
from paneloom.session import cut_lineage

TOKEN = re.compile(r"[^\W\d_]+")
CLAUSE_ENDS = ".!?;:\n|"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")

# Closed word classes of the grammar, for English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself they them he him she her du dich dir ihr euch sie er tu toi vous il elle ils elles tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nobody none without isn aren nicht kein keine nie niemals pas jamais aucun sans nunca jamás sin ningún".split())
REPORTS = frozenset("said says saying wrote writes claimed claims called quoted quote reported sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split())
THREATS = frozenset("kill murder hurt destroy burn beat stab shoot umbringen töten schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir".split())

#: Letters that the first transducer writes: insult, threat, target, negation, report, anything else.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITYNRO"

#: Ends a stem that is a whole word.
END = "$"

#: Kinds of matches, by what the clause machine has read before; then the heaviest direct insult and their density.
KINDS = ("plain", "aimed", "negated", "reported", "threat", "threat_aimed", "threat_negated", "threat_reported")
FEATURES = (*KINDS, "heaviest", "dense")

#: A match in the first state never weighs more than one in the second.
NOT_ABOVE = (("negated", "plain"), ("reported", "plain"), ("threat_negated", "threat"), ("threat_reported", "threat"))


@dataclass(frozen=True)
class Grammar:
    """Learned stems with their weights; the intercept and the weights of the features."""

    stems: dict[str, float]
    weights: tuple[float, ...]


def letters(tokens: list[str], stems: dict[str, float]) -> tuple[str, list[float]]:
    """First transducer: a token's class, and its weight if it is an insult.

    Insults are read by a trie: the longest learned stem that starts the token;
    a stem that ends in ``END`` is the whole token.
    """
    out, weight = [], []
    for token in tokens:
        w = 0.0
        word = token + END
        for k in range(len(word), 2, -1):
            if (w := stems.get(word[:k], 0.0)) > 0:
                break
        weight.append(max(w, 0.0))
        if w > 0:
            out.append(INSULT)
        elif token in THREATS:
            out.append(THREAT)
        elif token in TARGETS:
            out.append(TARGET)
        elif token in NEGATIONS:
            out.append(NEGATION)
        elif token in REPORTS:
            out.append(REPORT)
        else:
            out.append(OTHER)
    return "".join(out), weight


#: A negation reaches over so many words; a target is looked for so many words after a match.
NEGATION_REACH, TARGET_REACH = 2, 3


def clause_matches(classes: str, weight: list[float]) -> Iterator[tuple[str, float]]:
    """Composition of the negation, report and target machines over a clause.

    The state is (words since a negation, report seen, target seen), from the
    start of the clause on; it is read at each insult or threat, which writes
    one match with its weight. Negation goes before report, report before target.
    """
    since, reported, targeted = NEGATION_REACH + 1, False, False
    for k, letter in enumerate(classes):
        if letter == NEGATION:
            since = 0
            continue
        if letter == REPORT:
            reported = True
        elif letter == TARGET:
            targeted = True
        elif letter in (INSULT, THREAT):
            if since < NEGATION_REACH:
                state = "negated"
            elif reported:
                state = "reported"
            else:
                state = "aimed" if targeted or TARGET in classes[k + 1 : k + 1 + TARGET_REACH] else "plain"
            if letter == INSULT:
                yield state, weight[k]
            else:
                yield ("threat" if state == "plain" else f"threat_{state}"), 1.0
        since += 1


def automaton(stems: dict[str, float]) -> ahocorasick.Automaton:
    cues = ahocorasick.Automaton()
    for cue in {*(s.removesuffix(END) for s in stems), *THREATS}:
        cues.add_word(cue, len(cue))
    cues.make_automaton()
    return cues


def features(text: str, stems: dict[str, float], cues: ahocorasick.Automaton) -> list[float]:
    """What the clauses of a text match; clauses without a cue are passed over, the others read whole."""
    low = text.lower()
    found: Counter[str] = Counter()
    heaviest, done, matches = 0.0, 0, 0
    if len(cues):
        for last, width in cues.iter(low):
            start = last - width + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            begin = max(done, *(low.rfind(c, done, start) + 1 for c in CLAUSE_ENDS))
            stop = CLAUSE_END.search(low, last)
            done = stop.start() if stop else len(low)
            for kind, w in clause_matches(*letters(TOKEN.findall(low, begin, done), stems)):
                found[kind] += w
                if kind in ("plain", "aimed"):
                    heaviest, matches = max(heaviest, w), matches + 1
    dense = 1000.0 * matches / (len(low) + 1000.0)
    return [*(math.log1p(found[k]) for k in KINDS), heaviest, math.log1p(dense)]


def _prefixes(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = {w + END for w in TOKEN.findall(text.lower()) if len(w) > 2}
            counts[int(toxic)].update({w[:k] for w in words for k in range(3, min(len(w), longest) + 1)})
        both = sorted({*counts[0], *counts[1]})
        yield pd.DataFrame({"prefix": both, "toxic": [counts[1][p] for p in both], "clean": [counts[0][p] for p in both]})


def learn_stems(sample: DataFrame, least: int, ratio: float, most: int, longest: int) -> dict[str, float]:
    """Insult stems: prefixes of words that toxic texts hold ``ratio`` times as often.

    Of prefixes that continue each other and occur in as many toxic texts
    (nine in ten) the longest stays, the whole word if its ending never varies;
    its weight is the log odds.
    """
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counted = sample.select("text", "toxic").mapInPandas(lambda b: _prefixes(b, longest), "prefix string, toxic long, clean long")
    summed = counted.groupBy("prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (bad + 1.0)) / ((F.col("clean") + 0.5) / (good + 1.0))
    rows = (
        summed.where(F.col("toxic") >= least)
        .withColumn("odds", odds)
        .where(F.col("odds") >= ratio)
        .orderBy(F.desc("toxic"), F.desc("odds"), "prefix")
        .limit(most)
        .collect()
    )
    by = {r["prefix"]: r for r in rows}
    dropped = set()
    for p in by:
        for k in range(3, len(p)):
            if (short := p[:k]) in by:
                if by[p]["toxic"] >= 0.9 * by[short]["toxic"]:
                    dropped.add(short)
                else:
                    dropped.add(p)
    return {p: math.log(r["odds"]) for p, r in by.items() if p not in dropped}


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps on standardised features; intercept and weights of the features as they are."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w, penalty = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
    penalty[0, 0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty + np.eye(len(w)) * 1e-9
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0] - mean / scale @ w[1:]), w[1:] / scale


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and weights; states that ``NOT_ABOVE`` holds down share the weight of their bound where they would pass it."""
    home = np.arange(len(FEATURES))
    limits = [(FEATURES.index(low), FEATURES.index(high)) for low, high in NOT_ABOVE]
    while True:
        own = np.unique(home)
        start, w = _newton(np.column_stack([x[:, home == k].sum(axis=1) for k in own]), y)
        w = w[np.searchsorted(own, home)]
        above = [(low, high) for low, high in limits if w[low] > w[high]]
        if not above:
            return start, *w.tolist()
        for low, high in above:
            home[low] = high


def fit_grammar(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = 12000,
    least: int = 5,
    ratio: float = 20.0,
    most_stems: int = 5000,
    longest: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Grammar:
    """Learns stems and match weights from a bounded sample of labelled rows.

    Rows whose crc32(id as text) mod 3 is 1 are held out and never read. Of
    the others ``sample_docs`` are drawn by a hash of the id. Null or
    conflicting labels: null is left out, toxic wins. Of rows that share an id
    the smallest text is read.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    drawn = training.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample_docs)
    base = id_text(docs, id_col, text_col)
    sample = base.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")  # at most sample_docs ids
    sample = cut_lineage(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    stems = learn_stems(sample, least, ratio, most_stems, longest)
    names = [f"f{k}" for k in range(len(FEATURES))]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cues = automaton(stems)
        for b in batches:
            x = pd.DataFrame([features(t, stems, cues) for t in b["text"]], columns=names)
            yield x.assign(toxic=b["toxic"].to_numpy(float))

    got = sample.mapInPandas(rows, ", ".join(f"{n} double" for n in [*names, "toxic"])).toPandas()
    if not len(got):
        return Grammar({}, (0.0,) * (len(FEATURES) + 1))
    return Grammar(stems, _fit(got[names].to_numpy(float), got["toxic"].to_numpy(float)))


def scores(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, the score from 0 to 1."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cues = automaton(grammar.stems)
        w = np.array(grammar.weights)
        for texts in batches:
            x = np.array([features(t, grammar.stems, cues) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return docs.withColumn("toxicity", score(F.coalesce(F.col(text_col), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    A first transducer turns the words of a clause into classes (insult by
    learned stems, threat, target, negation, report); the composed machines
    read them left to right and write weighted matches by context; a logistic
    model turns the matches of all clauses into the score, in which a negated
    or reported match never weighs more than a plain one. A word counts by the
    clause it stands in, however long. Labels, language and source are no inputs.

    One row comes out per row. Null and empty texts have no matches and get
    the score of that; a null id is not held out; repeated rows get the same
    score; an empty table gives none; without labels every score is one half;
    other columns are not read. The learned grammar is bounded by parameters.
    """
    base = id_text(docs, id_col, text_col)
    scored = scores(base, fit_grammar(docs, labels, id_col=id_col, text_col=text_col, **options))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )
