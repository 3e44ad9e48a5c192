"""Personal data by anchor expansion: cues first, local parsers around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from paneloom.llm.common import id_text, ship

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_login", "address", "account")

# Character classes of the parsers and the cues of identifiers.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGITS = frozenset("0123456789")
DIALLED = frozenset(" ().0123456789-")
STREET_CUES = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "straße", "strasse", "platz", "Rue ", "Calle ", "Avenida ")
ACCOUNT_CUES = ("IBAN", "iban", "Account", "account", "Konto", "konto", "Compte", "compte", "Cuenta", "cuenta", "SSN", "ssn")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|id))?[ :#=]{1,3}([0-9][0-9 -]{5,30}[0-9])")
HOUSE_FIRST = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}$")
HOUSE_LAST = re.compile(r" [0-9]{1,4}[a-z]?(?![A-Za-z0-9])")
STREET_NAME = re.compile(r"(?:[A-ZÄÖÜ][a-zäöüß]*)$")
NAME_AFTER = re.compile(r"(?:[a-zà-ÿ]{1,3} )*[A-ZÀ-Þ][A-Za-zÀ-ÿ]+,? [0-9]{1,4}(?![A-Za-z0-9])")
HOUSE_BEFORE = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,4},? $")

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    cues = ahocorasick.Automaton()
    for d in DIGITS:
        cues.add_word(d, ("digit", 1))
    cues.add_word("@", ("at", 1))
    cues.add_word("+", ("plus", 1))
    cues.add_word("://", ("scheme", 3))
    for cue in STREET_CUES:
        cues.add_word(cue, ("street", len(cue)))
    for cue in ACCOUNT_CUES:
        cues.add_word(cue, ("account", len(cue)))
    cues.make_automaton()
    return cues


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_valid(compact: str) -> bool:
    turned = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _email_at(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around the at-sign; ``free`` is where the last match ended."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, at_label, end = len(text), at + 1, 0
    labels = 0
    while True:
        stop = at_label
        while stop < n and text[stop] in LABEL:
            stop += 1
        if stop == at_label:
            break
        labels += 1
        end = stop
        if stop >= n or text[stop] != ".":
            break
        at_label = stop + 1
    return (start, end) if labels >= 2 else None


def _digits_end(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def _ip_at(text: str, start: int) -> int:
    """End of four dotted runs of digits from ``start``, or 0."""
    end = _digits_end(text, start)
    for _ in range(3):
        if not text.startswith(".", end):
            return 0
        more = _digits_end(text, end + 1)
        if more == end + 1:
            return 0
        end = more
    return end


def _card_end(text: str, start: int) -> int:
    n, end = len(text), _digits_end(text, start)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = _digits_end(text, end + 1)
    return end


def _phone_end(text: str, plus: int) -> int:
    n, end = len(text), plus + 1
    if end >= n or text[end] not in DIGITS:
        return 0
    while end < n and text[end] in DIALLED:
        end += 1
    while text[end - 1] not in DIGITS:
        end -= 1
    return end if end - plus >= 4 else 0


def find_spans(text: str, cues: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by start, then kind."""
    spans: list[Span] = []
    free = dict.fromkeys(("email", "ip", "card", "account", "address", "url_login"), 0)
    run_end = 0
    for last, (cue, width) in cues.iter(text):
        start = last - width + 1
        if cue == "digit":
            if start >= free["card"]:
                end = _card_end(text, start)
                free["card"] = end
                digits = "".join(c for c in text[start:end] if c in DIGITS)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", start, end))
            if start >= run_end and start >= free["ip"]:
                run_end = _digits_end(text, start)
                if end := _ip_at(text, start):
                    free["ip"] = end
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text[start:end].split(".")):
                        spans.append(("ip", start, end))
        elif cue == "at":
            if found := _email_at(text, start, free["email"]):
                free["email"] = found[1]
                spans.append(("email", *found))
        elif cue == "plus":
            if end := _phone_end(text, start):
                if 9 <= sum(c in DIGITS for c in text[start:end]) <= 15:
                    spans.append(("phone", start, end))
        elif cue == "scheme":
            begin = start
            while begin > 0 and text[begin - 1].isascii() and text[begin - 1].isalpha():
                begin -= 1
            end = last + 1
            while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>":
                end += 1
            login = text[last + 1 : end].split("/", 1)[0]
            if begin < start and begin >= free["url_login"] and re.fullmatch(r"[^@:]+:[^@]+@[A-Za-z0-9.-]+(?::[0-9]+)?", login):
                free["url_login"] = end
                spans.append(("url_login", begin, end))
        elif cue == "street":
            found = _address(text, start, last + 1)
            if found and found[0] >= free["address"]:
                free["address"] = found[1]
                spans.append(("address", *found))
        elif start >= free["account"]:
            found = _account(text, last + 1)
            if found:
                free["account"] = found[1]
                spans.append(("account", *found))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def _address(text: str, start: int, end: int) -> tuple[int, int] | None:
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    cue = text[start:end]
    if cue.endswith(" "):
        name = NAME_AFTER.match(after)
        if name:
            return start, end + name.end()
        house = HOUSE_BEFORE.search(before)
        name = re.match(r"(?:[a-zà-ÿ]{1,3} )*[A-ZÀ-Þ][A-Za-zÀ-ÿ]+", after)
        return (start - len(before) + house.start(), end + name.end()) if house and name else None
    if cue[0].islower():
        name, house = STREET_NAME.search(before), HOUSE_LAST.match(after)
        return (start - len(before) + name.start(), end + house.end()) if name and house else None
    house = HOUSE_FIRST.search(before)
    return (start - len(before) + house.start(), end) if house and not after[:1].isalpha() else None


def _account(text: str, end: int) -> tuple[int, int] | None:
    iban = IBAN.search(text, end, end + 50)
    if iban and iban_valid(iban.group().replace(" ", "")):
        return iban.span()
    number = ACCOUNT.match(text, end, end + 50)
    return number.span(1) if number and sum(c in DIGITS for c in number.group(1)) >= 6 else None


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cues = _automaton()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = find_spans(text, cues)
            said = [f"{k}:{a}:{b}" for k, a, b in spans]
            base = ",".join(s for s, (k, _, _) in zip(said, spans, strict=True) if k in BASE_KINDS)
            counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
        out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts, as ``kind:start:end`` in code points.

    An Aho-Corasick automaton streams each text once and reports cues: digits,
    at-signs, plus signs, schemes, street and account words. A deterministic
    parser expands each cue to the bounds of an address, number or account and
    validates it (label structure, octets, Luhn, digit counts, mod 97). Within
    a kind spans are leftmost and don't overlap; a candidate that fails its
    validation is dropped with the text it covers.

    One row comes out per row. Null and empty texts have no spans (empty
    ``spans``, digest of the empty string); repeated rows give repeated rows;
    an empty table gives none; other columns are not read; a null id stays.
    Rows are independent: nothing is shuffled, memory is one batch.
    """
    ship(docs.sparkSession)
    base = id_text(docs, id_col, text_col)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(_scan, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
