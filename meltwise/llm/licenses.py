"""License scans: an Aho-Corasick automaton finds tags and notice phrases, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases (words joined by a space) and the labels they stand for.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notice phrases of this library: phrase, label, how strong the evidence is.
NOTICES = (
    ("mit license", "mit", 0.9),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("apache license", "apache", 0.8),
    ("apache license version 2 0", "apache-2.0", 0.95),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("bsd license", "bsd", 0.8),
    ("lesser general public license", "lgpl", 0.9),
    ("affero general public license", "agpl", 0.9),
    ("general public license version 2", "gpl-2.0", 0.95),
    ("general public license version 3", "gpl-3.0", 0.95),
    ("mozilla public license", "mpl", 0.9),
    ("creative commons attribution", "cc-by", 0.8),
    ("creative commons zero", "cc0", 0.8),
    ("public domain", "public-domain", 0.5),
    ("isc license", "isc", 0.8),
    ("the unlicense", "unlicense", 0.8),
)
STRENGTH = {"cc-by": 0.6, "gpl": 0.8, "reserved": 0.3}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+\-:]+")
MOST = 1 << 16  # combinations up to which an expression is written out as choices
_BLANKS = re.compile(r"[ \t]*")
_POWER = {"or": 1, "and": 2, "with": 3}
_FORM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def to_postfix(text: str) -> list[str] | None:
    """The longest well-formed licence expression at the start of ``text`` in postfix order; None if there is none."""
    out: list[str] = []
    held: list[str] = []
    operand, depth, best = False, 0, None  # whether an operand has just ended, open brackets, the last complete expression
    at = 0
    while m := _TOKEN.match(text, at):
        t, at = m[0], _BLANKS.match(text, m.end()).end()
        if t in _POWER:
            if not operand:
                break
            while held and held[-1] != "(" and _POWER[held[-1]] >= _POWER[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            held.append(t)
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(t)
            operand = True
        if operand and not depth:
            best = len(out), held[::-1]
    return None if best is None else out[: best[0]] + best[1]


def choices(postfix: list[str], most: float = float("inf")) -> set[frozenset[str]] | None:
    """What an expression allows: sets of licences that together suffice. ``a with e`` is one licence of that name.

    None if an ``and`` or ``with`` combines more than ``most`` pairs of them.
    """
    stack: list[set[frozenset[str]]] = []
    for t in postfix:
        if t not in _POWER:
            stack.append({frozenset([t])})
            continue
        right, left = stack.pop(), stack.pop()
        if t != "or" and len(left) * len(right) > most:
            return None
        if t == "or":
            stack.append(left | right)
        elif t == "and":
            stack.append({a | b for a in left for b in right})
        else:
            stack.append({frozenset([f"{x} with {y}" for a in left for x in a for b in right for y in b])})
    return stack.pop()


def automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    phrases: dict[str, list] = {}
    for p, label in BASE_PHRASES.items():
        phrases.setdefault(p, []).append((True, label, STRENGTH[label]))
    for p, label, strength in NOTICES:
        phrases.setdefault(p, []).append((False, label, strength))
    phrases.setdefault(TAG, []).append((False, None, 0.0))
    for p, found in phrases.items():
        auto.add_word(f" {p} ", (len(p) + 2, found))
    auto.make_automaton()
    return auto


def scan_text(text: str | None, auto) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, choices) of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FORM).split()
    form = " " + b" ".join(words).decode("latin-1") + " "
    n, first, last, score = 0, None, None, 0.0
    base: set[str] = set()
    labels: set[str] = set()
    allowed: set[str] = set()
    word, at, tagged = 0, 0, False
    for end, (length, found) in auto.iter(form):
        start = end - length + 1
        for is_base, label, strength in found:
            if label is None:
                tagged = True
                continue
            labels.add(label)
            score = max(score, strength)
            if is_base:
                place = word + (form.count(" ", at, start) if start >= at else -form.count(" ", start, at))
                word, at = place, start
                n += 1
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
                base.add(label)
    if tagged:
        for m in _TAG_LINE.finditer(text.lower()):
            if postfix := to_postfix(m[1].strip()):
                labels.update(t for t in postfix if t not in _POWER)
                ways = choices(postfix, MOST)
                allowed |= {" ".join(postfix)} if ways is None else {"&".join(sorted(c)) for c in ways}
                score = 1.0
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, "|".join(sorted(allowed))


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "allowed")


def scan(text: Column) -> Column:
    """A struct for each row: what licences its whole text names.

    ``n_base`` counts all places, overlapping ones too, where a base phrase's words stand one after another, ``first_word`` and
    ``last_word`` the smallest and largest of them (words from 0). ``labels`` adds notice phrases and the licences of tagged
    expressions, ``allowed`` lists the choices such expressions leave ("a&b|c"), or gives an expression of too many choices itself in postfix
    order ("a b or c d or and"), ``score`` is the strongest evidence: 1 for an
    expression, less for phrases, 0 for none. Null text: as the empty one, no words, no places, no labels.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = automaton()
        for s in batches:
            out = pd.DataFrame([scan_text(t, auto) for t in s], columns=list(FIELDS))
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return F.pandas_udf(run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, allowed string")(text)
