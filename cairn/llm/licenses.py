"""License scans: Aho-Corasick for tags and notice phrases, a shunting-yard parser for expressions.

A text's words (letters, digits and everything outside ASCII, after lower-casing A-Z) are joined by
single spaces and run once through an automaton of all notice phrases, so cost follows the text's
length and not the number of phrases. A second automaton finds identifier tags in the raw text; the
expression after a tag is turned into postfix order and evaluated: an identifier is worth 1 if it is
known and 0.5 if not, ``or`` takes the larger side, ``and`` and ``with`` the smaller one.

Defined cases: a null text counts as empty; without a match the positions are null, labels are empty
strings and the score is 0; overlapping phrases all count; a tag whose expression can't be parsed
adds nothing; repeated rows and null ``doc_id`` are kept; other columns of the input are ignored; an
empty table gives an empty table. Time is linear in the text but for a binary search for each match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ascii_lower, map_batches, prepare, text_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases of the contract and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases and their labels (fixed values).
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0-1.0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: Tags that an expression follows (fixed values).
TAGS = ("spdx-license-identifier:", "license-expression:")

#: Identifiers known to the evaluator, lower case (fixed values).
KNOWN = frozenset(
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsl-1.0 "
    "cc-by-4.0 cc-by-nc-4.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 epl-1.0 epl-2.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only "
    "gpl-3.0-or-later isc lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mit mpl-1.1 mpl-2.0 "
    "ofl-1.1 postgresql python-2.0 unlicense wtfpl zlib classpath-exception-2.0 gcc-exception-3.1 llvm-exception".split()
)
NOTICE_SCORE = 0.8
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def tokens_of(line: str) -> list[str]:
    """The longest run of expression tokens at the line's start."""
    out, at = [], 0
    while True:
        while at < len(line) and line[at] in " \t":
            at += 1
        m = _TOKEN.match(line, at)
        if not m:
            return out
        out.append(m[0].lower())
        at = m.end()


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: postfix order, None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one is expected next
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(tokens: list[str]) -> tuple[float, set[str]] | None:
    """Worth and labels of an expression."""
    order = postfix(tokens)
    if order is None:
        return None
    stack: list[tuple[float, set[str]]] = []
    for t in order:
        if t in _BINDS:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if t == "with":
                if len(left) != 1 or len(right) != 1:
                    return None
                stack.append((min(a, b), {f"{next(iter(left))} with {next(iter(right))}"}))
            else:
                stack.append((max(a, b) if t == "or" else min(a, b), left | right))
        else:
            stack.append((1.0 if t.rstrip("+") in KNOWN else 0.5, {t}))
    return stack[0]


def expression_at(line: str) -> tuple[float, set[str]] | None:
    """The longest prefix of the line's tokens that is an expression; prose may follow it."""
    tokens = tokens_of(line)
    cuts, operand, depth = [], True, 0
    for i, t in enumerate(tokens):
        if operand != (t not in _BINDS and t != ")") or (t == ")" and not depth):
            break
        operand = t in _BINDS or t == "("
        depth += (t == "(") - (t == ")")
        if not operand and not depth:
            cuts.append(i + 1)
    # what one prefix can't evaluate (a "with" of many), longer ones can't either
    cut = bisect_left(cuts, True, key=lambda n: evaluate(tokens[:n]) is None)
    return evaluate(tokens[: cuts[cut - 1]]) if cut else None


_automata: list = []


def _machines():
    if not _automata:
        import ahocorasick

        phrases = ahocorasick.Automaton()
        for kind, table in (("base", BASE), ("notice", NOTICES)):
            for phrase, label in table.items():
                phrases.add_word(f" {phrase} ", (kind, label, len(phrase)))
        phrases.make_automaton()
        tags = ahocorasick.Automaton()
        for tag in TAGS:
            tags.add_word(tag, tag)
        tags.make_automaton()
        _automata.extend((phrases, tags))
    return _automata


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    phrases, tags = _machines()
    text = ascii_lower(text)
    words = WORD.findall(text)
    joined = f" {' '.join(words)} "
    places: list[int] = []
    ends: list[int] = []  # for each word where it ends in what is joined
    base: set[str] = set()
    labels: set[str] = set()
    score = 0.0
    for end, (kind, label, length) in phrases.iter(joined):
        if kind == "base":
            ends = ends or list(accumulate(len(w) + 1 for w in words))
            places.append(bisect_left(ends, end - length))
            base.add(label)
            score = 1.0
        else:
            score = max(score, NOTICE_SCORE)
        labels.add(label)
    if "license" in text:
        for end, _ in tags.iter(text):
            stop = text.find("\n", end)
            found = expression_at(text[end + 1 : stop if stop >= 0 else len(text)])
            if found:
                score = max(score, found[0])
                labels |= found[1]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), score


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of findings for each document."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*[scan(t) for t in b.column(1).to_pylist()], strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", text_of(text).alias("text")), run, SCHEMA)
