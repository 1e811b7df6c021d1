"""Licence scans: identifier tags and notice phrases by one Aho-Corasick pass, expressions by a shunting-yard parser.

A text is read as a stream of words joined by one space, so that one automaton over all phrases
finds every place of every phrase at word borders, overlapping ones too. Behind an identifier tag
the raw line is read as a licence expression. Documents don't meet: one pass, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyback.llm.common import arrow_map, document_texts
from tallyback.llm.text import texts_of

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases of well-known licences, as words; each names the licence more exactly than a base phrase.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd-text",
    "creative commons attribution": "cc-by",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc0 1 0": "cc0-1.0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
# Licences whose text may be used freely, for the verdict on an expression.
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})

# How far one kind of evidence alone makes a licence statement likely.
WEIGHTS = {"expression": 0.95, "notice": 0.8, "base": 0.7, "broken": 0.3}

_STREAM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AFTER_TAG = re.compile(r"[ \t]*[:=][ \t]*")
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass
class Expression:
    """A parsed licence expression: postfix terms and operators, and the characters it spans."""

    length: int
    postfix: list[tuple[str, str]] = field(default_factory=list)
    valid: bool = False

    def terms(self) -> list[str]:
        return [value for kind, value in self.postfix if kind == "term"]

    def evaluate(self, accepted: frozenset[str]) -> bool:
        """True where the accepted licences satisfy the expression; an exception only widens its licence."""
        stack: list[bool] = []
        for kind, value in self.postfix:
            if kind == "term":
                stack.append(value.removesuffix("+") in accepted)
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(left if value == "with" else left and right if value == "and" else left or right)
        return stack[-1]


def parse_expression(line: str) -> Expression:
    """Read the expression at the start of ``line`` with a stack of operators (with, then and, then or bind closest).

    It ends where the grammar can't go on: at other signs, at a second term in a row or at a bracket that closes
    nothing. It is valid if every bracket is closed and every operator has its terms; ``with`` needs two plain terms.
    """
    out, stack, at, want_term, sound = Expression(0), [], 0, True, True
    while True:
        found = _TOKEN.match(line, at)
        if not found:
            break
        bracket, word = found.groups()
        name = (word or "").lower()
        if want_term:
            if bracket == "(":
                stack.append("(")
            elif word and name not in _BINDS:
                out.postfix.append(("term", name.rstrip(".")))
                want_term = False
            else:
                break
        elif name in _BINDS:
            if name == "with":
                sound &= out.postfix[-1][0] == "term"
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[name]:
                out.postfix.append(("operator", stack.pop()))
            stack.append(name)
            want_term = True
        elif bracket == ")" and "(" in stack:
            while stack[-1] != "(":
                out.postfix.append(("operator", stack.pop()))
            stack.pop()
        else:
            break
        at = found.end()
    out.length = at
    out.valid = bool(out.postfix) and not want_term and sound and "(" not in stack
    while stack:
        out.postfix.append(("operator", stack.pop()))
    return out


class Scanner:
    """One automaton over base phrases, notices and tags."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...], accepted: frozenset[str]):
        self._accepted = accepted
        kinds: dict[str, list[tuple[str, str, int]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
            for phrase, label in phrases.items():
                kinds.setdefault(f" {phrase} ", []).append((kind, label, len(phrase.split(" "))))
        self._find = ahocorasick.Automaton()
        for phrase, meanings in kinds.items():
            self._find.add_word(phrase, (len(phrase), meanings))
        self._find.make_automaton()

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of words and the findings in order of their place."""
        words = text.encode().translate(_STREAM).split()
        stream = f" {b' '.join(words).decode()} "
        hits, word, seen = [], 0, 0
        for end, (length, meanings) in sorted(self._find.iter(stream), key=lambda hit: hit[0] - hit[1][0]):
            start = end - length + 1
            word += stream.count(" ", seen, start)
            seen = start
            hits += [(word, kind, label, size) for kind, label, size in meanings]
        return len(words), self._spans(text, hits) if hits else []

    def _spans(self, text: str, hits: list[tuple[int, str, str, int]]) -> list[dict]:
        wanted = {w for word, _, _, size in hits for w in (word, word + size - 1)}
        spans = {i: m.span() for i, m in enumerate(_WORD.finditer(text.translate(_LOWER))) if i in wanted}
        found = []
        for word, kind, label, size in hits:
            start, end = spans[word][0], spans[word + size - 1][1]
            entry = {"kind": kind, "label": label, "word": word, "start": start, "end": end, "terms": [], "accepted": None}
            if kind == "tag":
                gap = _AFTER_TAG.match(text, end)
                if not gap:
                    continue
                stop = text.find("\n", gap.end())
                read = parse_expression(text[gap.end() : stop if stop >= 0 else len(text)])
                entry["end"] = gap.end() + read.length
                entry["kind"] = "expression" if read.valid else "broken"
                if read.valid:
                    entry["terms"] = sorted(set(read.terms()))
                    entry["accepted"] = read.evaluate(self._accepted)
            found.append(entry)
        return found


FINDING = pa.struct(
    [("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
     ("terms", pa.list_(pa.string())), ("accepted", pa.bool_())]
)
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "findings array<struct<kind: string, label: string, word: long, start: long, `end`: long, terms: array<string>, accepted: boolean>>"
)


def summarise(found: list[dict]) -> tuple:
    """Counts, labels and score of one document's findings."""
    base = [f for f in found if f["kind"] == "base"]
    places = [f["word"] for f in base]
    evidence = {(f["kind"], name) for f in found for name in (f["terms"] or [f["label"]])}
    doubt = 1.0
    for kind, _ in sorted(evidence):
        doubt *= 1 - WEIGHTS[kind]
    named = {name for _, name in evidence if name}
    return (
        len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted({f["label"] for f in base})), ",".join(sorted(named)), 1 - doubt,
    )


def scan_licences(
    docs: DataFrame,
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
    tags: tuple[str, ...] = TAGS,
    accepted: frozenset[str] = ACCEPTED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence statements of every whole text: one row per row of ``docs``.

    A-Z are lower-cased; words are runs of digits, letters a-z and everything beyond ASCII. ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` tell where the words of a base phrase stand one after
    another. ``labels`` adds those of notices and every licence and exception of a valid expression behind a tag; ``score``
    is one minus the product of the doubts (``WEIGHTS``) of all different pieces of evidence, 0 without any.
    ``findings`` lists every place in order: kind (base, notice, expression, broken), label, first word, characters
    [start, end), the expression's terms, and whether the accepted licences satisfy it.

    Null and empty texts have no words and no findings; texts of any length are read whole; repeated rows give one row each;
    a null id stays null; an empty table gives an empty result; other columns are not read.
    """

    def step(batch: pa.RecordBatch):
        scanner = scanner_for(base, notices, tags, accepted)
        scanned = [scanner.scan(text) for text in texts_of(batch.column(1)).to_pylist()]
        sums = [summarise(found) for _, found in scanned]
        whole, text = pa.int64(), pa.string()
        columns = [pa.array([s[i] for s in sums], kind) for i, kind in enumerate((whole, whole, whole, text, text, pa.float64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in scanned], whole), *columns, pa.array([found for _, found in scanned], pa.list_(FINDING))],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "findings"],
        )

    return arrow_map(document_texts(docs, id_col, text_col), step, SCHEMA)


_scanners: dict[tuple, Scanner] = {}  # one automaton per worker and set of phrases


def scanner_for(base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...], accepted: frozenset[str]) -> Scanner:
    key = (tuple(base.items()), tuple(notices.items()), tags, accepted)
    if key not in _scanners:
        _scanners[key] = Scanner(base, notices, tags, accepted)
    return _scanners[key]
