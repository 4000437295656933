"""Licence scans: identifier tags, notice phrases, and licence expressions.

One Aho-Corasick automaton looks for the words of every notice phrase and of the identifier tag in the
lower-cased words of a text. Behind a tag stands a licence expression, which a shunting-yard parser
evaluates under a policy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base and their labels.
BASE_PHRASES: Mapping[str, str] = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Notice phrases that the method adds.
NOTICE_PHRASES: Mapping[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}

#: Identifiers of expressions by how they begin, and their labels.
IDENTIFIERS: Mapping[str, str] = {
    "mit": "mit", "apache-": "apache", "gpl-": "gpl", "lgpl-": "lgpl", "agpl-": "agpl", "mpl-": "mpl",
    "epl-": "epl", "bsd-": "bsd", "0bsd": "bsd", "isc": "isc", "bsl-": "bsl", "cc-by": "cc-by",
    "cc0-": "public-domain", "unlicense": "unlicense",
}

PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "bsl", "public-domain", "unlicense", "cc-by"})

TAG = "spdx license identifier"
_TAG_TEXT = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:")
_LINE_END = re.compile(r"[\r\n]|\Z")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*(?::[a-z0-9.+-]+)?", re.ASCII | re.IGNORECASE)

# Lower-cases A-Z and blanks out what is no letter, digit or byte beyond ASCII.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def postfix(text: str, start: int = 0, end: int | None = None) -> list[str]:
    """The longest valid expression at the start of the part, in postfix order; empty if there is none.

    ``with`` binds closer than ``and``, ``and`` closer than ``or``.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ends an operand
    opened = 0  # brackets on the stack
    complete, pending = 0, []  # how much of ``out`` the longest valid expression takes, and the operators behind it
    for match in _TOKEN.finditer(text, start, len(text) if end is None else end):
        token = match[0].lower()
        if token == "(":
            if operand:
                break
            stack.append(token)
            opened += 1
        elif token == ")":
            if not operand or not opened:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            opened -= 1
        elif token in PRECEDENCE:
            if not operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        else:
            if operand:
                break
            out.append(token)
            operand = True
        if operand and not opened:
            complete, pending = len(out), stack[::-1]  # at most one operator of each precedence
    return out[:complete] + pending


def label_of(identifier: str) -> str | None:
    for start, label in IDENTIFIERS.items():
        if identifier == start or identifier.startswith(start if start.endswith("-") else start + "-"):
            return label
    return None


def evaluate(tokens: list[str], allowed: frozenset[str]) -> tuple[bool, set[str]]:
    """Whether the policy allows the expression, and the labels of its licences.

    An exception behind ``with`` neither allows nor forbids; an unknown identifier is not allowed.
    """
    stack: list[tuple[bool, set[str]]] = []
    for token in tokens:
        if token not in PRECEDENCE:
            label = label_of(token)
            stack.append((label in allowed, {label} if label else set()))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        elif token == "and":
            stack.append((left[0] and right[0], left[1] | right[1]))
        else:
            stack.append((left[0] or right[0], left[1] | right[1]))
    return stack[0]


@dataclass
class Scan:
    """What one text shows."""

    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    n_notices: int = 0
    expressions: list[str] = field(default_factory=list)
    allowed: bool | None = None

    @property
    def score(self) -> float:
        """Strength of the evidence: 1 with a readable tag, else nearer to 1 with each place found."""
        return 1.0 if self.expressions else 1.0 - 0.5 ** (self.n_base + self.n_notices)


class Scanner:
    def __init__(self, base: Mapping[str, str], notices: Mapping[str, str], allowed: frozenset[str]):
        self.allowed = allowed
        self.automaton = ahocorasick.Automaton()
        for phrase in dict.fromkeys([*base, *notices, TAG]):
            entry = (phrase.count(" ") + 1, base.get(phrase), notices.get(phrase), phrase == TAG)
            self.automaton.add_word(f" {phrase} ", entry)
        self.automaton.make_automaton()

    def scan(self, text: str) -> Scan:
        words = text.encode().translate(_CLEAN).split()
        found = Scan(n_words=len(words))
        if not words:
            return found
        line = (b" " + b" ".join(words) + b" ").decode()
        tagged, counted, passed = False, 0, 0
        for end, (length, base, notice, tag) in self.automaton.iter(line):
            tagged |= tag
            if base:  # places come in the order of their ends, so blanks are counted once
                passed, counted = passed + line.count(" ", counted, end), end
                word = passed - length
                found.n_base += 1
                found.first_word = word if found.first_word is None else min(found.first_word, word)
                found.last_word = word if found.last_word is None else max(found.last_word, word)
                found.base_labels.add(base)
            if notice:
                found.n_notices += 1
                found.labels.add(notice)
        found.labels |= found.base_labels
        if tagged:
            self._expressions(text, found)
        return found

    def _expressions(self, text: str, found: Scan) -> None:
        lowered, line_end = text.encode().translate(_LOWER).decode(), -1
        for match in _TAG_TEXT.finditer(lowered):
            if match.end() > line_end:
                line_end = _LINE_END.search(lowered, match.end()).start()
            tokens = postfix(lowered, match.end(), line_end)
            if not tokens:
                continue
            verdict, labels = evaluate(tokens, self.allowed)
            found.labels |= labels
            found.expressions.append(" ".join(tokens))
            found.allowed = verdict if found.allowed is None else found.allowed and verdict


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, expressions array<string>, allowed boolean"
)


def scan_licenses(
    docs: DataFrame,
    base: Mapping[str, str] = BASE_PHRASES,
    notices: Mapping[str, str] = NOTICE_PHRASES,
    allowed: frozenset[str] = PERMISSIVE,
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` with what its whole text shows of licences.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their least and
    greatest start (null if none). ``labels`` adds those of notices and of tagged expressions, which
    ``expressions`` gives in postfix order and ``allowed`` judges together (null without any). A null or
    empty text has no words, empty labels and score 0. Rows with equal or null ids each get a row; an
    empty table gives an empty result; other columns are not read. A tag's expression ends with its line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, allowed)
        for batch in batches:
            scans = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s.n_words for s in scans], pa.int64()),
                    pa.array([s.n_base for s in scans], pa.int64()),
                    pa.array([s.first_word for s in scans], pa.int64()),
                    pa.array([s.last_word for s in scans], pa.int64()),
                    pa.array([",".join(sorted(s.base_labels)) for s in scans], pa.string()),
                    pa.array([",".join(sorted(s.labels)) for s in scans], pa.string()),
                    pa.array([s.score for s in scans], pa.float64()),
                    pa.array([s.expressions for s in scans], pa.list_(pa.string())),
                    pa.array([s.allowed for s in scans], pa.bool_()),
                ],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
