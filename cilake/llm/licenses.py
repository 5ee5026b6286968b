"""Licence scan: Aho-Corasick over words, shunting-yard over licence expressions.

One automaton holds all notice phrases and the words of identifier tags, each framed by spaces; it runs over
the space-joined words of a whole text, so a hit is a place where the phrase's words stand consecutively. After
an identifier tag the rest of the line, up to the next tag on it, is a licence expression: a shunting-yard parser orders its and / or / with
(with binds strongest, then and, then or; parentheses group), and its value is the freedom it grants:
`or` takes the larger, `and` the smaller value, an exception adds to its licence.

A document's score is the smallest value of its notices and expressions (all of them apply); 0 without any.

Everything happens per row in one narrow pass; memory is one Arrow batch plus the text in hand. Time and output are linear in
the text, also for a text that is one line of tags: expressions never overlap.

Defined cases: a null text counts as empty: no words, no places, null first and last word, empty labels,
score 0. An expression that does not parse has the label `invalid-expression` and value 0; unknown identifiers keep
their name as label and have value 0. Repeated rows score alike. Existing columns named like a result
column are replaced by it.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import fresh, small_batches, struct_udf

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of this scan.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "the unlicense": "unlicense",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
#: Freedom granted, by label or identifier (without a trailing version, -only or -or-later).
FREEDOM = {
    "public-domain": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0,
    "mit": 0.9, "isc": 0.9, "bsd": 0.9, "zlib": 0.9, "apache": 0.85, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.55, "cc-by-sa": 0.5,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.15, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05,
    "proprietary": 0.0,
}
EXCEPTION_GAIN = 0.2
BINDS = {"or": 1, "and": 2, "with": 3}

_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[a-z0-9.+\-]+|\S")
_VERSION = re.compile(r"(-only|-or-later|\+)$|-\d[\d.]*|-clause$")

FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("n_base", "bigint", pa.int64()),
    ("first_word", "bigint", pa.int64()),
    ("last_word", "bigint", pa.int64()),
    ("base_labels", "string", pa.string()),
    ("labels", "string", pa.string()),
    ("expressions", "array<string>", pa.list_(pa.string())),
    ("places", "array<struct<word:bigint,label:string>>", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
    ("score", "double", pa.float64()),
]


def freedom(label: str) -> float:
    """The value of a licence label, also with version and variant endings."""
    while label not in FREEDOM and (shorter := _VERSION.sub("", label)) != label:
        label = shorter
    return FREEDOM.get(label, 0.0)


def postfix(expression: str) -> list[str]:
    """The tokens of an expression in postfix order; ValueError if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand_next:
                raise ValueError("operand follows operand")
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("operand missing")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("parenthesis never opened")
            stack.pop()
        elif token in BINDS:
            if operand_next:
                raise ValueError("operand missing")
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next or not token[0].isalnum():
                raise ValueError("operator missing")
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError("operand or parenthesis missing")
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """(licence identifiers, freedom) of an expression."""
    values: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token not in BINDS:
            values.append(({token}, freedom(token)))
            continue
        (right, y), (left, x) = values.pop(), values.pop()
        if token == "with":
            values.append((left, min(1.0, x + EXCEPTION_GAIN)))
        else:
            small, large = sorted((left, right), key=len)
            large |= small  # in place: a chain of many licences stays linear
            values.append((large, max(x, y) if token == "or" else min(x, y)))
    return values[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def after_tags(data: bytes, tags: list[tuple[int, int]]) -> list[str]:
    """The expressions behind tags, given by the numbers of their first and last words, in text order.

    An expression ends with its line or where the next tag begins, so no byte of the text is in two of them.
    """
    firsts, lasts = {a for a, _ in tags}, {b for _, b in tags}
    starts, ends = [], []
    for k, m in enumerate(_WORD.finditer(data)):
        if k in firsts:
            starts.append(m.start())
        if k in lasts:
            ends.append(m.end())
    out = []
    for end, stop in zip(ends, [*starts[1:], len(data)], strict=True):
        line_end = data.find(b"\n", end, stop)
        text = data[end : stop if line_end < 0 else line_end].decode(errors="replace")
        out.append(text.lstrip(" :=\t\"'").rstrip(" \t\r*/>-;\"'.,"))
    return out


def scan(data: bytes | None, search: ahocorasick.Automaton) -> tuple:
    """The values of `FIELDS` for one text."""
    data = (data or b"").lower()  # bytes: A-Z only
    words = data.translate(_SPACES).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    places, tags, word, at = [], [], 0, 0
    for start, phrase in sorted((end + 1 - len(p) - 2, p) for end, p in search.iter(line)):
        word, at = word + line.count(" ", at, start), start
        if phrase in TAGS:
            tags.append((word, word + phrase.count(" ")))
        else:
            places.append((word, phrase))
    base = [(w, BASE[p]) for w, p in places if p in BASE]
    named = [*base, *((w, NOTICES[p]) for w, p in places if p in NOTICES)]
    labels, values = {x for _, x in named}, [freedom(x) for _, x in named]
    expressions = after_tags(data, tags) if tags else []
    for text in expressions:
        try:
            ids, value = evaluate(text)
        except ValueError:
            ids, value = {"invalid-expression"}, 0.0
        labels |= ids
        values.append(value)
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), expressions,
            [{"word": w, "label": x} for w, x in sorted(named)], min(values, default=0.0))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns of `FIELDS`."""
    search: list[ahocorasick.Automaton] = []

    def row(data: bytes | None) -> tuple:
        if not search:
            search.append(automaton())
        return scan(data, search[0])

    (found,) = fresh(docs, "_found")
    names = [n for n, _, _ in FIELDS]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return small_batches(docs).withColumn(found, struct_udf(FIELDS, row)(F.col(text))).select(*rest, *[F.col(found)[n].alias(n) for n in names])
