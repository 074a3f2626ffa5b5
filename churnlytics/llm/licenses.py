"""License scans (operator 10).

One Aho-Corasick automaton over the words of each whole text finds notice
phrases and the words of an SPDX identifier tag; where the tag stands, a
shunting-yard parser evaluates its licence expression (AND, OR, WITH, '+',
parentheses). One pass over the documents, no shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from churnlytics.llm import text as TX

# Fixed phrases and labels of the contract.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notice phrases of the method, with the label and the weight of the evidence.
NOTICES = (
    ("released under the mit license", "mit", 0.9),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("licensed under the apache license version 2 0", "apache-2.0", 0.95),
    ("gnu general public license version 2", "gpl-2.0", 0.9),
    ("gnu general public license version 3", "gpl-3.0", 0.9),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("licensed under cc by 4 0", "cc-by-4.0", 0.9),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", 0.9),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 0.9),
    ("creative commons attribution 4 0 international", "cc-by-4.0", 0.9),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa-4.0", 0.9),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc-4.0", 0.9),
    ("cc0 1 0 universal", "cc0-1.0", 0.9),
    ("mozilla public license", "mpl", 0.8),
    ("mozilla public license v 2 0", "mpl-2.0", 0.9),
    ("mozilla public license version 2 0", "mpl-2.0", 0.9),
    ("eclipse public license", "epl", 0.8),
    ("european union public licence", "eupl", 0.8),
    ("boost software license version 1 0", "bsl-1.0", 0.9),
    ("sil open font license", "ofl", 0.8),
    ("server side public license", "sspl", 0.8),
    ("business source license", "busl", 0.8),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.95),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "isc", 0.9),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable",
     "zlib", 0.9),
    ("may be used to endorse or promote products derived from this software without specific prior written permission",
     "bsd-3-clause", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("all rights reserved", "proprietary", 0.4),
)
TAG_WORDS = "spdx license identifier"
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what splits words for the automaton
TAG = re.compile(rf"(?<![^{_GAP}])spdx[{_GAP}]+license[{_GAP}]+identifier\s*:\s*", re.I | re.A)
BASE_WEIGHT, TAG_WEIGHT = 0.6, 0.98
# Licences that a training set may usually take; the policy is a parameter.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense",
                        "cc0-1.0", "cc-by-4.0", "0bsd"})

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.\-:+]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str, allowed: frozenset = PERMISSIVE) -> tuple[list[str], bool] | None:
    """Labels and verdict of a licence expression, None if it has no valid
    beginning. The longest valid beginning counts, so text after the expression
    ('*/', prose) does no harm. WITH binds closest, then AND, then OR. An
    identifier is allowed if it is in ``allowed`` (a trailing '+' is ignored);
    AND needs both sides, OR one, an exception changes nothing."""
    tokens: list[str] = []
    want, depth, good = True, 0, 0  # want: an identifier or '(' comes next; good: tokens of a valid beginning
    for m in _TOKEN.finditer(text.lower()):
        token = m[0]
        if want:
            if token == "(":
                depth += 1
            elif token == ")" or token in _RANK:
                break
            else:
                want = False
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif token in _RANK:
            want = True
        else:
            break
        tokens.append(token)
        if not want and not depth:
            good = len(tokens)
    if not good:
        return None

    out: list[tuple[list[str], bool]] = []
    ops: list[str] = []

    def apply(op: str) -> None:
        (lb, ok_b), (la, ok_a) = out.pop(), out.pop()
        if op == "with":
            if len(la) == 1:
                la = [f"{la[-1]} with {lb[0]}"]
            else:
                la.extend(lb)
            out.append((la, ok_a))
        else:
            la.extend(lb)  # in place: an expression may be long
            out.append((la, ok_a and ok_b if op == "and" else ok_a or ok_b))

    for token in tokens[:good]:
        if token == "(":
            ops.append(token)
        elif token == ")":
            while ops[-1] != "(":
                apply(ops.pop())
            ops.pop()
        elif token in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[token]:
                apply(ops.pop())
            ops.append(token)
        else:
            name = token.rstrip(".:")
            out.append(([name], name.rstrip("+") in allowed))
    while ops:
        apply(ops.pop())
    return out[0]


def _automaton(base, notices):
    import ahocorasick
    a = ahocorasick.Automaton()
    found: dict[str, list] = {}
    for phrase, label in base:
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT))
    for phrase, label, weight in notices:
        found.setdefault(phrase, []).append(("notice", label, weight))
    found.setdefault(TAG_WORDS, []).append(("tag", "", 0.0))
    for phrase, what in found.items():
        a.add_word(f" {phrase} ", (len(phrase) + 1, what))
    a.make_automaton()
    return a


def scan_text(raw: bytes, automaton, table: bytes, allowed: frozenset = PERMISSIVE) -> tuple:
    """One text's (n_words, n_base, first_word, last_word, base_labels, labels,
    score, expressions, permitted)."""
    words = raw.translate(table).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    n_base, places, base, labels, doubt, tagged = 0, [], set(), set(), {}, False
    at, word = 0, 0
    for end, (back, what) in sorted(automaton.iter(line), key=lambda x: x[0] - x[1][0]):
        start = end - back  # of the space before the phrase
        word += line.count(" ", at, start)
        at = start
        for kind, label, weight in what:
            if kind == "tag":
                tagged = True
                continue
            labels.add(label)
            doubt[label] = min(doubt.get(label, 1.0), 1.0 - weight)
            if kind == "base":
                n_base += 1
                places.append(word)
                base.add(label)
    expressions, verdicts = [], []
    if tagged:
        text = raw.decode("utf-8", "replace")
        tags = [m.span() for m in TAG.finditer(text)]
        for (_, at), (end, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):
            # To the end of the line, or to the next tag.
            line = text[at:end].split("\n", 1)[0]
            if (got := parse_expression(line, allowed)) is not None:
                names, ok = got
                expressions.append(line.strip())
                verdicts.append(ok)
                for name in names:
                    name = name.replace(",", " ")
                    labels.add(name)
                    doubt[name] = min(doubt.get(name, 1.0), 1.0 - TAG_WEIGHT)
    score = 1.0
    for label in sorted(doubt):
        score *= doubt[label]
    return (len(words), n_base, min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 - score, expressions, all(verdicts) if verdicts else None)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE_PHRASES,
                  notices=NOTICES, allowed: frozenset = PERMISSIVE) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, expressions (array), permitted.

    Defined cases: a null text is empty (no words, empty labels, score 0, null
    places); a null id stays null; repeated rows are answered each; other
    columns of ``docs`` are not read, so their names cannot clash; an empty
    table gives an empty result. ``permitted`` is null without an expression.
    """
    kind = docs.schema[id_col].dataType
    schema = (f"`{id_col}` {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double, expressions array<string>, permitted boolean")

    def run(batches):
        table, automaton = TX.split_table(), _automaton(base, notices)
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        for part in TX.slices(batches):
            rows = [scan_text(x or b"", automaton, table, allowed)
                    for x in part.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns],
                                             names=[id_col, "n_words", "n_base", "first_word", "last_word",
                                                    "base_labels", "labels", "score", "expressions", "permitted"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)
