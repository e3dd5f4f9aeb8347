"""License scans: notice phrases and identifier tags by Aho-Corasick, expressions by a shunting yard.

One automaton of word sequences runs over each whole text's words.  A *notice*
names its license itself.  A *tag* announces an expression, which is read from
the raw text behind it: identifiers, parentheses and the operators WITH, AND
and OR, in that order of precedence.  Evaluation gives the labels of the
licenses named and a number from 0 (free of conditions) to 1 (all rights
reserved): of licenses joined by AND the strictest binds, of those joined by OR
the mildest can be chosen, an exception (WITH) takes a part of the left side.

The *base* phrases are counted wherever their words stand consecutively, in
places that may overlap.  A document's score is that of its strictest finding,
0 without any.

Inputs: ``id_col`` integer, ``text_col`` string, any further columns.  A null or
empty text has no words and no findings.  Rows repeated come back as often; an
empty table gives an empty result.  A tag whose expression cannot be read up to
the end of a clause gives no finding; unknown identifiers count only behind an
SPDX tag, under their own lower-cased name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import buffers, slices
from .words import words

#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases.
NOTICES = {
    "apache license": "apache", "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "isc license": "isc",
    "boost software license": "boost", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0 1 0": "cc0", "unlicense": "unlicense",
    "dedicated to the public domain": "public-domain", "no part of this publication may be reproduced": "reserved",
}
#: Phrases that announce an expression; whether a colon or equals sign must follow, and whether unknown identifiers count.
TAGS = {"spdx license identifier": (True, True), "license": (True, False), "licence": (True, False), "licensed under": (False, False), "released under": (False, False)}
#: How strictly each label binds.
STRICT = {
    "public-domain": 0.0, "unlicense": 0.0, "cc0": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "boost": 0.1, "apache": 0.15, "cc-by": 0.2,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "cc-by-nd": 0.8, "agpl": 0.8, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.85,
    "cc-by-nc-nd": 0.9, "reserved": 1.0,
}
#: Strictness of an identifier that is not known.
UNKNOWN = 0.9
#: Share of the left side's strictness that an exception leaves.
EXCEPTION = 0.6
#: Identifier families: the label of an identifier that has this name, alone or before a version.
FAMILIES = ("public-domain", "unlicense", "cc0", "mit", "isc", "bsd", "boost", "bsl", "apache", "mpl", "epl", "lgpl", "agpl", "gpl", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by")
_VERSION = re.compile(r"-?v?\d[\w.]*(-clause)?(-only|-or-later|-international)?\+?|-only|-or-later|\+")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RAW_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_RANK = {"or": 0, "and": 1, "with": 2}


def label_of(identifier: str) -> str | None:
    """The label of a license identifier, null if it is none that is known."""
    name = identifier.lower().rstrip(".")
    for family in FAMILIES:
        if name == family or name.startswith(family) and _VERSION.fullmatch(name[len(family) :]):
            return "boost" if family == "bsl" else family
    return None


Value = tuple[float, frozenset[str]]


def evaluate(text: str, unknown: bool = False, at: int = 0) -> Value | None:
    """Strictness and labels of the whole license expression that begins at ``at``; null if there is none.

    A shunting yard with two stacks.  Reading ends where neither an operator nor
    an operand can follow; ``unknown`` admits identifiers that are not known.
    """
    values: list[Value] = []
    pending: list[str] = []

    def apply() -> None:
        operator, (b, right), (a, left) = pending.pop(), values.pop(), values.pop()
        values.append((a * EXCEPTION, left) if operator == "with" else (min(a, b) if operator == "or" else max(a, b), left | right))

    wants = True
    while token := _TOKEN.match(text, at):
        word = token[1]
        lower = word.lower()
        if wants and word == "(":
            pending.append("(")
        elif wants and word != ")" and lower not in _RANK:
            label = label_of(word)
            if pending[-1:] == ["with"]:
                values.append((0.0, frozenset()))  # any exception
            elif label or unknown:
                values.append((STRICT[label] if label else UNKNOWN, frozenset([label or lower.rstrip(".")])))
            else:
                return None
            wants = False
        elif not wants and word == ")" and "(" in pending:
            while pending[-1] != "(":
                apply()
            pending.pop()
        elif not wants and lower in _RANK:
            while pending and pending[-1] != "(" and _RANK[pending[-1]] >= _RANK[lower]:
                apply()
            pending.append(lower)
            wants = True
        else:
            break
        at = token.end()
    if wants or "(" in pending:
        return None
    while pending:
        apply()
    return values[0]


@cache
def _automaton(base: tuple[tuple[str, str], ...]) -> tuple[ahocorasick.Automaton, int]:
    """Word sequences between blanks with what they stand for, and the most words of one."""
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", dict(base)), ("notice", NOTICES), ("tag", TAGS)):
        for phrase in phrases:
            kinds.setdefault(phrase, []).append((kind, dict(base)[phrase] if kind == "base" else NOTICES[phrase] if kind == "notice" else phrase))
    out = ahocorasick.Automaton()
    for phrase, found in kinds.items():
        out.add_word(f" {phrase} ", (phrase.count(" ") + 1, found))
    out.make_automaton()
    return out, max(p.count(" ") + 1 for p in kinds)


def places(raw: np.ndarray | bytes, base: tuple[tuple[str, str], ...]) -> tuple[int, list[tuple[int, int, str, str]]]:
    """Number of words, and (first word, words, kind, what) of each phrase found."""
    automaton, most = _automaton(base)
    n, tail, out = 0, [], []
    for piece in words(raw):
        line = tail + piece
        joined = b" " + b" ".join(line) + b" "
        text = joined.decode("utf-8", "replace")
        hits = list(automaton.iter(text))
        if hits:
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            for end, (size, found) in hits:
                last = int(np.searchsorted(blanks, end))  # blanks before the one that ends the phrase: its words and those before
                if last > len(tail):
                    out += [(n - len(tail) + last - size, size, kind, what) for kind, what in found]
        n += len(piece)
        tail = line[-(most - 1) :]
    return n, out


#: What may stand between a tag and its expression.
_SIGN = re.compile(r"[\s\"']*[:=][ \t\"']*")
_GAP = re.compile(r"[\s\"']*(the\s+)?", re.I)


def expressions(text: str, tags: list[tuple[int, int, str]]) -> list[Value]:
    """Values of the expressions behind the tags (first word, words, tag) of a text."""
    out, want = [], {first + size - 1: tag for first, size, tag in tags}
    walk = enumerate(_RAW_WORD.finditer(text))
    seen = 0
    for last in sorted(want):
        end = next(islice(walk, last - seen, None))[1].end()
        seen = last + 1
        signed, unknown = TAGS[want[last]]
        gap = (_SIGN if signed else _GAP).match(text, end)
        if gap and (value := evaluate(text, unknown, gap.end())):
            out.append(value)
    return out


def scan(raw: np.ndarray | bytes, base: tuple[tuple[str, str], ...]) -> dict:
    n, found = places(raw, base)
    starts = [first for first, _, kind, _ in found if kind == "base"]
    names = {what for _, _, kind, what in found if kind == "base"}
    values = [(STRICT.get(what, UNKNOWN), frozenset([what])) for _, _, kind, what in found if kind != "tag"]
    tags = [(first, size, what) for first, size, kind, what in found if kind == "tag"]
    if tags:
        values += expressions(bytes(raw).decode("utf-8", "replace"), tags)
    labels = names.union(*(x for _, x in values))
    return {
        "n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(names)),
        "labels": ",".join(sorted(labels)), "score": max((v for v, _ in values), default=0.0),
        "findings": [{"start": first, "words": size, "kind": kind, "what": what} for first, size, kind, what in sorted(found)],
    }


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("findings", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("kind", pa.string()), ("what", pa.string())])))]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, findings), one for each row of ``docs``."""
    own = tuple((BASE if base is None else base).items())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                found = [scan(data[a:b], own) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                columns = [pa.array([x[name] for x in found], kind) for name, kind in _FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["id", *[name for name, _ in _FIELDS]])

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, findings array<struct<start:long,words:long,kind:string,what:string>>"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
