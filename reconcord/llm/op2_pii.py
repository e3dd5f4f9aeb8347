"""Personal data by weak-supervision aggregation.

Spans of four kinds (email, ip, card, phone) come from two sets of patterns.
Strict patterns give the base spans, which always stay.  Looser patterns give
further candidates: spelled-out addresses, eight-group addresses, phone
numbers without a plus sign, card numbers of 13 digits or with other marks.

Three labelers vote on every span: *regex* (its shape), a *gazetteer* (domain
endings, issuer prefixes, calling codes, reserved ranges) and *context* (cue
words before it).  A vote is against, abstain or for.  Expectation-maximisation
estimates, per kind, how each labeler votes given the truth, and so how likely
each span is; a logistic span classifier over the votes and six features of
the span is then trained on these probabilities.  A candidate is kept if the
classifier gives it one half or more.

Votes and features are small codes, so both models are fitted on counts of
(kind, code) over all spans of all texts; there are at most ``4 * 27 * 64``
of these, whatever the input.  Every text is scanned whole, twice: for the
counts and for the spans.  No text is shuffled.

Positions are code points, ends exclusive.  A null or empty text has no spans.
Overlapping spans of several kinds all stay in the list; redaction merges them.
Rows come back one for one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = r"[A-Za-z0-9._%+-]"
_HOST = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT = re.compile(rf"{_LOCAL}++{_HOST}")
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_HOST}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: An address in words, found from its "at": the name before it and the host after it, however long.
_AT = re.compile(r"[aA][tT][\x20\])]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
_SPELLED_HOST = re.compile(r"(?i)[A-Za-z0-9-]++(?:(?: dot |\s?[\[(]dot[\])]\s?|\.)[A-Za-z]++)+")
_SIX = re.compile(r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{3,4}){3}(?![0-9])|(?<![0-9])[0-9]{13}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

#: Common domain endings, card issuers' prefixes, calling codes.
_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ng us ca au ch at be eu".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "34", "37", "36", "38", "6011", "65", "35", "5060", "5061", "6500")
_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91", "234")
_CUES = {
    EMAIL: re.compile(r"(?i)e-?mail|contact|write|reach|correo|courriel|kontakt"),
    IP: re.compile(r"(?i)\bip\b|server|host|address|login|adresse|direcci"),
    CARD: re.compile(r"(?i)card|visa|master|credit|debit|payment|karte|carte|tarjeta"),
    PHONE: re.compile(r"(?i)phone|tel|call|fax|mobile|cell|whatsapp|anruf|appel|llama"),
}
_AGAINST = re.compile(r"(?i)version|\bv$|isbn|order|\bno\.?$|\bid\b|serial|build|sha|token|key")
CONTEXT = 32


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, sorted."""
    out = []
    if "@" in text:
        at = 0
        while m := _EMAIL_AT.match(text, at) or _EMAIL.search(text, at):
            out.append((m.start(), EMAIL, m.end()))
            at = m.end()
    if _DIGIT.search(text):
        out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
                out.append((m.start(), CARD, m.end()))
        if "+" in text:
            out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that overlap no base span."""
    out = []
    at = 0  # names of one text share no character, so each is read once
    for m in _AT.finditer(text):
        start, stop = m.start() - 1, m.end()
        if start < 0 or text[start] not in (" " if text[stop - 1] == " " else "[("):
            continue
        if text[start] != " ":  # bracketed: white space may stand around it
            start -= start > 0 and text[start - 1].isspace()
            stop += text[stop : stop + 1].isspace()
        name = start
        while name > at and text[name - 1] in _NAME_CHARS:
            name -= 1
        if name < start and (host := _SPELLED_HOST.match(text, stop)):
            out.append((name, EMAIL, host.end()))
            at = host.end()
    if text.count(":") >= 7:
        out += [(m.start(), IP, m.end()) for m in _SIX.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), CARD, m.end()) for m in _LOOSE_CARD.finditer(text)]
        out += [(m.start(), PHONE, m.end()) for m in _LOOSE_PHONE.finditer(text)]
    if not out:
        return out
    busy = sorted((s, e) for s, _, e in taken)
    starts, reach = [s for s, _ in busy], np.maximum.accumulate([e for _, e in busy]) if busy else []
    free = lambda s, e: (k := int(np.searchsorted(starts, e))) == 0 or reach[k - 1] <= s
    return sorted(x for x in set(out) if free(x[0], x[2]))


def code_of(text: str, start: int, kind: int, end: int, base: bool) -> int:
    """Votes (three of 0 against, 1 abstain, 2 for) and six feature bits of a span."""
    s, d = text[start:end], _digits(text[start:end])
    if kind == EMAIL:
        shape = 2 if base or "dot" in s.lower() else 0
        tail = re.split(r"[^A-Za-z]+", s)[-1].lower()
        known = 2 if tail in _ENDINGS else 0
    elif kind == IP:
        shape = 2
        known = 0 if s.startswith(("0.", "255.")) else 2 if base else 1
    elif kind == CARD:
        shape = 2 if _luhn(d) else 0
        known = 2 if d.startswith(_ISSUERS) else 0
    else:
        shape = 2 if base else 1
        known = 2 if d.startswith(_CODES) or not base and d[:1] not in "01" else 0
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    cue = bool(_CUES[kind].search(before))
    context = 2 if cue else 0 if _AGAINST.search(before) else 1
    bits = [base, any(c in s for c in " -()"), not before or not before[-1].isalnum(), not after or not after.isalnum(), len(d) >= 12, cue]
    return ((shape * 3 + known) * 3 + context) * 64 + sum(1 << i for i, b in enumerate(bits) if b)


def fit(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Probability that a span of (kind, code) is real, from the counts of all spans."""
    out: dict[tuple[int, int], float] = {}
    for kind in range(len(KINDS)):
        rows = sorted((code, n) for (k, code), n in counts.items() if k == kind)
        if not rows:
            continue
        code, n = (np.array(x, np.float64) for x in zip(*rows, strict=True))
        code = code.astype(np.int64)
        votes = np.stack([code // 64 // 9, code // 64 // 3 % 3, code // 64 % 3], 1)
        p = 1 / (1 + np.exp(-(votes - 1).sum(1)))  # majority, to begin with
        for _ in range(rounds):
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            odds = np.full(len(n), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                yes, no = (np.array([(n * q)[votes[:, j] == v].sum() + a for v, a in enumerate(alpha)]) for q, alpha in ((p, (0.5, 1, 2)), (1 - p, (2, 1, 0.5))))
                odds += np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = np.concatenate([np.ones((len(n), 1)), votes == 2, votes == 0, (code[:, None] >> np.arange(6)) & 1], 1).astype(np.float64)
        w = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps with a ridge
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - q)) - w
            hess = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w))
            w = w + np.linalg.solve(hess, grad)
        out |= {(kind, int(c)): float(q) for c, q in zip(code, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                base = base_spans(text)
                found.update((k, code_of(text, s, k, e, True)) for s, k, e in base)
                found.update((k, code_of(text, s, k, e, False)) for s, k, e in loose_spans(text, base))
        rows = [(k, c, n) for (k, c), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["kind", "code", "n"])


def fit_spans(docs: DataFrame, text_col: str = "text") -> frozenset[tuple[int, int]]:
    """The (kind, code) that the trained classifier accepts."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_rows, "kind int, code int, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    odds = fit({(r["kind"], r["code"]): r["n"] for r in counts.collect()})
    return frozenset(k for k, p in odds.items() if p >= 0.5)


def spans_of(text: str | None, accepted: frozenset[tuple[int, int]]) -> tuple[list, list]:
    """Base spans and all spans, each sorted by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(s, k, e) for s, k, e in loose_spans(text, base) if (k, code_of(text, s, k, e, False)) in accepted]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span (overlapping ones as one, named by the first) replaced by its kind in angle brackets."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while (i := i + 1) < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _span_rows(accepted: frozenset):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text, accepted)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return rows


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans); spans are kind:start:end, joined by commas."""
    accepted = fit_spans(docs, text_col)
    schema = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_span_rows(accepted), schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced; all other columns and all rows as they were."""
    accepted = fit_spans(docs, text_col)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            text = pa.array([redacted(t, spans_of(t, accepted)[1]) for t in column.to_pylist()], column.type)
            yield batch.set_column(at, batch.schema.field(at), text)

    return docs.mapInArrow(rows, docs.schema)
