"""Operator 7: personal data by patterns, checksums and context.

Regular expressions propose spans, validators confirm them (Luhn for cards,
octet range for IPs, digit counts for phones, mod-97 for IBANs) and context
words near a span move its score. Redaction masks every confirmed span of a base
kind; the score decides only about the kinds that context adds.

Null or empty text has no spans. A null id stays null. Repeated rows give
repeated results; nothing joins or groups, so ties cannot arise. Input columns
other than id and text are neither read nor returned by ``find``; ``redact``
passes every column through unchanged except the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import map_rows, rows_of, tidied

#: The base kinds in output order, then the kinds that context adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?:password|passwd|secret|api[_-]?key|token)[\x20]?[=:][\x20]?[^\s,;]{8,}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
}
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "write"),
    "ip": ("ip", "host", "server", "address", "login", "addr"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "secret": ("password", "key", "secret", "token", "credential"),
}
#: Score of a validated span without context, and what a context word adds; a run of digits as its own neighbour lowers it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "secret": 0.8}
CONTEXT_GAIN, NEGATIVE_LOSS, WINDOW = 0.15, 0.2, 40
NEGATIVE = ("isbn", "version", "issn", "invoice", "order")
#: An address is what surrounds an at sign; looking outward from it keeps long runs of letters linear.
_AT, _DOMAIN = re.compile("@"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def confirmed(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in found.split("."))
    if kind == "card":
        digits = _NOT_DIGIT.sub("", found)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(_NOT_DIGIT.sub("", found)) <= 15
    if kind == "iban":
        return mod97(found)
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        if domain := _DOMAIN.match(text, m.end()):
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                done = domain.end()
                yield start, done


def proposals(kind: str, text: str) -> Iterator[tuple[int, int]]:
    return emails(text) if kind == "email" else (m.span() for m in PATTERNS[kind].finditer(text))


def scored(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start]) + _WORD.findall(text[end : end + WINDOW])}
    score = BASE_SCORE[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind]) - NEGATIVE_LOSS * any(w in near for w in NEGATIVE)
    return min(1.0, max(0.0, score))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a whole text, by kind in the order of KINDS, then start; code points, end exclusive."""
    found = []
    if not text:
        return found
    at, digit = "@" in text, any(c in text for c in "0123456789")
    for kind in KINDS:
        if kind == "email" and not at or kind in ("ip", "card", "phone", "iban") and not digit:
            continue
        for start, end in proposals(kind, text):
            if confirmed(kind, text[start:end]):
                found.append((kind, start, end, scored(kind, text, start, end)))
    return found


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans: id, kind, start, end, value, score. One row per span; texts without spans give none."""
    schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in rows_of(batches):
            if spans := spans_of(text):
                yield pa.RecordBatch.from_pylist([{"id": key, "kind": k, "start": s, "end": e, "value": text[s:e], "score": score} for k, s, e, score in spans], schema=schema)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(tidied(run), "id bigint, kind string, start bigint, end bigint, value string, score double")


def summary_row(key: int | None, text: str | None) -> tuple:
    spans = spans_of(text)
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
    return key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), max((s[3] for s in spans), default=0.0)


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans and the highest score."""
    ddl = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, max_score double"
    return map_rows(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), summary_row, ddl)


def redacted(text: str | None, least: float = 0.5) -> str | None:
    """The text with each base span, and each other scored ``least`` or more, replaced by its kind; overlapping spans become one mark, of the first."""
    spans = sorted((s, e, k) for k, s, e, score in spans_of(text) if k in BASE_KINDS or score >= least)
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[done:start], f"<{kind.upper()}>"]
        done, i = end, i + 1
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all rows and columns stay. Null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = pa.array((redacted(v.as_py(), least) for v in column), type=column.type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(tidied(run), docs.schema)
