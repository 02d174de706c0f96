"""Identifiers in text: PMIDs, DOIs and arXiv ids with context, as a generator over texts and as a DataFrame operator."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The patterns of each kind, in the order in which hits are emitted.
PMID = (r"(?i)PMID[:\s]*(\d{4,9})", r"(?i)pubmed[:\s]*(\d{4,9})", r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{4,9})/")
DOI = (r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)(10\.\d{4,9}/[^\s\"'<>),;\]?&=]+)", r"(?i)\b(10\.\d{4,9}/[^\s\"'<>),;\]?&=]+)")
ARXIV = (r"(?i)arxiv\.org/(?:abs|pdf|format)/([^\s\"'<>),;\]]+)", r"(?i)arxiv:\s*([^\s\"'<>),;\]]+)")
_PREFIX = re.compile(r"(?:(?:https?://(?:dx\.)?doi\.org/|dx\.doi\.org/|doi\.org/|doi:)\s*)+")
_TAIL = ".,;:。，；）」】)]}!?！？\"”’' \t\n"
#: Characters of context before and after a hit.
WINDOW = {"pmid": (200, 40), "doi": (200, 40), "arxiv": (150, 40)}
_COMPILED = {"pmid": [re.compile(p) for p in PMID], "doi": [re.compile(p) for p in DOI], "arxiv": [re.compile(p) for p in ARXIV]}


def tidy_doi(raw: str) -> str:
    """The clean form of a DOI in Python, as ``functions.text.clean_doi`` gives it."""
    s = raw.strip().lower()
    if m := _PREFIX.match(s):
        s = s[m.end() :]
    return s.split("?", 1)[0].rstrip(_TAIL)


def hits(text: str | None, kind: str) -> Iterator[tuple[str, str, int, int]]:
    """(id, context, pattern number, position). PMIDs keep repeats; DOIs and arXiv ids come once a text, the first one."""
    seen: set[str] = set()
    before, after = WINDOW[kind]
    for number, pattern in enumerate(_COMPILED[kind]):
        for m in pattern.finditer(text or ""):
            found = m[1]
            if kind == "doi":
                found = tidy_doi(found)
            elif kind == "arxiv":
                found = re.sub(r"(?i)^arxiv:", "", found.strip()).rstrip(".")
            key = found.lower()
            if kind != "pmid" and (key in seen or not key or kind == "doi" and "/" not in key):
                continue
            seen.add(key)
            yield found, text[max(0, m.start() - before) : m.end() + after].replace("\n", " ").strip(), number, m.start()


def extract(documents: DataFrame, kinds: tuple[str, ...] = ("pmid", "doi", "arxiv"), key: str = "path", text: str = "text") -> DataFrame:
    """(key, id_kind, id, context, pattern_no, pos) of all hits; one pass over the texts for all kinds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, kind, *hit) for k, t in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) if t for kind in kinds for hit in hits(t, kind)]
            yield pd.DataFrame(rows, columns=["key", "id_kind", "id", "context", "pattern_no", "pos"])

    source = documents.select(key, text)
    return source.mapInPandas(run, f"key {source.schema[0].dataType.simpleString()}, id_kind string, id string, context string, pattern_no long, pos long").withColumnRenamed("key", key)
