"""Bibliography texts: BibTeX, RIS, plain reference lists, and telling them apart.

Each parser takes one whole text and gives rows; ``entries`` applies them to a
DataFrame of texts, one row per entry, so that files are parsed in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.functions.text import blank_to_null
from refsieve.sources.context import parse

ENTRY_DDL = "citekey string, entry_type string, fields map<string,string>, line int, issue string"
TEXT_DDL = "key string, raw string, pmid string, doi string, arxiv_id string, claimed_title string, claimed_authors array<string>, claimed_journal string, claimed_year string, claimed_source_format string, routable boolean, title_search_candidate boolean"


def sniff(text: Column) -> Column:
    """bib, ris or unknown, by the first telling line within 4096 characters."""
    head = F.substring(text, 1, 4096)
    bib, ris = F.regexp_instr(head, F.lit(r"(?m)^\s*@\w+\s*[{(]")), F.regexp_instr(head, F.lit(r"(?m)^\s*TY  -"))
    return F.when((bib > 0) & ((ris == 0) | (bib < ris)), "bib").when(ris > 0, "ris").otherwise("unknown")


def _clean(value: str) -> str:
    value = value.strip()
    while len(value) > 1 and (value[0], value[-1]) in (("{", "}"), ('"', '"')):
        value = value[1:-1].strip()
    return " ".join(re.sub(r"\\([&%#_$])", r"\1", value.replace("{", "").replace("}", "")).split())


def _closing(text: str, at: int, opened: str) -> int:
    """The place of the bracket that closes the one before ``at``, or -1. Quotes do not nest braces."""
    shut = "}" if opened == "{" else ")"
    depth = 1
    for m in re.compile(r"[{}]" if opened == "{" else r"[{}()]").finditer(text, at):
        c = m[0]
        depth += 1 if c == opened else -1 if c == shut else 0
        if depth == 0:
            return m.start()
    return -1


def _fields(body: str) -> dict[str, str]:
    out, at = {}, 0
    name = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*")
    while m := name.match(body, at):
        at, depth, quoted = m.end(), 0, False
        start = at
        while at < len(body):
            c = body[at]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c == '"' and depth == 0:
                quoted = not quoted
            elif c == "," and depth == 0 and not quoted:
                break
            at += 1
        out[m[1].lower()] = _clean(body[start:at])
    return out


def keyed(inner: str) -> tuple[str, dict[str, str]]:
    """The key (perhaps empty) and the fields of what stands between an entry's brackets."""
    key, _, body = inner.partition(",")
    return key.strip(), _fields(body)


def bibtex(text: str) -> Iterator[tuple]:
    """(citekey, type, fields, line, issue). An entry that does not close is an issue and ends the text."""
    at = line = made = 0
    head = re.compile(r"@\s*(\w+)\s*([{(])")
    while m := head.search(text, at):
        line += text.count("\n", at, m.start())
        kind, end = m[1].lower(), _closing(text, m.end(), m[2])
        if end < 0:
            yield None, kind, {}, line + 1, "ERROR unclosed entry"
            return
        if kind not in ("string", "preamble", "comment"):
            key, fields = keyed(text[m.end() : end])
            made += not key
            yield key or f"anon{made}", kind, fields, line + 1, None
        line += text.count("\n", m.start(), end)
        at = end


def ris(text: str) -> Iterator[tuple]:
    """The same of RIS: repeated tags are joined, continued lines folded; a record without its end is kept, with an issue."""
    tag = re.compile(r"^\s*([A-Z][A-Z0-9])  -\s?(.*)$")
    now: dict[str, list[str]] | None = None
    start = number = 0
    last = ""

    def done(issue: str | None) -> tuple:
        fields = {k.lower(): "; ".join(v) for k, v in now.items()}
        return fields.get("id") or f"ris{number}", fields.get("ty", "").lower(), fields, start, issue

    for n, line in enumerate(text.splitlines(), 1):
        if m := tag.match(line):
            last, value = m[1], m[2].strip()
            if last == "TY":
                if now is not None:
                    yield done("ERROR record without ER")
                now, start, number = {"TY": [value]}, n, number + 1
            elif last == "ER" and now is not None:
                yield done(None)
                now = None
            elif now is not None:
                now.setdefault(last, []).append(value)
        elif now is not None and line.strip() and now.get(last):
            now[last][-1] += " " + line.strip()
    if now is not None:
        yield done("ERROR record without ER")


def _frames(parser: Callable[[str], Iterator[tuple]], width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, *row) for k, t in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) if t for row in parser(t)], columns=range(width))

    return run


def entries(texts: DataFrame, form: str, key: str = "path", text: str = "text") -> DataFrame:
    """Entries of BibTeX ("bib") or RIS ("ris") texts: key and ENTRY_DDL."""
    source = texts.select(F.col(key).cast("string"), text)
    return source.mapInPandas(_frames({"bib": bibtex, "ris": ris}[form], 6), f"{key} string, {ENTRY_DDL}")


def bib_view(found: DataFrame) -> DataFrame:
    """RIS entries with the fields that BibTeX has: journal, note, doi, title, year, author, pmid."""
    f = lambda k: blank_to_null(F.try_element_at("fields", F.lit(k)))
    arxiv = F.regexp_replace(F.coalesce(f("ur"), F.lit("")), r"(?i)https?://arxiv\.org/(?:abs|pdf)/", "arxiv:")
    made = {"title": F.coalesce(f("ti"), f("t1")), "author": F.coalesce(f("au"), f("a1")), "journal": F.coalesce(f("jo"), f("t2"), f("jf"), f("ja")), "year": F.regexp_extract(F.coalesce(f("py"), f("y1"), F.lit("")), r"(\d{4})", 1), "doi": f("do"), "note": blank_to_null(F.concat_ws(" ", f("n1"), f("u1"), arxiv)), "pmid": F.when(f("an").rlike(r"^\d+$"), f("an"))}
    packed = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in made.items()]), lambda e: e["value"].isNotNull()))
    return found.withColumn("fields", packed)


def routed(found: DataFrame) -> DataFrame:
    """Entries with route (pmid, doi, arxiv or none) and id: PMID field, PMID in the note, DOI, eprint or arXiv mention."""
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    pmid = F.coalesce(F.when(f("pmid").rlike(r"^\d+$"), f("pmid")), F.nullif(F.regexp_extract(f("note"), r"(?i)PMID[:\s]*(\d{4,9})(?!\d)", 1), F.lit("")))
    arxiv = F.coalesce(blank_to_null(f("eprint")), F.nullif(F.regexp_extract(F.concat_ws(" ", f("journal"), f("note")), r"(?i)arxiv:\s*([\w.\-/]+)", 1), F.lit("")))
    doi = blank_to_null(f("doi"))
    route = F.when(pmid.isNotNull(), "pmid").when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").otherwise("none")
    return found.withColumns({"route": route, "id": F.coalesce(pmid, doi, arxiv)})


_NUMBERED = re.compile(r"^\s*(?:\[(\d{1,3})\]|(\d{1,3})[.、)．])\s*")
_HASH = re.compile(r"^#{1,6}\s+")


def split_list(text: str) -> list[str]:
    """Entries of a pasted list: numbered if two lines are, else by headings if two are, else a line each.

    A heading among plain lines is an entry in its place.
    """
    lines = [ln.strip() for ln in text.splitlines() if ln.strip()]
    for start in (_NUMBERED, _HASH):
        if sum(bool(start.match(ln)) for ln in lines) >= 2:
            out: list[str] = []
            for ln in lines:
                if start.match(ln):
                    out.append(start.sub("", ln))
                elif out:
                    out[-1] += ("\n" if start is _HASH else " ") + ln
            return [e for e in out if e.strip()]
    return [_HASH.sub("", ln) for ln in lines]


def list_row(raw: str) -> tuple:
    """TEXT_DDL without the key. Ids: the last PMID, then a DOI, then an arXiv id; without any, a title to search if long enough."""
    from_doi, from_arxiv = re.compile(r"(?i)(10\.\d{4,9}/[^\s\"'<>),;\]?&=]+)"), re.compile(r"(?i)arxiv(?:\.org/(?:abs|pdf)/|:\s*)([^\s\"'<>),;\]]+)")
    pmids = re.findall(r"(?i)PMID[:\s]*(\d{4,9})", raw)
    doi, arxiv = from_doi.search(raw), from_arxiv.search(raw)
    pmid = pmids[-1] if pmids else None
    doi_id = doi[1].lower().rstrip(".,;:") if doi and not pmid else None
    arxiv_id = arxiv[1].rstrip(".") if arxiv and not pmid and not doi_id else None
    claim = parse(raw)
    known = bool(pmid or doi_id or arxiv_id)
    search = not known and (len(claim.title) >= 15 or bool(re.search(r"[一-鿿]", raw)) and len(raw) >= 12)
    return raw, pmid, doi_id, arxiv_id, claim.title, claim.authors, claim.journal, claim.year, claim.form, known, search


def plain_list(text: str) -> Iterator[tuple]:
    """Rows of TEXT_DDL."""
    for n, raw in enumerate(split_list(text), 1):
        yield f"L{n}", *list_row(raw)


def text_entries(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    source = texts.select(F.col(key).cast("string"), text)
    return source.mapInPandas(_frames(plain_list, 13), f"{key} string, {TEXT_DDL.replace('key string', 'entry string')}")


def split_issues(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that can be looked up or searched, and the rest."""
    usable = F.col("routable") | F.col("title_search_candidate")
    return found.where(usable), found.where(~usable)
