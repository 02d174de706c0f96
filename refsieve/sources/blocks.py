"""Bibliography files of any size: BibTeX, RIS and plain lists, read by blocks of lines.

Whether a line begins an entry depends on what is open before it. A first pass sums
up each piece of a block as what it does to anything that may be open; a walk over
a file's sums, one row for each MB of it, tells what is open where a block begins.
The second pass reads each block from there. Of entries that go on past a block's
end the parts are shuffled and put together; all others stay where they were read.

The rows are those of ``bibliography`` for the whole text of a file. Lines that are
null count as empty, empty files have no entries. One entry is one row of Spark; of
a BibTeX entry that nothing closes only its head is kept, as an issue.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refsieve.operators.durable import written
from refsieve.sources import bibliography

c = F.col

#: Characters summed up at once. They set the memory of a task, not the result.
PIECE = 1 << 20
_SUMS = "path string, block long, piece int, effect string"
_STARTS = "path string, block long, state string"
_PARTS = "path string, block long, nth long, line long, part long, whole boolean, text string, issue string"


def _of_blocks(frames: Iterator[pd.DataFrame], third: str) -> Iterator[tuple[str, int, object, Iterator[str]]]:
    """(path, block, value of ``third``, lines): the blocks of rows that come in order, read as they come."""
    rows = (row for f in frames for row in zip(f["path"], f["block"], f[third], f["text"], strict=True))
    for (path, block, value), lines in groupby(rows, key=lambda r: r[:3]):
        yield path, block, value, (text or "" for *_, text in lines)


class Bib:
    """BibTeX. Open before a block: nothing ("out", the beginning of a head if the lines end in one, its line), or an entry (its bracket, depth, the block it began in)."""

    sep = "\n"
    first = ["out", "", 0]
    token = r"(@\s*+\w++\s*+)?+[{(]|[})]"
    tail = r"@\s*+\w*+\s*+\Z"

    def lines(self, line: str) -> list[str]:
        return [line]

    def effect(self, lines: list[str]) -> dict:
        """What the lines do: from outside, after "@", after "@word", and to a bracket of each depth."""
        text = "\n".join(lines) + "\n"
        tokens = [(m[0][-1], len(m[0]) > 1) for m in re.finditer(self.token, text)]
        partner, after, marks = {}, {}, {}
        for opened, shut in ("{}", "()"):
            held, loose = [], []
            for i, (ch, _) in enumerate(tokens):
                if ch == opened:
                    held.append(i)
                elif ch == shut and held:
                    partner[held.pop()] = i
                elif ch == shut:
                    loose.append(i)
            # An entry that stays open is as deep as there are open brackets from its own on.
            after |= {i: len(held) - n for n, i in enumerate(held)}
            marks[opened] = (loose, len(held))
        m = re.search(self.tail, text)
        ends = [None] * len(tokens) + [["out", "@" + m[0][1:].strip(), text.count("\n", 0, m.start())] if m else ["out", "", 0]]

        def head(i: int) -> list:
            return ends[partner[i] + 1] if i in partner else [tokens[i][0], after[i]]

        for i in range(len(tokens) - 1, -1, -1):
            ends[i] = head(i) if tokens[i][1] else ends[i + 1]
        made = {"n": len(lines), "out": ends[0]}
        for pending, go, stay in (("@", r"\s*+\w++\s*+[{(]", r"\s*+\w*+\s*+"), ("@w", r"\s*+[{(]", r"\s*+")):
            if re.match(go, text):
                made[pending] = head(0)
            elif re.fullmatch(stay, text):
                made[pending] = ["out", text.strip(), None]
            else:
                made[pending] = ends[0]
        for opened, (loose, left) in marks.items():
            exits: list[list] = []
            for depth, i in enumerate(loose, 1):
                if not exits or exits[-1][1] != ends[i + 1]:
                    exits.append([depth, ends[i + 1]])
            made[opened] = [len(loose), left, exits]
        return made

    def walk(self, state: list, does: dict, line: int, block: int, plan: None) -> list:
        if state[0] == "out":
            end = does["out" if not state[1] else "@" if state[1] == "@" else "@w"]
            if end[0] == "out":
                return ["out", state[1] + end[1], state[2]] if end[2] is None else ["out", end[1], line + end[2]]
            return [*end, block]
        loose, left, exits = does[state[0]]
        if state[1] > loose:
            return [state[0], state[1] - loose + left, state[2]]
        end = next(e for depth, e in reversed(exits) if depth <= state[1])
        return ["out", end[1], line + end[2]] if end[0] == "out" else [*end, block]

    def plan(self, effects: list[dict]) -> None:
        return None

    def unclosed(self, state: list) -> int | None:
        return None if state[0] == "out" else state[2]

    def read(self, state: list, line: int, block: int, lost: int | None, lines: Iterator[str]) -> Iterator[tuple]:
        """(start, nth, line, part, whole, text, issue): entries that the lines hold, and the parts of those cut by the block's ends."""
        head, bracket, tail = re.compile(r"@\s*+(\w++)\s*+([{(])"), {"{": re.compile("[{}]"), "(": re.compile("[()]")}, re.compile(self.tail)
        mode, depth, start = (None, 0, block) if state[0] == "out" else state
        held, held_line = state[1:] if mode is None else ("", 0)
        nth, began, kind, parts = 0, None, "", []
        if mode and start == lost:
            return
        for now, body in enumerate(lines, line + 1):
            # Of what an entry says, a line holds all from ``begin`` on; what a head began with stands before it.
            pos = begin = lead = 0
            if held:
                body, lead = f"{held}\n{body}", len(held) + 1
            while True:
                if mode is None:
                    m = head.search(body, pos) or tail.search(body, pos)
                    if m:
                        held_line = held_line if m.start() < lead else now
                    held = "@" + m[0][1:].strip() if m and not m.lastindex else ""
                    if not (m and m.lastindex):
                        break
                    mode, depth, start, began, kind, parts = m[2], 1, block, held_line, m[1].lower(), []
                    begin, pos, nth = m.start(), m.end(), nth + 1
                shut = 0
                for b in bracket[mode].finditer(body, pos):
                    depth += 1 if b[0] == mode else -1
                    if depth == 0:
                        shut = b.end()
                        break
                parts.append(body[begin : shut or None])
                if not shut:
                    break
                yield start, nth if began else None, began, block, began is not None, "\n".join(parts), None
                mode, pos, parts = None, shut, []
        if mode and began and lost == block:
            yield block, nth, began, block, True, f"@{kind}{mode}", "ERROR unclosed entry"
        elif mode:
            yield start, nth if began else None, began, block, False, "\n".join(parts), None

    key, ddl, glue = "citekey", bibliography.ENTRY_DDL, "\n"

    def row(self, text: str, line: int, issue: str | None) -> tuple | None:
        """An entry's row, its key null if it is to be numbered, and whether it counts as numbered."""
        kind, inner = re.match(r"@\s*(\w+)\s*[{(]((?s:.*))", text).groups()
        if issue:
            return None, kind.lower(), {}, line, issue, False
        if kind.lower() in ("string", "preamble", "comment"):
            return None
        key, fields = bibliography.keyed(inner[:-1])
        return key or None, kind.lower(), fields, line, None, not key

    prefix = "anon"


class _Marked:
    """Texts whose entries begin with a line of their own. Open before a block: nothing or the entry of an earlier one."""

    sep = None

    def lines(self, line: str) -> list[str]:
        return f"{line}\n".splitlines()

    def unclosed(self, state: list) -> int | None:
        return None

    def parts(self, state: list, line: int, block: int, lines: Iterator[str], mark: Callable[[str], str | None]) -> Iterator[tuple]:
        """As ``Bib.read``; ``mark`` tells of a line whether it begins an entry, ends one, goes on with it or says nothing."""
        start, began, nth, held = state[-1], None, 0, []
        for now, body in enumerate((x for raw in lines for x in self.lines(raw)), line + 1):
            what, body = mark(body)
            if what == "begin":
                if start is not None and held:
                    yield start, nth if began else None, began, block, began is not None, self.glue.join(held), None
                start, began, nth, held = block, now, nth + 1, []
            if what and start is not None:
                held.append(body)
            if what == "end" and start is not None:
                yield start, nth if began else None, began, block, began is not None, self.glue.join(held), None
                start, held = None, []
        if start is not None and held:
            yield start, nth if began else None, began, block, False, self.glue.join(held), None


class Ris(_Marked):
    """RIS. A record goes from its TY to its ER, or to the next TY."""

    first = ["open", None]
    tag = r"^\s*([A-Z][A-Z0-9])  -\s?"
    key, ddl, prefix, glue = "citekey", bibliography.ENTRY_DDL, "ris", "\n"

    def effect(self, lines: list[str]) -> dict:
        tags = [m[1] for x in lines if (m := re.match(self.tag, x)) and m[1] in ("TY", "ER")]
        return {"n": len(lines), "last": tags[-1] if tags else None}

    def plan(self, effects: list[dict]) -> None:
        return None

    def walk(self, state: list, does: dict, line: int, block: int, plan: None) -> list:
        return ["open", block if does["last"] == "TY" else None] if does["last"] else state

    def read(self, state: list, line: int, block: int, lost: int | None, lines: Iterator[str]) -> Iterator[tuple]:
        tag, does = re.compile(self.tag), {"TY": "begin", "ER": "end"}

        def mark(x: str) -> tuple[str, str]:
            m = tag.match(x)
            return does.get(m[1], "go") if m else "go", x

        return self.parts(state, line, block, lines, mark)

    def row(self, text: str, line: int, issue: str | None) -> tuple | None:
        _, kind, fields, _, said = next(bibliography.ris(text))
        return fields.get("id") or None, kind, fields, line, said, True


class PlainList(_Marked):
    """A pasted list. The whole file tells whether its entries are numbered, below headings or a line each."""

    first = ["", None]
    key, ddl, prefix, glue = "entry", bibliography.TEXT_DDL.replace("key string", "entry string"), "L", " "

    def effect(self, lines: list[str]) -> dict:
        bare = [x.strip() for x in lines]
        return {"n": len(lines), "numbered": sum(bool(bibliography._NUMBERED.match(x)) for x in bare), "heading": sum(bool(bibliography._HASH.match(x)) for x in bare)}

    def plan(self, effects: list[dict]) -> str:
        return next((kind for kind in ("numbered", "heading") if sum(e[kind] for e in effects) >= 2), "plain")

    def walk(self, state: list, does: dict, line: int, block: int, plan: str) -> list:
        return [plan, block if plan != "plain" and does[plan] else state[1]]

    def read(self, state: list, line: int, block: int, lost: int | None, lines: Iterator[str]) -> Iterator[tuple]:
        begins = {"numbered": bibliography._NUMBERED, "heading": bibliography._HASH}.get(state[0])
        self.glue = "\n" if state[0] == "heading" else " "

        def mark(x: str) -> tuple[str, str]:
            x = x.strip()
            if begins is None and x:
                return "begin", bibliography._HASH.sub("", x)
            return ("begin", begins.sub("", x)) if x and begins.match(x) else ("go" if x else "", x)

        for start, nth, began, part, whole, text, issue in self.parts(state, line, block, lines, mark):
            # The parts of an entry are joined by what its lines are joined by.
            yield start, nth, began, part, whole or begins is None, text if whole or part == start else self.glue + text, issue

    def row(self, text: str, line: int, issue: str | None) -> tuple | None:
        return (None, *bibliography.list_row(text), True) if text.strip() else None


FORMS = {"bib": Bib, "ris": Ris, "list": PlainList}


def lines(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(path, block, at, text): the lines of the files at ``path``; ``at`` orders those of one block."""
    reader = spark.read.option("lineSep", FORMS[form].sep) if FORMS[form].sep else spark.read
    return reader.text(path).select(c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), c("value").alias("text"))


def _sums(form: str, piece: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = FORMS[form]()
        for path, block, _, found in _of_blocks(frames, "none"):
            held, size, n = [], 0, 0
            for line in found:
                held += one.lines(line)
                size += len(line) + 1
                if size >= piece:
                    yield pd.DataFrame([(path, block, n, json.dumps(one.effect(held)))])
                    held, size, n = [], 0, n + 1
            if held:
                yield pd.DataFrame([(path, block, n, json.dumps(one.effect(held)))])

    return run


def _starts(form: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(sums: pd.DataFrame) -> pd.DataFrame:
        one, out, line = FORMS[form](), [], 0
        sums = sums.sort_values(["block", "piece"])
        effects = [json.loads(e) for e in sums["effect"]]
        plan, state = one.plan(effects), one.first
        if plan:
            state = [plan, None]
        for block, piece, does in zip(sums["block"], sums["piece"], effects, strict=True):
            if piece == 0:
                out.append((int(block), state, line))
            state = one.walk(state, does, line + 1, int(block), plan)
            line += does["n"]
        lost = one.unclosed(state)
        return pd.DataFrame([(sums["path"].iloc[0], block, json.dumps([state, line, lost])) for block, state, line in out])

    return run


def _read(form: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, rows = FORMS[form](), []
        for path, block, said, found in _of_blocks(frames, "state"):
            state, line, lost = json.loads(said)
            for start, nth, began, part, whole, text, issue in one.read(state, line, block, lost, found):
                rows.append((path, start, nth, began, part, whole, text, issue))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows)
                    rows = []
        yield pd.DataFrame(rows, columns=range(8))

    return run


def _rows(form: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = FORMS[form]()
        for f in frames:
            found = [(p, b, int(n), one.row(t, int(line), issue)) for p, b, n, line, t, issue in zip(f["path"], f["block"], f["nth"], f["line"], f["text"], f["issue"], strict=True)]
            made = [(p, b, n, *row) for p, b, n, row in found if row]
            if made:
                yield pd.DataFrame(made)

    return run


def entries_of(raw: DataFrame, form: str, piece: int = PIECE, in_order: bool = False) -> DataFrame:
    """``bibliography``'s rows of BibTeX ("bib"), RIS ("ris") or plain list ("list") texts that come as lines (path, block, at, text).

    ``in_order`` says that a block's lines lie in one partition in their order, as
    ``lines`` reads them; else they are brought there.
    """
    one = FORMS[form]()
    raw = raw.select(c("path").cast("string").alias("path"), c("block").cast("long").alias("block"), "at", "text")
    if not in_order:
        raw = raw.repartition("path", "block")
    order = ["path", "block", "at"]
    placed = raw if in_order else raw.sortWithinPartitions(*order)
    glue = "" if form == "list" else one.glue
    sums = placed.select("path", "block", F.lit(0).alias("none"), "text").mapInPandas(_sums(form, piece), _SUMS)
    starts = written(written(sums, "block-sums").groupBy("path").applyInPandas(_starts(form), _STARTS), "block-starts")
    # Few rows beside the lines: Spark broadcasts them while they are small, and otherwise shuffles; either way a block's lines meet in one task.
    told = raw.join(starts, ["path", "block"]).sortWithinPartitions(*order).select("path", "block", "state", "text")
    parts = written(told.mapInPandas(_read(form), _PARTS), "block-entries")
    cut = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = parts.where("not whole").groupBy("path", "block").agg(F.max("nth").alias("nth"), F.max("line").alias("line"), F.array_join(F.transform(cut, lambda x: x["text"]), glue).alias("text"), F.max("issue").alias("issue"))
    keep = ["path", "block", "nth", "line", "text", "issue"]
    made = parts.where("whole").select(*keep).unionByName(joined.select(*keep)).mapInPandas(_rows(form), f"path string, block long, nth long, {one.ddl}, counts boolean")
    return _numbered(written(made, "block-rows"), one.key, one.prefix).select("path", *[x for x in made.columns if x not in ("path", "block", "nth", "counts")])


def _numbered(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows with the keys that they lack: ``prefix`` and their place among a file's rows that count."""
    counted = rows.where("counts").groupBy("path", "block").agg(F.count("*").alias("k"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("path", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("path", "block").orderBy("nth")
    placed = rows.where("counts").withColumn("place", F.row_number().over(within)).join(offsets, ["path", "block"])
    named = placed.withColumn(key, F.coalesce(c(key), F.concat(F.lit(prefix), (c("place") + c("before")).cast("string"))))
    return named.select(rows.columns).unionByName(rows.where("not counts"))


def entries(spark: SparkSession, path: str, form: str) -> DataFrame:
    """``entries_of`` the files at ``path``, each read by as many tasks as it has blocks."""
    return entries_of(lines(spark, path, form), form, in_order=True)
