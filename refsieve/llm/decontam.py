"""Operator 8: benchmark decontamination with an Aho-Corasick automaton.

Items and documents are normalised alike (A-Z lower-cased; words are runs of
ASCII letters, digits and non-ASCII characters). Every window of ``width``
consecutive item words is a pattern; an item of fewer words, but not none, is
one pattern. Words are numbered and written as two symbols each, so that a match
begins and ends with whole words. Each document is scanned once and hits are
mapped back to its words and its original code points.

A benchmark whose text is below ``BLOCK_BYTES`` is one automaton. A larger one is
dealt into blocks of about half that, and the documents are scanned once a block,
in tasks that hold one automaton each; their hits are united by the digest of the
text. An item longer than a block is a block of its own. A worker needs about 150
bytes of memory for a byte of a block's text.

Null or empty texts and items have no words and match nothing. Items with equal
windows are all reported; items of one id count once; those without an id count
as one and are left out of the list. Repeated documents give repeated rows. Extra
input columns are ignored by ``scan`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import broadcast_if_small, keep_rows, map_rows, send, utf8, written

WIDTH = 10
#: Bytes of item text in one automaton, and of a broadcast row of hits besides its spans.
BLOCK_BYTES, HIT_BYTES = 1_000_000, 800

#: A-Z to a-z; digits, letters and bytes of non-ASCII characters stay; the rest are separators.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Where the two symbols of a word begin, and those of a word that no item has.
_FIRST, _SECOND, _NONE = 0x0100, 0x6800, "\x01\x01"


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Index:
    """An automaton over the windows of some items (id or None, text), built in each worker that scans."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH) -> None:
        self.items, self.width = items, width
        self.names = sorted({name for name, _ in items if name is not None})
        if any(name is None for name, _ in items):
            self.names.append(None)
        self.machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def build(self) -> None:
        number = {name: i for i, name in enumerate(self.names)}
        split = [(number[name], words_of(text)) for name, text in self.items]
        known = sorted({w for _, words in split for w in words})
        base = int(len(known) ** 0.5) + 1
        if _FIRST + base > _SECOND:
            raise ValueError("a block has too many different words")
        self.codes = {w: chr(_FIRST + i // base) + chr(_SECOND + i % base) for i, w in enumerate(known)}
        self.machine, self.found = ahocorasick.Automaton(), []
        for i, words in split:
            code = "".join(self.codes[w] for w in words)
            for at in range(0, max(2, len(code) - 2 * self.width + 2) if words else 0, 2):
                window = code[at : at + 2 * self.width]
                known_as = self.machine.get(window, None)
                if known_as is None:
                    self.machine.add_word(window, (len(self.found), len(window) // 2))
                    self.found.append({i})
                else:
                    self.found[known_as[0]].add(i)
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set[int]]:
        """The number of words, which of them are hit (None: none) and the numbers of the items found."""
        words = words_of(text)
        if self.machine is None:
            self.build()
        if not words or not self.found:
            return len(words), None, set()
        get = self.codes.get
        found = list(self.machine.iter("".join([get(w, _NONE) for w in words])))
        if not found:
            return len(words), None, set()
        hit, items = np.zeros(len(words), bool), set()
        for end, (i, length) in found:
            last = end // 2
            hit[last - length + 1 : last + 1] = True
            items |= self.found[i]
        return len(words), hit, items


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks, one block on the driver at a time; about half of BLOCK_BYTES each if there are several."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= BLOCK_BYTES:
        yield [tuple(r) for r in items.collect()]
        return
    n = -(-2 * total // BLOCK_BYTES)
    dealt = written(items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))), "items")
    for i in range(n):
        block, size = [], 0
        for name, text in dealt.where(F.col("block") == i).select("name", "text").toLocalIterator():
            if block and size + len(utf8(text)) > BLOCK_BYTES:  # uneven dealing, or one long item
                yield block
                block, size = [], 0
            block.append((name, text))
            size += len(utf8(text))
        if block:
            yield block


def digest(names: list[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(n for n in names if n is not None)).encode()).hexdigest()


def runs_of(text: str, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of hit words: first and last word, and code point offsets in the original text, end exclusive."""
    words = ((i, *m.span()) for i, (m, is_hit) in enumerate(zip(WORD.finditer(text), hit, strict=True)) if is_hit)
    return united((i, i, start, end) for i, start, end in words)


def united(runs: Iterator[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs in order of their first word, with those that overlap or adjoin made one."""
    out: list[tuple[int, int, int, int]] = []
    for first, last, start, end in runs:
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2], max(end, out[-1][3]))
        else:
            out.append((first, last, start, end))
    return out


def summary(n_words: int, runs: list[tuple[int, int, int, int]], names: list[str | None]) -> tuple:
    n_hit = sum(last - first + 1 for first, last, _, _ in runs)
    return n_words, n_hit, len(names), digest(names), n_hit > 0, ",".join(f"{start}:{end}" for _, _, start, end in runs)


SUMMARY = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"
_TEXT_KEY = "__refsieve_text"


def hits(docs: DataFrame, benchmark: DataFrame, width: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame | Index:
    """The one index, or (__refsieve_text, runs, names): what each text that is hit, by its digest, holds of all blocks."""
    indexes = (Index(block, width) for block in blocks(benchmark, item_col, item_text_col))
    first, second = next(indexes, Index([], width)), next(indexes, None)
    if second is None:
        return first
    every = reduce(DataFrame.union, (_block_hits(docs, index, text_col) for index in chain((first, second), indexes)))
    found = every.groupBy(_TEXT_KEY).agg(F.collect_set("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    return written(found.select(_TEXT_KEY, F.array_sort(F.array_distinct(F.flatten("runs"))).alias("runs"), "names"), "hits")


def _block_hits(docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    sent = send(docs.sparkSession, index)

    def row(text: str | None) -> tuple:
        _, hit, items = sent().scan(text)
        names = [sent().names[i] for i in sorted(items)]
        return hashlib.md5(utf8(text)).hexdigest(), [f"{first:012}:{last}:{start}:{end}" for first, last, start, end in runs_of(text, hit)] if items else [], [f"={n}" if n is not None else "" for n in names]

    rows = map_rows(docs.select(F.col(text_col).cast("string")), row, f"{_TEXT_KEY} string, runs array<string>, names array<string>")
    return rows.where("size(names) > 0")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans ("start:end,..." in the original text)."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = hits(source, benchmark, width, "text", item_col, item_text_col)
    if isinstance(found, Index):
        sent = send(docs.sparkSession, found)

        def row(key: int | None, text: str | None) -> tuple:
            count, hit, items = sent().scan(text)
            return key, *summary(count, runs_of(text, hit) if items else [], [sent().names[i] for i in items])

        return map_rows(source, row, f"doc_id bigint, {SUMMARY}")
    counted = map_rows(source, lambda key, text: (key, len(words_of(text)), hashlib.md5(utf8(text)).hexdigest()), f"doc_id bigint, n bigint, {_TEXT_KEY} string")
    both = counted.join(broadcast_if_small(found, HIT_BYTES), _TEXT_KEY, "left").select("doc_id", "n", "runs", "names")

    def united_row(key: int | None, n: int, runs: list[str] | None, names: list[str] | None) -> tuple:
        whole = united(tuple(map(int, r.split(":"))) for r in runs or [])
        return key, *summary(n, whole, [name[1:] if name else None for name in names or []])

    return map_rows(both, united_row, f"doc_id bigint, {SUMMARY}")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that hold a window of an item."""
    found = hits(docs.select(F.col(text_col).cast("string").alias("text")), benchmark, width, "text", item_col, item_text_col)
    if isinstance(found, Index):
        sent, at = send(docs.sparkSession, found), docs.columns.index(text_col)
        return keep_rows(docs, lambda batch: np.array([sent().scan(v.as_py())[1] is None for v in batch.column(at)], bool))
    return docs.join(broadcast_if_small(found.select(_TEXT_KEY), HIT_BYTES), F.md5(F.col(text_col).cast("string").cast("binary")) == F.col(_TEXT_KEY), "left_anti")
