"""Bibliographies read by blocks give the rows of the parsers of whole texts."""

import json
import random
from pathlib import Path

import pytest

from refsieve.sources import bibliography, blocks

WHOLE = {"bib": bibliography.bibtex, "ris": bibliography.ris, "list": bibliography.plain_list}
BITS = {
    "bib": ["@", "@article{", "@ book\n(", "@misc", "\n{", "k1,", "k 2, title = {A {T}itle},", "year=2001", "}", ")", "{", "(", "\n", "\n\n", " ", "é文", '"a, b"', "@string{x=1}", "@comment(", "a@b.c{", ",", "@article{, note={none}}\n", "@book{z,\n title={Y}\n}\n"],
    "ris": ["TY  - JOUR\n", "ER  - \n", "TI  - A title\n", "  goes on\n", "AU  - Smith J\n", "ID  - x7\n", "\n", "junk\n", "PY  - 2001\x0b", "文\n", "TY  - BOOK\n", "AU  - "],
    "list": ["1. ", "[2] ", "3、", "# ", "## heading\n", "\n", "Smith J. A title of things. BMJ. 2001.", "PMID: 12345678", " doi:10.1000/A.b", "\n\n", "  more words\n", "张三. 题名研究[J]. 中华杂志, 2001.", "x\x0by", "\n4) "],
}


def texts(form: str, seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(BITS[form]) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def by_blocks(form: str, text: str, size: int, piece: int) -> list[tuple]:
    """The passes of ``entries_of`` over blocks of about ``size`` characters, without Spark."""
    one = blocks.FORMS[form]()
    cut, held = [], []
    split = text.split("\n")
    for line in split[:-1] if split[-1] == "" else split:
        held.append(line)
        if sum(map(len, held)) >= size:
            cut, held = [*cut, held], []
    cut += [held] if held else []
    raw = [("p", 100 * b, "", line) for b, block in enumerate(cut) for line in block]
    import pandas as pd

    frame = pd.DataFrame(raw, columns=["path", "block", "none", "text"])
    sums = list(blocks._sums(form, piece)([frame]))
    if not sums:
        return []
    sums = pd.concat(sums)
    sums.columns = ["path", "block", "piece", "effect"]
    starts = {b: s for _, b, s in blocks._starts(form)(sums).itertuples(index=False)}
    frame["state"] = [starts[b] for b in frame["block"]]
    found = [tuple(r) for f in blocks._read(form)([frame]) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    done, parts = [], {}
    for path, start, nth, line, part, whole, body, issue in found:
        if whole:
            done.append((start, nth, line, body, issue))
        else:
            parts.setdefault(start, []).append((part, nth, line, body))
    for start, cuts in parts.items():
        cuts.sort(key=lambda x: x[0])
        done.append((start, cuts[0][1], cuts[0][2], ("" if form == "list" else one.glue).join(x[3] for x in cuts), None))
    rows, place = [], 0
    for _, _, line, body, issue in sorted(done, key=lambda x: (x[0], x[1])):
        if row := one.row(body, line, issue):
            *row, counts = row
            place += counts
            rows.append(tuple([row[0] or f"{one.prefix}{place}", *row[1:]] if counts else row))
    return rows


@pytest.mark.parametrize("form", ["bib", "ris", "list"])
def test_blocks_of_every_size(form):
    seen = 0
    for n, text in enumerate(texts(form, 5, 40)):
        want = list(WHOLE[form](text))
        seen += len(want)
        for size in (1, 16, 40, 100, 10_000):
            for piece in (1, 24, 10_000):
                assert by_blocks(form, text, size, piece) == want, (n, size, piece, text)
    assert seen > 40


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("form", ["bib", "ris", "list"])
def test_files_in_blocks(small_blocks, tmp_path, form):
    spark = small_blocks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    found = {f"{n}.txt": text for n, text in enumerate(["", *texts(form, 11, 5), "\n".join(texts(form, 12, 8))])}
    for name, text in found.items():
        (tmp_path / name).write_bytes(text.encode())
    got = blocks.entries(spark, str(tmp_path), form)
    assert got.columns == ["path", *[x.split()[0] for x in blocks.FORMS[form].ddl.split(", ")]]
    rows = [(Path(r["path"]).name, *[list(v) if isinstance(v, tuple) else v for v in tuple(r)[1:]]) for r in got.collect()]
    want = [(name, *row) for name, text in found.items() for row in WHOLE[form](text)]
    plain = lambda x: json.dumps(x, sort_keys=True, default=str)
    assert sorted(map(plain, rows)) == sorted(map(plain, want))


def test_an_entry_over_many_blocks_and_one_that_nothing_closes(small_blocks, tmp_path):
    spark = small_blocks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    text = "@article{a,\n note = {" + "words and {more}\n" * 50 + "}, year = {2001}}\n@book{b, title = {" + "never\n" * 100
    (tmp_path / "x.bib").write_text(text)
    got = blocks.entries(spark, str(tmp_path), "bib").orderBy("line").collect()
    assert [(r["citekey"], r["line"], r["issue"]) for r in got] == [("a", 1, None), (None, 53, "ERROR unclosed entry")]
    assert got[0]["fields"]["note"] == " ".join(["words and more"] * 50) and got[0]["fields"]["year"] == "2001"


def test_empty_and_null_lines(spark):
    raw = spark.createDataFrame([("a", 0, 0, None), ("a", 0, 1, "@x{k,"), ("a", 9, 2, None), ("a", 9, 3, "year={1}}")], "path string, block long, at long, text string")
    for form in blocks.FORMS:
        assert blocks.entries_of(raw.limit(0), form).count() == 0
    (row,) = blocks.entries_of(raw, "bib").collect()
    assert (row["citekey"], row["line"], row["fields"]) == ("k", 2, {"year": "1"})
