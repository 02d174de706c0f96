"""How operators 1, 5, 6 and 9 read odd and hostile input, against plain readings of it."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from refsieve.llm import html_blocks, langid, licenses, media
from refsieve.llm.common import pieces

PAGES = "/root/testdata/sf0.001/pages.parquet"


def texts(html):
    return [b[0] for b in html_blocks.leaf_blocks(html)]


def test_quotes_open_values_only():
    assert texts("<article><p>one <a href=x title=it's>two</a> three don't four</p><p>five</p></article>") == ["one two three don't four", "five"]
    assert texts("<p title=\"a > b\">x</p><p class='m > n' id=q>y</p>") == ["x", "y"]
    assert texts("<p a=\"1\"b='2'>k</p><p say \"so\" it's>l</p><p a=b/c d>m<br/>n</p><p x =>o") == ["k", "l", "m n", "o"]
    assert texts('<p x="unclosed>one</p><p>two') == ["one", "two"]
    assert html_blocks.leaf_blocks("<div title=' class=no ' CLASS = \"Post-body\" id=Main>x")[0][1] == ("div", ".post", ".body", ".main")


def test_links_count_however_deep_they_stand():
    got = html_blocks.leaf_blocks('<a href="x"><div><div><div><span>deep</span></div></div></div></a><p>no</p><p><a name=top>anchor</a></p><a href=u>one<a href=v>two</a>')
    assert [(b[0], b[2]) for b in got] == [("deep", 4), ("no", 0), ("anchor", 0), ("onetwo", 6)]


@pytest.mark.parametrize("piece", ["<a x=it's ", "<a x='", "<a x=\"> <b y='> ", "<p a=b\"c'd>x", "<p = \"", "<p =", "<a href=u>x"])
def test_hostile_attributes_take_linear_time(piece):
    began = time.perf_counter()
    html_blocks.leaf_blocks(piece * (2_000_000 // len(piece)) + ">")
    assert time.perf_counter() - began < 20


class Plain(HTMLParser):
    """The text of a page's article, block by block, by another reader."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.now = 0, [], []

    def turn(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in html_blocks.BLOCKS:
            self.turn()
        self.depth += tag == "article"
        self.now += [" "] if tag in ("br", "img") and self.depth else []

    def handle_endtag(self, tag):
        if tag in html_blocks.BLOCKS:
            self.turn()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.now += [data] if self.depth else []


def test_blocks_of_real_pages_by_another_reader(spark):
    """Every block that html.parser finds in an article is one of ``leaf_blocks``, in order."""
    for row in spark.read.parquet(PAGES).collect():
        other = Plain()
        other.feed(row.html or "")
        other.turn()
        mine = iter(texts(row.html))
        assert all(block in mine for block in other.blocks)


def test_no_word_is_cut():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 30))) for _ in range(400)) + "x" * 500
    usual = langid.counts(text)
    for chunk in (1, 7, 64, 1000, 10_000):
        assert "".join(pieces(text, chunk, langid._OTHER)) == text
        langid_chunk, langid.CHUNK = langid.CHUNK, chunk
        try:
            assert (langid.counts(text) == usual).all()
        finally:
            langid.CHUNK = langid_chunk


def plain_matches(index, words):
    """``matches`` in words, every alignment made at once and by itself, none left out by a bound."""

    def part(number, start, low, high):
        template = index.words[number]
        matched, first, last = licenses.align(template, words, start, low, high)
        return [(-matched, index.names[number], first, last, number, start, low, high)] if matched >= len(template) * (licenses.COVERAGE if len(template) > licenses.K else 1) else []

    todo, kept = [], []
    for number, starts in index.diagonals(licenses.shingle_hashes(words)).items():
        for start in starts:
            todo += part(number, start, max(0, start - licenses.BAND), min(len(words), start + len(index.words[number]) + licenses.BAND))
    while todo:
        todo.sort()
        less, name, first, last, number, start, low, high = todo.pop(0)
        if licenses.free_parts(kept, first, last + 1) == [(first, last + 1)]:
            kept = sorted([*kept, (first, last, name, -less)])
        for free in licenses.free_parts(kept, low, high):
            todo += part(number, start, *free)
    return [(name, first, last, matched) for first, last, name, matched in kept]


def test_license_matches_equal_plain_ones(monkeypatch):
    rng = random.Random(4)
    found = 0
    for together in (1, 6, 10**9):
        monkeypatch.setattr(licenses, "TOGETHER", together)
        for _ in range(60):
            pool = [f"w{i}" for i in range(rng.choice([6, 20]))]
            index = licenses.Index({f"t{n}": " ".join(rng.choice(pool) for _ in range(rng.randrange(3, 16))) for n in range(rng.randrange(1, 4))})
            text = []
            while len(text) < rng.randrange(120):
                body = [w.decode() for w in rng.choice(index.words)]
                if rng.random() < 0.5:
                    del body[rng.randrange(len(body))]
                text += body if rng.random() < 0.6 else rng.choices(pool, k=rng.randrange(9))
            got = licenses.matches(index, " ".join(text))
            spans, at = {}, 0
            for i, w in enumerate(text):
                spans[at], spans[-at - len(w)] = i, i
                at += len(w) + 1
            assert [(m[0], spans[m[1]], spans[-m[2]], m[3]) for m in got] == plain_matches(index, [w.encode() for w in text])
            found += len(got)
    assert found > 300


def test_alignments_together_are_alignments_alone():
    rng = random.Random(5)
    for _ in range(200):
        pool = [f"w{i}".encode() for i in range(rng.choice([3, 8, 30]))]
        template, text = (rng.choices(pool, k=rng.randrange(3, n)) for n in (25, 90))
        numbers = {}
        coded = np.array([numbers.setdefault(w, len(numbers)) for w in text])
        starts = np.array(sorted({rng.randrange(-20, len(text) + 5) for _ in range(9)}))
        low, high = np.maximum(starts - 8, 0), np.minimum(starts + len(template) + 8, len(text))
        want = [licenses.align(template, text, *map(int, x)) for x in zip(starts, low, high, strict=True)]
        assert licenses.align_all(np.array([numbers.get(w, -1) for w in template]), coded, starts, low, high) == [w if w[0] else (0, -1, -1) for w in want]
        bound = licenses.shared_words({numbers.get(w, -1): n for w, n in Counter(template).items()}, coded, low, high)
        assert (bound >= [w[0] for w in want]).all()


def test_repeated_legal_phrases_take_little_time():
    rng, index = random.Random(6), licenses.Index(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit"].split()
    for phrases in (["the software is", "to permit persons to whom"], [" ".join(mit[i : i + 5]) for i in range(0, len(mit), 5)]):
        began = time.perf_counter()
        assert licenses.matches(index, " ".join(rng.choice(phrases) for _ in range(5000))) == []
        assert time.perf_counter() - began < 5
    assert len(licenses.matches(index, (licenses.TEMPLATES["apache-2.0-notice"] + " ") * 100)) == 100


@pytest.mark.parametrize("data", [b"P1 2 2 0 1 2 3", b"P2 2 1 255 -1 7", b"P2 2 1 100 101 7", b"P3 1 1 9 1 2 10"])
def test_samples_out_of_range_are_refused(data):
    with pytest.raises(ValueError, match="samples"):
        media.decode_netpbm(data)
