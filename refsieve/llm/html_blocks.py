"""Operator 5: main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the path
of open elements above it. A bidirectional LSTM in numpy reads, for each block,
embeddings of its path (tags, class and id words) and of its hashed words, and
a few measures, and labels the block as article or not with the whole page as
context. It is trained on generated pages (``pagegen``) of many layouts.

Character references are decoded, white space (line breaks by br included) in a
block becomes one space, blocks are trimmed and joined by newlines in page
order. Scripts, styles, templates, form fields, the head's title, comments and
markup never reach a block; all other text does, fallback content and formulas
included. A block's share of links counts what stands in any open link. The network reads a path's ``PATH_WORDS`` innermost words. Null, empty
and textless pages give an empty text. Unclosed tags, comments and quotes are
read as browsers read them, or nearly so: after a quote that never closes, tags
end at the first ``>``. Reading takes time in proportion to a page's length.
Pages of any length are labelled as one sequence. Repeated rows give repeated
results; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import rows_of, send, tidied
from refsieve.llm.learn import sigmoid
from refsieve.llm.pagegen import generated_pages

#: Element names by how they are read.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style template textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT_INLINE = frozenset("a button label".split())
SAME_LEVEL = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
#: A quote opens a value only after ``=``; elsewhere it is a character like others.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>))"
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[\s/]++|(?:=(?!\s*+[\"'])|[^\s/>=])[^\s/>=]*+(?:%s)?+)*+)>" % re.sub(r"\((?!\?)", "(?:", _VALUE))
_LOOSE = re.compile(r"</?([A-Za-z][^\s/>]*+)([^>]*+)>")
MARKS = ("class", "id", "role")
_PART = re.compile(r"[a-z]+")
_NAME = re.compile(r"</?[A-Za-z]")

PATHS, WORDS = 1 << 10, 1 << 11
PATH_WORDS, STEPS = 16, 4096
PATH_DIM, LEAF_DIM, WORD_DIM, MEASURES, HIDDEN = 12, 8, 8, 7, 16
INPUT = PATH_DIM + LEAF_DIM + WORD_DIM + MEASURES
PAGES, EPOCHS, BATCH, RATE = 480, 8, 16, 0.01
#: Padded blocks that are labelled at once.
CELLS = 20_000


class Block:
    __slots__ = ("depth", "linked", "path", "pieces")

    def __init__(self, path: tuple[str, ...]) -> None:
        self.path, self.pieces, self.linked, self.depth = path, [], 0, 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Stack:
    """Open elements, (name, path words, whether a link), where each name is open, and how many links are: closing looks at no more than it removes."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[str, ...], bool]] = []
        self.at: dict[str, list[int]] = {}
        self.links = 0

    def push(self, name: str, words: tuple[str, ...], link: bool) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, words, link))
        self.links += link

    def close(self, name: str, stops: tuple[str, ...] = ()) -> None:
        """Close the innermost ``name`` and all in it, unless one of ``stops`` is open in it."""
        if not (places := self.at.get(name)) or any(self.at.get(stop, [-1])[-1:] > places[-1:] for stop in stops):
            return
        place = places[-1]
        for other, _, link in self.open[place:]:
            self.at[other].pop()
            self.links -= link
        del self.open[place:]

    def path(self) -> tuple[str, ...]:
        """The innermost path words, outermost first."""
        found: list[str] = []
        for _, words, _ in reversed(self.open):
            found[:0] = words
            if len(found) >= PATH_WORDS:
                break
        return tuple(found[-PATH_WORDS:])


def leaf_blocks(html: str | None) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(text, path words, characters in links, open elements) of the blocks with text, in page order."""
    html = html or ""
    stack, done = Stack(), []
    now = Block(())
    at, size, last = 0, len(html), html.rfind(">")
    strict, unclosed = True, set()

    def turn() -> None:
        nonlocal now
        if now.pieces:
            done.append(now)
            now = Block(())

    def say(piece: str) -> None:
        if piece:
            if not now.pieces:
                now.path, now.depth = stack.path(), len(stack.open)
            now.pieces.append(unescape(piece))
            if stack.links:
                now.linked += len(piece)

    while at < size:
        low = html.find("<", at)
        if low < 0:
            say(html[at:])
            break
        say(html[at:low])
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = size if end < 0 else end + 3
            continue
        if html[low + 1 : low + 2] in ("!", "?"):
            end = html.find(">", low)
            at = size if end < 0 else end + 1
            continue
        if low > last or not _NAME.match(html, low):
            say("<")
            at = low + 1
            continue
        m = _TAG.match(html, low) if strict else None
        if not m:
            strict = False
            if not (m := _LOOSE.match(html, low)):
                say("<")
                at = low + 1
                continue
        at, name = m.end(), m[1].lower()
        if html[low + 1] == "/":
            if name in BLOCKS or name in KEPT_INLINE:
                if name in BLOCKS:
                    turn()
                stack.close(name)
            continue
        if name in UNSEEN:
            end = None if name in unclosed else re.compile(rf"</{name}\s*+>?", re.IGNORECASE).search(html, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = size
            else:
                unclosed.add(name)
            continue
        if name in VOID:
            if name == "hr":
                turn()
            elif name in ("br", "img", "input"):
                say(" ")
            continue
        if name in BLOCKS:
            turn()
            if name == "body":
                stack.close("head")
            if name not in SAME_LEVEL or name in ("li", "dt", "dd"):
                stack.close("p", ("table", "button"))
            if name in SAME_LEVEL:
                stack.close(name, SAME_LEVEL[name])
        elif name not in KEPT_INLINE:
            continue
        given = [(key.lower(), "".join(value)) for key, *value in _ATTRIBUTE.findall(m[2])] if m[2] else []
        if name == "a" and stack.open and stack.open[-1][0] == "a":
            stack.close("a")
        marks = [w for key, value in given if key in MARKS for w in _PART.findall(value.lower())]
        stack.push(name, (name, *(f".{w}" for w in marks)), name == "a" and any(key == "href" for key, _ in given))
    turn()
    return [(text, b.path, b.linked, b.depth) for b in done if (text := b.text)]


def encoded(blocks: list[tuple[str, tuple[str, ...], int, int]]) -> tuple[list[np.ndarray], list[int], list[np.ndarray], np.ndarray]:
    """Path numbers, leaf number, word numbers and measures of each block."""
    known: dict[str, int] = {}

    def number(word: str, size: int) -> int:
        got = known.get(word)
        if got is None:
            got = known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return got % size

    paths, leaves, words = [], [], []
    measures = np.zeros((len(blocks), MEASURES), np.float32)
    for i, (text, path, linked, depth) in enumerate(blocks):
        tags = [p for p in path if p[0] != "."]
        paths.append(np.array([number(p, PATHS) for p in path] or [0]))
        leaves.append(number("/".join(tags[-2:]), PATHS))
        split = text.lower().split()
        words.append(np.array([number(w, WORDS) for w in split]))
        n = len(text)
        measures[i] = (np.log1p(len(split)) / 4, linked / max(n, 1), min(1.0, 20 * sum(text.count(c) for c in ".,;:!?") / n), min(1.0, 5 * sum(text.count(c) for c in "0123456789") / n), i / len(blocks), min(1.0, depth / 10), 1.0)
    return paths, leaves, words, measures


def _bags(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat numbers, the row of each, and its share of the row's mean."""
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    return np.concatenate(rows) if rows else np.empty(0, np.int64), owner, (1 / np.maximum(sizes, 1))[owner].astype(np.float32)


def _mean(table: np.ndarray, bag: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    flat, owner, share = bag
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(flat):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(table[flat] * share[:, None], first)
    return out


class Labeller:
    """Weights and the two passes of the network. Sequences are padded at the end; ``mask`` marks the true blocks."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {"path": init(PATHS, PATH_DIM, scale=0.3), "leaf": init(PATHS, LEAF_DIM, scale=0.3), "word": init(WORDS, WORD_DIM, scale=0.3), "out": init(2 * HIDDEN, 1, scale=0.2), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w[f"x{d}"] = init(INPUT, 4 * HIDDEN, scale=0.2)
            self.w[f"h{d}"] = init(HIDDEN, 4 * HIDDEN, scale=0.2)
            self.w[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)

    def lstm(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of x (time, pages, INPUT), forward; padding keeps the state."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        states, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ self.w[f"h{d}"]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            kept.append((h, c, i, f, o, g, tanh, m))
            h, c = (m * o * tanh + (1 - m) * h).astype(np.float32), (m * new + (1 - m) * c).astype(np.float32)
            states[t] = h
        return states, kept

    def lstm_back(self, x: np.ndarray, kept: list, grad: np.ndarray, d: str, into: dict[str, np.ndarray]) -> np.ndarray:
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        dx = np.zeros_like(x)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tanh, m = kept[t]
            dh = dh + grad[t]
            live = dh * m
            dnew = dc * m + live * o * (1 - tanh * tanh)
            dz = np.hstack([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g * g)]).astype(np.float32)
            into[f"x{d}"] += x[t].T @ dz
            into[f"h{d}"] += h.T @ dz
            into[f"c{d}"] += dz.sum(0)
            dx[t] = dz @ self.w[f"x{d}"].T
            dh, dc = dz @ self.w[f"h{d}"].T + dh * (1 - m), dnew * f + dc * (1 - m)
        return dx

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple]:
        sizes = [len(p[1]) for p in pages]
        n = sum(sizes)
        bags = _bags([r for p in pages for r in p[0]]), np.array([v for p in pages for v in p[1]]), _bags([r for p in pages for r in p[2]])
        flat = np.hstack([_mean(self.w["path"], bags[0], n), self.w["leaf"][bags[1]], _mean(self.w["word"], bags[2], n), np.vstack([p[3] for p in pages])])
        t = np.concatenate([np.arange(s) for s in sizes])
        b = np.repeat(np.arange(len(pages)), sizes)
        x, mask = np.zeros((max(sizes), len(pages), INPUT), np.float32), np.zeros((max(sizes), len(pages)), np.float32)
        x[t, b], mask[t, b] = flat, 1
        return x, mask, (t, b, sizes, bags)

    def forward(self, pages: list[tuple]) -> tuple[np.ndarray, tuple]:
        """Article logits of all blocks, page after page."""
        x, mask, where = self.inputs(pages)
        t, b, sizes, _ = where
        turn = np.array(sizes)[b] - 1 - t
        back = np.zeros_like(x)
        back[turn, b] = x[t, b]
        hf, kf = self.lstm(x, mask, "f")
        hb, kb = self.lstm(back, mask, "b")
        both = np.hstack([hf[t, b], hb[turn, b]])
        return (both @ self.w["out"] + self.w["bias"])[:, 0], (x, back, where, turn, kf, kb, both)

    def scores(self, pages: list[tuple]) -> np.ndarray:
        """What ``forward`` gives, without its record for the gradients: both directions at once, STEPS of input at a time."""
        x, _, (t, b, sizes, _) = self.inputs(pages)
        turn = np.array(sizes)[b] - 1 - t
        back = np.zeros_like(x)
        back[turn, b] = x[t, b]
        steps, n = x.shape[:2]
        weights, recur = np.stack([self.w["xf"], self.w["xb"]]), np.stack([self.w["hf"], self.w["hb"]])
        start = np.stack([self.w["cf"], self.w["cb"]])[:, None]
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)
        for at in range(0, steps, STEPS):
            part = np.stack([x[at : at + STEPS], back[at : at + STEPS]], 1)
            pre = np.matmul(part, weights) + start
            for s in range(len(pre)):  # padding comes last, so what follows a page's end is not read
                z = pre[s] + np.matmul(h, recur)
                gates = 1 / (1 + np.exp(-np.clip(z[..., : 3 * HIDDEN], -35, 35)))
                c = gates[..., HIDDEN : 2 * HIDDEN] * c + gates[..., :HIDDEN] * np.tanh(z[..., 3 * HIDDEN :])
                h = states[at + s] = gates[..., 2 * HIDDEN :] * np.tanh(c)
        both = np.hstack([states[t, 0, b], states[turn, 1, b]])
        return (both @ self.w["out"] + self.w["bias"])[:, 0]

    def gradients(self, pages: list[tuple], labels: np.ndarray) -> dict[str, np.ndarray]:
        logits, (x, back, (t, b, _, bags), turn, kf, kb, both) = self.forward(pages)
        into = {k: np.zeros_like(v) for k, v in self.w.items()}
        miss = ((sigmoid(logits) - labels) / len(labels)).astype(np.float32)[:, None]
        into["out"], into["bias"] = both.T @ miss, miss.sum(0)
        dboth = miss @ self.w["out"].T
        gf, gb = np.zeros((*x.shape[:2], HIDDEN), np.float32), np.zeros((*x.shape[:2], HIDDEN), np.float32)
        gf[t, b], gb[turn, b] = dboth[:, :HIDDEN], dboth[:, HIDDEN:]
        dx = self.lstm_back(x, kf, gf, "f", into)[t, b] + self.lstm_back(back, kb, gb, "b", into)[turn, b]
        for key, bag, part in (("path", bags[0], dx[:, :PATH_DIM]), ("word", bags[2], dx[:, PATH_DIM + LEAF_DIM : PATH_DIM + LEAF_DIM + WORD_DIM])):
            np.add.at(into[key], bag[0], part[bag[1]] * bag[2][:, None])
        np.add.at(into["leaf"], bags[1], dx[:, PATH_DIM : PATH_DIM + LEAF_DIM])
        return into


@cache
def train(pages: int = PAGES, seed: int = 1) -> Labeller:
    """Adam on generated pages; trained once a driver process."""
    rng = np.random.default_rng(seed)
    data = []
    for html, truth in generated_pages(pages, seed):
        blocks = leaf_blocks(html)
        if [b[0] for b in blocks] == [text for text, _ in truth]:
            data.append((encoded(blocks), np.array([label for _, label in truth], np.float32)))
    net = Labeller(seed)
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            batch = [data[i] for i in order[at : at + BATCH]]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in net.gradients([p for p, _ in batch], np.concatenate([y for _, y in batch])).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page; pages of like length are labelled together."""
    blocks = [leaf_blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    while order:
        most = max(1, CELLS // len(blocks[order[-1]]))
        group, order = order[-most:], order[:-most]
        logits = net.scores([encoded(blocks[i]) for i in group])
        at = 0
        for i in group:
            out[i] = "\n".join(b[0] for b, z in zip(blocks[i], logits[at : at + len(blocks[i])], strict=True) if z > 0)
            at += len(blocks[i])
    return out


def extract(pages: DataFrame, net: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    sent = send(pages.sparkSession, net or train())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(rows_of(iter([batch.select([0, 1])])))
            for at in range(0, len(rows), 128):
                part = rows[at : at + 128]
                texts = main_texts(sent(), [batch.column(2)[at + i].as_py() for i in range(len(part))])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(tidied(run), "page_id bigint, url string, text string, n_chars bigint")
