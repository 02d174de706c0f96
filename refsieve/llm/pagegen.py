"""Generated web pages with known article blocks, to train and test the block labeller."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import numpy as np

#: Parts of class and id names, and words, by role.
NAMES = {
    "menu": ["nav", "menu", "navbar", "topnav", "main-menu", "navigation", "links"],
    "header": ["header", "masthead", "banner", "site-header", "top", "branding"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "legal"],
    "side": ["sidebar", "side", "widget", "rail", "secondary", "related", "recommended"],
    "notice": ["cookie", "notice", "alert", "consent", "gdpr", "message", "popup"],
    "advert": ["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "sponsored"],
    "form": ["form", "newsletter", "subscribe", "search", "signup", "contact-form"],
    "comments": ["comments", "comment-list", "responses", "discussion", "replies", "disqus"],
    "share": ["share", "social", "tools", "meta", "tags"],
    "content": ["content", "post", "entry", "article-body", "story", "text", "main", "post-content", "entry-content", "page"],
    "wrap": ["wrap", "container", "row", "col", "inner", "page", "site", "layout"],
}
WORDS = {
    "menu": "Home About Contact News Products Blog Login Register Help Services Archive Shop".split(),
    "footer": "Copyright reserved rights Privacy Terms Imprint policy contact sitemap".split(),
    "notice": "We use cookies to improve your experience accept decline settings privacy".split(),
    "form": "Subscribe email address name send search submit password your".split(),
    "comments": "Reply says commented ago Comments reader like report".split(),
    "share": "Share Tweet Print Email Facebook Tags Posted".split(),
}


class _Page:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.parts, self.truth = rng, [], []
        letters = list("aeioubcdfghlmnprstvzéèäöüñç")
        self.syllables = ["".join(rng.choice(letters, rng.integers(2, 5))) for _ in range(40)]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, things: list) -> str:
        return things[int(self.rng.integers(len(things)))]

    def words(self, low: int, high: int, role: str | None = None) -> str:
        n = int(self.rng.integers(low, high + 1))
        made = ["".join(self.pick(self.syllables) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        if role in WORDS:
            made = [self.pick(WORDS[role]) if self.chance(0.4) else w for w in made]
        if n > 6:
            made = [w + self.pick([",", ".", "", "", "", "", ""]) for w in made]
            if self.chance(0.15):
                made = [w + self.pick(["&", "%%%", "!!", " |"]) for w in made]
        text = " ".join(made)
        return text[:1].upper() + text[1:] + ("." if n > 6 else "")

    def text(self, text: str, label: int, linked: float = 0.0) -> None:
        """One block: plain, or with links and inline tags."""
        self.truth.append((" ".join(text.split()), label))
        pieces = text.split(" ")
        out = []
        for w in pieces:
            safe = escape(w)
            out.append(f'<a href="/{self.rng.integers(99)}">{safe}</a>' if self.chance(linked) else f"<b>{safe}</b>" if self.chance(0.02) else safe)
        self.parts.append(" ".join(out))

    def open(self, tag: str, role: str | None = None, marked: float = 0.8) -> str:
        mark = f' {self.pick(["class", "id"])}="{self.pick(NAMES[role])}"' if role and self.chance(marked) else ""
        self.parts.append(f"<{tag}{mark}>")
        return f"</{tag}>"

    def items(self, tag: str, low: int, high: int, label: int, role: str | None, linked: float) -> None:
        for _ in range(int(self.rng.integers(low, high + 1))):
            end = self.open(tag)
            self.text(self.words(1, 3 if linked else 14, role), label, linked)
            self.parts.append(end if self.chance(0.9) or tag != "li" else "")

    def list(self, role: str, label: int, low: int = 3, high: int = 8, linked: float = 1.0) -> None:
        end = self.open(self.pick(["ul", "ul", "ol"]), role, 0.3)
        self.items("li", low, high, label, role if not label else None, linked)
        self.parts.append(end)

    def paragraphs(self, low: int, high: int, label: int, role: str | None = None, least: int = 1, most: int = 90) -> None:
        loose = self.chance(0.3)
        if label and self.chance(0.06):  # a long run, of very short blocks at times
            high, most = 60, self.pick([3, most])
        for _ in range(int(self.rng.integers(low, high + 1))):
            self.parts.append("<p>" + ("<b>" if loose and self.chance(0.2) else ""))
            self.text(self.words(least, most, role), label, 0.03)
            self.parts.append("<br>" if loose and self.chance(0.2) else "</p>")

    def aside(self, role: str) -> None:
        """A part that is not the article."""
        tags = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "notice": ["div", "section", "aside"], "advert": ["div", "div", "aside"], "form": ["form"], "comments": ["section", "div", "div"], "share": ["div", "ul"]}
        tag = self.pick(tags[role])
        sure = 0.5 if tag in ("nav", "header", "footer", "aside", "form") else 1.0
        if role == "menu" and tag == "ul":
            end = self.open(tag, role, 1.0)
            self.items("li", 3, 9, 0, role, 1.0)
        else:
            end = self.open(tag, role, sure)
            if role == "menu":
                self.list(role, 0) if self.chance(0.7) else self.text(self.words(3, 9, role), 0, 0.9)
            elif role == "header":
                if self.chance(0.5):
                    inner = self.open(self.pick(["h1", "h2", "div"]))
                    self.text(self.words(1, 5), 0, 0.3)
                    self.parts.append(inner)
                self.paragraphs(0, 1, 0, None, 2, 12) if self.chance(0.5) else self.list("menu", 0)
            elif role == "footer":
                self.text(self.words(2, 14, role), 0, 0.2)
                self.list("menu", 0) if self.chance(0.4) else self.paragraphs(0, 2, 0, role, 3, 25)
            elif role == "side":
                inner = self.open(self.pick(["h2", "h3", "h4"]))
                self.text(self.words(1, 4), 0)
                self.parts.append(inner)
                self.list("side", 0) if self.chance(0.5) else self.paragraphs(1, 4, 0, None, 4, 50)
            elif role == "form":
                inner = self.open(self.pick(["label", "p", "div"]))
                self.text(self.words(1, 8, role), 0)
                self.parts.append(inner + '<input name="q">')
                if inner != "</label>" or self.chance(0.5):
                    line = self.open("p")
                    self.text(self.words(1, 10, role), 0)
                    self.parts.append(line + "<select><option>x</option></select>")
            elif role == "comments":
                inner = self.open(self.pick(["h2", "h3", "div"]))
                self.text(self.words(1, 3, role), 0)
                self.parts.append(inner)
                for _ in range(int(self.rng.integers(1, 7))):
                    one = self.open(self.pick(["div", "article", "li"]), "comments", 0.6)
                    self.paragraphs(1, 2, 0, role if self.chance(0.5) else None, 2, 60)
                    self.parts.append(one)
            elif role == "share":
                self.items("li", 2, 5, 0, role, 1.0) if tag == "ul" else self.text(self.words(2, 6, role), 0, 0.6)
            else:
                self.text(self.words(3, 30, role), 0, 0.1) if self.chance(0.6) else self.paragraphs(1, 2, 0, role, 3, 40)
        self.parts.append(end)

    def article(self) -> None:
        ends = []
        if self.chance(0.25):
            ends.append(self.open("main", "content", 0.3))
        kind = self.pick(["article", "article", "article", "article", "main", "div", "section"])
        ends.append(self.open(kind, "content", 0.3 if kind in ("article", "main") else 1.0))
        if self.chance(0.25):
            ends.append(self.open("div", "content", 0.7))
        if self.chance(0.85):
            end = self.open("h1")
            self.text(self.words(1, 12), 1)
            self.parts.append(end)
        if self.chance(0.15):
            self.aside("share")
        for _ in range(int(self.rng.integers(1, 5))):
            self.paragraphs(1, 6, 1)
            extra = self.rng.random()
            if extra < 0.2:
                end = self.open(self.pick(["h2", "h3"]))
                self.text(self.words(1, 8), 1)
                self.parts.append(end)
            elif extra < 0.3:
                self.list("content", 1, 2, 6, 0.0)
            elif extra < 0.38:
                end = self.open(self.pick(["blockquote", "pre", "figcaption"]))
                self.text(self.words(3, 40), 1)
                self.parts.append(end)
            elif extra < 0.43:
                self.parts.append("<table>")
                for _ in range(int(self.rng.integers(1, 4))):
                    self.parts.append("<tr>")
                    self.items("td", 2, 3, 1, None, 0.0)
                    self.parts.append("</tr>")
                self.parts.append("</table>")
            elif extra < 0.55:
                self.aside(self.pick(["advert", "advert", "form", "side", "notice"]))
        if self.chance(0.2):
            self.aside(self.pick(["share", "comments", "side", "form"]))
        self.parts += ends[::-1]

    def make(self) -> str:
        self.parts += ['<!DOCTYPE html><html lang="x"><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>']
        wraps = [self.open("div", "wrap") for _ in range(int(self.rng.integers(0, 3)) if self.chance(0.4) else 0)]
        for role, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.85), ("advert", 0.5), ("side", 0.2), ("form", 0.2)):
            if self.chance(p):
                self.aside(role)
        if self.chance(0.2):
            self.parts.append("<!-- ad 3 -->")
        self.article()
        for role, p in (("share", 0.25), ("comments", 0.4), ("advert", 0.3), ("side", 0.4), ("form", 0.25), ("menu", 0.1), ("footer", 0.85), ("notice", 0.15)):
            if self.chance(p):
                self.aside(role)
        self.parts += wraps + (["</body></html>"] if self.chance(0.9) else [])
        return "".join(self.parts)


def generated_pages(n: int, seed: int = 1) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """``n`` pages and the text and label (1: article) of each of their blocks in order."""
    for i in range(n):
        page = _Page(np.random.default_rng((seed, i)))
        yield page.make(), page.truth
