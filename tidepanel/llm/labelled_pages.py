"""Labelled pages to train on: page layouts written out with invented words.

Each block of text starts with a private-use character that says whether it is part of
the article; ``labelled`` reads it off again after parsing. The layouts vary in what
encloses the article, in the names of classes, and in what stands around and inside it.
"""

from __future__ import annotations

import random
from functools import partial

from tidepanel.llm.webpage import Block, blocks

MAIN, OTHER = "", ""
PAGES = 800

# Usual names of page parts.
NAMES = {
    "nav": "nav menu navbar navigation topbar breadcrumb breadcrumbs links tabs".split(),
    "header": "header masthead site-header top branding page-header".split(),
    "footer": "footer site-footer bottom copyright colophon page-footer legal".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox banner-ad ad-slot".split(),
    "side": "sidebar side aside widget rail right-column secondary".split(),
    "notice": "cookie consent notice gdpr popup modal alert cookie-banner privacy banner".split(),
    "form": "newsletter subscribe signup login search contact-form feedback".split(),
    "comments": "comments comment comment-list respond replies discussion comments-area user-comments".split(),
    "share": "share social sharing share-buttons follow".split(),
    "related": "related recommended more-stories read-next see-also trending popular".split(),
    "main": "content post entry article story text post-content entry-content article-body main body-text main-content page-content".split(),
    "neutral": "container wrap row col box inner section block grid x1 c2 outer".split(),
}
_SOUNDS = "ba re ti lo mu ka sen dor vil ant ous el ing er on tha qui é ü ño sch".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        found = ["".join(r.choices(_SOUNDS, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.1:
            return " ".join(w.upper() + "!!" for w in found)
        if style < 0.2:
            return " ".join(w + r.choice(["&amp;&amp;&amp;", "%%%", "###", "$$$", "***"]) for w in found)
        if style < 0.3:
            return " | ".join(found)
        marks = [w + r.choice(["", "", "", "", ",", "."]) for w in found]
        return " ".join(marks).capitalize() + r.choice([".", ".", ".", "", "?"])

    def text(self, mark: str, low: int, high: int) -> str:
        return mark + self.words(low, high)

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{OTHER}{self.words(1, 4)}</a>'

    def attribute(self, part: str) -> str:
        r = self.r
        name = r.choice(NAMES[part])
        extra = " " + r.choice(NAMES["neutral"]) if r.random() < 0.3 else ""
        return r.choice([f' class="{name}{extra}"', f' id="{name}"', f" class='{name}'", f' class="{name}-{r.randint(1, 9)}"'])

    def box(self, part: str, inner: str, tags: tuple[str, ...] = ("div",)) -> str:
        tag = self.r.choice(tags)
        plain = tag != "div" and self.r.random() < 0.6
        return f"<{tag}{'' if plain else self.attribute(part)}>{inner}</{tag}>"

    def link_list(self, part: str, tags: tuple[str, ...]) -> str:
        r = self.r
        links = [self.link() for _ in range(r.randint(2, 8))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else "".join(f"<div>{x}</div>" for x in links)
        return self.box(part, inner, tags)

    def advert(self) -> str:
        return self.box("ad", self.text(OTHER, 3, 25), ("div", "div", "aside"))

    def notice(self) -> str:
        button = f"<button>{OTHER}{self.words(1, 2)}</button>"
        return self.box("notice", f"<p>{self.text(OTHER, 6, 30)}</p>{button}", ("div", "section", "dialog"))

    def form(self) -> str:
        field = f'<label>{self.text(OTHER, 1, 4)}</label><input name="q"><button>{OTHER}{self.words(1, 2)}</button>'
        return f'<form{self.attribute("form")}><p>{self.text(OTHER, 3, 14)}</p>{field}</form>'

    def side(self) -> str:
        inner = "".join(f"<h3>{self.text(OTHER, 1, 4)}</h3><p>{self.text(OTHER, 4, 40)}</p>" for _ in range(self.r.randint(1, 3)))
        return self.box("side", inner + (self.link_list("related", ("div",)) if self.r.random() < 0.5 else ""), ("aside", "div"))

    def comments(self) -> str:
        r = self.r
        one = lambda: f"<p>{self.text(OTHER, 1, 4)}</p><p>{self.text(OTHER, 5, 60)}</p>"
        items = [one() for _ in range(r.randint(1, 5))]
        inner = "".join(self.box("comments", x, ("div", "article")) if r.random() < 0.5 else f'<li class="comment">{x}</li>' for x in items)
        return self.box("comments", f"<h3>{self.text(OTHER, 1, 3)}</h3>{inner}" + (self.form() if r.random() < 0.3 else ""), ("section", "div"))

    def header(self) -> str:
        return self.box("header", f"<div>{self.text(OTHER, 1, 5)}</div>" + (self.link_list("nav", ("nav", "div")) if self.r.random() < 0.5 else ""), ("header", "div"))

    def footer(self) -> str:
        return self.box("footer", f"<p>{OTHER}&copy; {self.words(3, 25)}</p>" if self.r.random() < 0.5 else f"{OTHER}&copy; {self.words(3, 25)}", ("footer", "footer", "div"))

    def article(self) -> str:
        r = self.r
        title = f"<{r.choice(['h1', 'h1', 'h2'])}>{self.text(MAIN, 2, 12)}</h1>".replace("h2>", "h2>")
        title = title if title.startswith("<h1") else title.replace("</h1>", "</h2>")
        parts = [title] if r.random() < 0.9 else []
        broken = r.random() < 0.4
        for _ in range(r.randint(1, 10)):
            k = r.random()
            if k < 0.5:
                text = self.text(MAIN, 1, 90)
                parts.append(f"<p><b>{text}<br>" if broken and r.random() < 0.3 else f"<p>{text}" + ("</p>" if r.random() < 0.8 else ""))
            elif k < 0.57:
                parts.append(f"<h{r.randint(2, 4)}>{self.text(MAIN, 1, 8)}</h3>")
            elif k < 0.64:
                tag = r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{self.text(MAIN, 2, 25)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif k < 0.69:
                parts.append(f"<blockquote><p>{self.text(MAIN, 5, 40)}</p></blockquote>")
            elif k < 0.73:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(MAIN, 1, 6)}</td><td>{self.text(MAIN, 1, 6)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif k < 0.78:
                parts.append(f"<div>{self.text(MAIN, 5, 60)}</div>")
            elif k < 0.87:
                parts.append(self.advert())
            elif k < 0.91:
                parts.append(self.link_list("related", ("div", "aside")))
            elif k < 0.94:
                parts.append(self.link_list("share", ("div",)))
            elif k < 0.98:
                parts.append(self.form())
            else:
                parts.append(f"<pre>{self.text(MAIN, 3, 30)}</pre>")
        inner = "".join(parts)
        around = r.random()
        if around < 0.45:
            return f"<article>{inner}</article>" if r.random() < 0.6 else f"<article{self.attribute('main')}>{inner}</article>"
        if around < 0.6:
            return f"<main>{inner}</main>" if r.random() < 0.5 else f'<main><article class="post">{inner}</article></main>'
        if around < 0.9:
            return f"<div{self.attribute('main')}>{inner}</div>"
        return inner if around < 0.95 else f"<table><tr><td{self.attribute('main')}>{inner}</td></tr></table>"

    def page(self) -> str:
        r = self.r
        some = lambda share, make: make() if r.random() < share else ""
        before = [
            some(0.35, self.header),
            some(0.7, partial(self.link_list, "nav", ("nav", "nav", "div"))),
            some(0.25, self.notice),
            some(0.5, self.advert),
            some(0.1, self.form),
            some(0.15, self.side),
        ]
        after = [
            some(0.2, self.advert),
            some(0.15, partial(self.link_list, "share", ("div",))),
            some(0.25, partial(self.link_list, "related", ("div", "section", "aside"))),
            some(0.35, self.comments),
            some(0.2, self.form),
            some(0.25, self.side),
        ]
        r.shuffle(after)
        body = "".join(before) + self.article() + "".join(after) + some(0.8, self.footer)
        if r.random() < 0.3:
            body = f"<div{self.attribute('neutral')}>{body}</div>"
        head = f'<head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>'
        return f"<!DOCTYPE html><html>{head}<body>{body}" + some(0.9, lambda: "</body></html>")


def labelled(n: int = PAGES, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: article) of ``n`` pages."""
    found = []
    for k in range(n):
        own = blocks(_Page(seed * 1_000_003 + k).page())
        labels = [int(MAIN in b.text) for b in own]
        clean = [b._replace(text=b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-") for b in own]
        found.append((clean, labels))
    return found
