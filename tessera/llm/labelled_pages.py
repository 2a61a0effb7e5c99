"""Labelled pages for training: many layouts from a seeded grammar, with ``data-y`` on the elements
where the label (1: main text) changes."""

from __future__ import annotations

import random

# Names by which pages mark their parts.
MAIN = ["content", "post", "entry", "article", "story", "main", "body text", "post content", "entry content", "article body", "page content"]
AROUND = ["page", "wrapper", "container", "site", "outer", "row", "column", "layout", "inner", ""]
PARTS = {
    "nav": ["nav", "menu", "navbar", "navigation", "main menu", "breadcrumb", "breadcrumbs", "top menu", "tabs", "toc"],
    "header": ["header", "masthead", "site header", "banner", "top", "branding", "logo"],
    "footer": ["footer", "site footer", "copyright", "bottom", "colophon", "legal"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "side", "more"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner ad"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "subscribe", "newsletter", "cookie banner", "message"],
    "comments": ["comments", "comment", "comment list", "discussion", "replies", "responses", "disqus", "reader comments"],
    "form": ["form", "search", "login", "signup", "contact", "comment form", "search form"],
    "share": ["share", "social", "sharing", "meta", "byline tags", "tags"],
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "ins"], "notice": ["div", "section", "aside"], "comments": ["section", "div", "ol"], "form": ["form", "form", "div"], "share": ["div", "ul"]}


#: Layouts of pages: nested blocks, rows and cells of tables, a short article among forms and comments, blocks
#: without any names, and articles that stand in the body without an element of their own. The first is the
#: commonest.
LAYOUTS = ("blocks", "table", "short", "plain", "bare")


class Grammar:
    def __init__(self, seed: int):
        self.unnamed = False  # a page without classes and ids
        self.r = random.Random(seed)
        self.expected: list[str] = []
        self.plain = False  # a page whose sentences don't end in signs
        self.short = False  # a page of short sentences

    def words(self, low: int, high: int) -> list[str]:
        n = self.r.randint(low, high)
        return ["".join(self.r.choice(["ka", "lo", "mi", "ter", "an", "su", "ré", "ver", "on", "ist"]) for _ in range(self.r.randint(1, 4))) for _ in range(n)]

    def sentence(self, low: int = 4, high: int = 18) -> str:
        s = self.words(1, 4) if self.short and self.r.random() < 0.8 else self.words(low, high)
        return (" ".join(s)).capitalize() + ("" if self.plain else self.r.choice([".", ".", ".", "!", "?"]))

    def names(self, choices: list[str]) -> str:
        name = self.r.choice(choices)
        if not name or self.unnamed or self.r.random() < 0.25:
            return ""
        way = self.r.choice(["class", "class", "id"])
        return f' {way}="{name if way == "class" else name.replace(" ", "-")}"'

    def links(self, low: int = 2, high: int = 9) -> str:
        items = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in self.words(low, high))
        return f"<ul>{items}</ul>"

    def wrapped(self, part: str, inner: str) -> str:
        tag = self.r.choice(TAGS[part])
        named = self.names(PARTS[part]) or ("" if self.unnamed or tag not in ("div", "section", "ol", "ul", "ins") else f' class="{self.r.choice(PARTS[part])}"')
        return f'<{tag}{named} data-y="0">{inner}</{tag}>'

    def part(self, part: str) -> str:
        r = self.r
        text = self.sentence(3, 14)
        inner = {
            "nav": lambda: self.links(),
            "header": lambda: r.choice([f"<h1>{' '.join(self.words(1, 4))}</h1>", f"<a href='/'>{' '.join(self.words(1, 3))}</a>", f"<p>{' '.join(self.words(1, 5))}</p>"]) + (self.part("nav") if r.random() < 0.4 else ""),
            "footer": lambda: r.choice(["&copy; ", "Copyright ", ""]) + r.choice([text, " ".join(self.words(2, 6)), f"<p>{text}</p>", self.links(2, 5)]),
            "aside": lambda: f"<h3>{' '.join(self.words(1, 3))}</h3>" + r.choice([self.links(), f"<p>{text}</p>", f"<p>{text} {self.sentence()}</p><p><a href='/x'>{' '.join(self.words(1, 3))}</a></p>"]),
            "ad": lambda: r.choice([text, f"<p>{text}</p>", f"<a href='/buy'>{' '.join(self.words(2, 6))}</a>", f"{text} {self.sentence()}"]),
            "notice": lambda: f"<p>{text} {self.sentence() if r.random() < 0.5 else ''}</p>" + r.choice(["<button>ok</button>", f"<a href='#'>{self.words(1, 1)[0]}</a>", ""]),
            "comments": lambda: f"<h2>{' '.join(self.words(1, 3))}</h2>" + "".join(r.choice([f'<div class="comment"><p>{self.sentence()}</p></div>', f"<li><b>{self.words(1, 1)[0]}</b> {self.sentence()} {self.sentence()}</li>", f"<p>{self.sentence()} {self.sentence()}</p>", f'<article class="comment"><p>{self.sentence()} {self.sentence()}</p></article>']) for _ in range(r.randint(1, 5))),
            "form": lambda: f"<label>{' '.join(self.words(1, 3))}</label><input name='q'><textarea></textarea><p>{text}</p><button>go</button>",
            "share": lambda: r.choice([self.links(2, 4), f"<a href='#'>{self.words(1, 1)[0]}</a> <a href='#'>{self.words(1, 1)[0]}</a>"]),
        }[part]()
        return self.wrapped(part, inner)

    def block(self) -> str:
        r = self.r
        long = r.random()
        parts = [self.sentence() for _ in range(1 if long < 0.25 or self.short else r.randint(2, 7))]
        if long < 0.08:
            parts = [" ".join(self.words(1, 3))]
        text = " ".join(parts)
        kind = r.random()
        self.expected.append(text)
        if kind < 0.66:
            shown = text
            if r.random() < 0.2 and " " in text:
                a, _, b = text.partition(" ")
                shown = r.choice([f"<b>{a}</b> {b}", f"<a href='/{a}'>{a}</a> {b}", f"{a}\n  <em>{b}</em>"])
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class='text'>{}</p>"]).format(shown)
        if kind < 0.78:
            return r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(text)
        if kind < 0.88:
            more = [" ".join(self.words(1, 9)) for _ in range(r.randint(1, 4))]
            self.expected += more
            return "<ul>" + "".join(f"<li>{x}</li>" for x in [text, *more]) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{text}</blockquote>"
        return r.choice(["<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<section><p>{}</p></section>", "<figure><figcaption>{}</figcaption></figure>"]).format(text)

    def main(self, tag: str | None = None, short: bool = False) -> str:
        r = self.r
        tag = tag or r.choice(["article", "article", "main", "div", "div", "section"])
        named = self.names(MAIN) or ("" if self.unnamed or tag in ("article", "main", "td") else f' class="{r.choice(MAIN)}"')
        out = [f'<{tag}{named} data-y="1">']
        if short:
            for _ in range(r.randint(1, 2)):
                out.append(self.block())
            out += [self.part(p) for p in ("form", "comments") if r.random() < 0.3]
            return "".join(out) + f"</{tag}>"
        if r.random() < 0.7:
            title = " ".join(self.words(2, 9))
            self.expected.append(title)
            out.append(f"<h1>{title}</h1>")
        for _ in range(r.randint(1, 12) if r.random() < 0.8 else r.randint(12, 40)):
            out.append(self.block())
            if r.random() < 0.04:
                out.append(self.link_list())
            if r.random() < 0.08:
                out.append(self.part(r.choice(["ad", "share", "aside", "notice", "form"])))
        if r.random() < 0.15:
            out.append(self.part("comments"))
        return "".join(out) + f"</{tag}>"

    def cell(self, part: str, attributes: str = "") -> str:
        """A part of the page that is a cell of a table, as old pages have them."""
        r = self.r
        said = [f"<a href='/{w}'>{w.capitalize()}</a>" for w in self.words(2, 8)]
        inner = {
            "nav": lambda: r.choice([r.choice(["<br>", " | ", " ", "<br>\n"]).join(said), self.links()]),
            "header": lambda: r.choice([f"<h1>{' '.join(self.words(1, 4))}</h1>", f"<b>{' '.join(self.words(1, 4))}</b>", "<img src='/logo.gif'>" + " ".join(self.words(1, 3))]),
            "footer": lambda: r.choice(["&copy; ", "Copyright ", "", "Copyright 1999 "]) + r.choice([" ".join(self.words(1, 6)), self.sentence(3, 9)]),
            "aside": lambda: f"<b>{' '.join(self.words(1, 3))}</b><br>" + r.choice([self.sentence(3, 9), "<br>".join(said)]),
        }[part]()
        return f'<td{attributes}{self.names(PARTS[part])} data-y="0">{inner}</td>'

    def table(self) -> str:
        r = self.r
        rows = []
        if r.random() < 0.4:
            rows.append(self.cell("header", ' colspan="2"'))
        if r.random() < 0.3:
            rows.append(self.cell("nav", ' colspan="2"'))
        row = [self.main("td")]
        if r.random() < 0.7:
            row.insert(0, self.cell("nav", r.choice(["", ' width="150"', ' valign="top"'])))
        if r.random() < 0.3:
            row.append(self.cell("aside"))
        rows.append("".join(row))
        if r.random() < 0.5:
            rows.append(self.cell("footer", ' colspan="2"'))
        return f"<table{r.choice(['', ' width=100%', ' border=0'])} data-y=\"0\">" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>"

    def bare(self) -> str:
        """Blocks of main text as children of the body: from a single line of text to a long page."""
        r = self.r
        share = r.choice([0.0, 0.15, 0.3])
        around = lambda names: [self.part(p) for p in names if r.random() < share]
        before = around(("notice", "header", "nav", "form", "ad", "aside"))
        out = []
        if r.random() < 0.6:
            title = " ".join(self.words(2, 9))
            self.expected.append(title)
            out.append(f"<h1>{title}</h1>")
        if r.random() < 0.25:  # text without an element
            text = " ".join(self.sentence() for _ in range(r.randint(1, 9)))
            self.expected.append(text)
            out.append(text)
        for _ in range(r.choice([0, 1, 1, 2, 4, 10, 25]) if out else r.choice([1, 1, 2, 4, 10, 25])):
            out.append(self.block())
            if r.random() < 0.04:
                out.append(self.link_list())
        after = around(("share", "comments", "ad", "aside", "form", "notice", "footer"))
        return f"<html><head><title>x</title></head><body{self.names(AROUND)} data-y=\"1\">{''.join([*before, *out, *after])}</body></html>"

    def link_list(self) -> str:
        """A list of links that belongs to the article: sources, contents, further pages."""
        r = self.r
        items = [" ".join(self.words(1, r.choice([1, 3, 8]))) for _ in range(r.choice([1, 2, 4, 8, 16, 30]))]
        self.expected += items
        tag = r.choice(["ul", "ul", "ol"])
        return f"<{tag}>" + "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(items)) + f"</{tag}>"

    def page(self, layout: str | None = None) -> tuple[str, list[str]]:
        r = self.r
        self.expected = []
        self.plain, self.short = r.random() < 0.2, r.random() < 0.15
        layout = layout or r.choices(LAYOUTS, (58, 11, 9, 8, 14))[0]
        self.unnamed = layout == "plain"
        if layout == "table":
            body = self.table()
            return f"<html><head><title>x</title></head><body data-y=\"0\">{body}</body></html>", list(self.expected)
        if layout == "bare":
            return self.bare(), list(self.expected)
        before = [self.part(p) for p in ("notice", "header", "nav", "form", "ad", "aside") if r.random() < 0.45]
        main = self.main(short=layout == "short")
        after = [self.part(p) for p in ("share", "comments", "ad", "aside", "form", "notice", "footer") if r.random() < 0.45]
        if r.random() < 0.12:  # lines around the article that have no element of their own
            before.insert(0, f'<{(t := r.choice(["h1", "p", "p"]))} data-y="0">{" ".join(self.words(1, 6))}</{t}>')
        if r.random() < 0.12:
            after.append(f'<p data-y="0">{r.choice(["&copy; ", ""])}{" ".join(self.words(1, 6))}</p>')
        body = "".join([*before, main, *after])
        for _ in range(r.randint(0, 2)):
            body = f"<div{self.names(AROUND)}>{body}</div>"
        return f"<html><head><title>x</title><style>p{{}}</style></head><body data-y=\"0\">{body}</body></html>", list(self.expected)


def pages(count: int, seed: int = 11, layout: str | None = None) -> list[tuple[str, list[str]]]:
    """Pages with ``data-y`` marks (of one layout, or of all), and the blocks of main text of each."""
    g = Grammar(seed)
    return [g.page(layout) for _ in range(count)]
