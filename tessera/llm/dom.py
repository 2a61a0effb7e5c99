"""A tolerant HTML parser that keeps what extraction needs: block elements and the text between them."""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video select option button head title".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: An open element of the second set ends where one of the first begins.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: What a container of main text holds.
PLAIN = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol blockquote pre".split())
#: Elements in which a block doesn't end a paragraph that began outside.
KEEPS = ("button", "table", "td", "th", "caption")

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_OPENING = re.compile(r"</?[a-zA-Z][^\s/>]*")
_QUOTE = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_HINTS = re.compile(r"[a-z]+")


class Page:
    """Nodes in page order; the parent of node 0 is -1. Text blocks are nodes with the tag ``#``."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#page"]
        self.hints: list[tuple[str, ...]] = [()]
        self.label: list[int | None] = [0]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self._outline: tuple[frozenset[int], bool, frozenset[int]] | None = None

    def outline(self) -> tuple[frozenset[int], bool, frozenset[int]]:
        """The elements that hold text, paragraphs, headings or lists themselves, whether any element is made for main
        text, and the elements that hold paragraphs."""
        if self._outline is None:
            plain = [t in PLAIN for t in self.tag]
            direct = frozenset(p for p, own in zip(self.parent, plain, strict=True) if own)
            self._outline = direct, any(t in ("article", "main") for t in self.tag), frozenset(p for p, t in zip(self.parent, self.tag, strict=True) if t == "p")
        return self._outline

    def add(self, parent: int, tag: str, hints: tuple[str, ...] = (), label: int | None = None, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.label.append(label)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def hints_of(found: dict[str, str]) -> tuple[str, ...]:
    """The words of class, id and role, split at signs, digits and capitals."""
    joined = " ".join(found.get(a, "") for a in ("class", "id", "role"))
    return tuple(dict.fromkeys(_HINTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", joined).lower())))


class _Tags:
    """The tags, comments and declarations of a page in order, in time linear in its length.

    A tag ends at the first ``>`` outside quotes or, where a quote never ends, at the first one at all.
    What a tag without an end has cost is paid once: no tag begins behind the last ``>``, and where a
    quote was opened on the way to the end of the page, no other tag needs to go on from there.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.broken = False
        self.hopeless: set[int] = set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it is an end tag, name ("": none) and attributes of the next tag."""
        while not self.broken:
            m = _TAG.search(self.source, at, self.last + 1)
            if not m:
                break
            if m[5] is None:
                end = m.end()
                for begin, ends in (("<!--", ("-->", "--!>")), ("<![CDATA[", "]]>")):
                    if end > self.last and m[0].startswith(begin) and not m[0].endswith(ends):
                        end = len(self.source)
                return m.start(), end, bool(m[1]), m[2] or "", m[3] or ""
            self.broken = True  # a quote that never ends: from here on step by step
            at = m.start()
        return self._stepped(at)

    def _stepped(self, at: int) -> tuple[int, int, bool, str, str] | None:
        source = self.source
        while 0 <= (start := source.find("<", at)) < len(source):
            if source.startswith("<!--", start) or source.startswith("<![CDATA[", start):
                m = _TAG.match(source, start)
                return start, m.end(), False, "", ""
            if start > self.last:  # only comments end without a sign
                at = start + 1
                continue
            if source.startswith(("<!", "<?"), start):
                return start, source.index(">", start) + 1, False, "", ""
            m = _OPENING.match(source, start)
            if not m:
                at = start + 1
                continue
            end = self._end(m.end())
            closing = source[start + 1] == "/"
            return start, end + 1, closing, m[0][1 + closing :], source[m.end() : end]
        return None

    def _end(self, at: int) -> int:
        first, opened = self.source.index(">", at), []
        while m := _QUOTE.search(self.source, at):
            if m[0] == ">":
                return m.start()
            opened.append(m.start())
            at = self.source.find(m[0], m.end()) + 1
            if not at or opened[-1] in self.hopeless:
                break
        self.hopeless.update(opened)
        return first


def parse(source: str, labelled: bool = False) -> Page:
    """The tree of block elements of a page, with its text blocks in page order.

    White space within a block becomes one space; character references are decoded. Unclosed and
    stray tags are repaired as browsers do for paragraphs, lists and tables. ``labelled`` reads the
    labels that training pages carry in ``data-y``.
    """
    page = Page()
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # tag, nearest block, hidden
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name in the stack
    pieces: list[str] = []
    linked = 0
    in_link = 0
    at, length = 0, len(source)
    tags = _Tags(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(stack[-1][1], "#", text=text, linked=min(linked, len(text)))
            pieces.clear()
        linked = 0

    def implied() -> None:
        """Content outside of ``body`` opens one, as in browsers."""
        if stack[-1][0] in ("#page", "html"):
            places["body"].append(len(stack))
            stack.append(("body", page.add(stack[-1][1], "body"), False))

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            if stack[-1][0] in ("#page", "html") and not raw.isspace():
                implied()
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    def close(to: int) -> None:
        nonlocal in_link
        while len(stack) > to:
            tag = stack[-1][0]
            if tag == "a":
                in_link -= 1
            if tag not in INLINE:
                flush()
            stack.pop()
            places[tag].pop()

    def nearest(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    while at < length:
        found = tags.next(at)
        if not found:
            said(source[at:])
            break
        start, end, closing, name, inner = found
        said(source[at:start])
        at = end
        if not name:
            if source.startswith("<![CDATA[", start):
                said(source[start + 9 : end].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if closing:
            if tag == "br":
                pieces.append(" ")
            elif places[tag]:
                close(places[tag][-1])
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        block = tag not in INLINE
        if block:
            flush()
            if places["p"] and places["p"][-1] > nearest(KEEPS):  # a block ends an open paragraph
                close(places["p"][-1])
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
            while (last := nearest(ended)) > nearest(scope):
                close(last)
                if tag != "tr":
                    break
        if tag not in HIDDEN and tag not in ("html", "body"):
            implied()
        hidden = stack[-1][2] or tag in HIDDEN
        node = stack[-1][1]
        if block and not hidden:
            known = attributes(inner) if inner else {}
            label = int(known["data-y"]) if labelled and "data-y" in known else None
            if "hidden" in known or "display:none" in known.get("style", "").replace(" ", "").lower():
                hidden = True
            node = page.add(node, tag, hints_of(known), label)
        if inner.endswith("/") and tag in ("path", "rect", "circle", "use", "line"):
            continue
        if tag == "a":
            in_link += 1
        places[tag].append(len(stack))
        stack.append((tag, node, hidden))
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            raw_end = stop.start() if stop else length
            if tag == "textarea":
                said(source[at:raw_end])
            at = raw_end
    close(1)
    flush()
    return page
