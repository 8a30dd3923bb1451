"""A forgiving reader of HTML: elements with their parents, and runs of text between block borders."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
# Elements that begin and end a block of text; the others stand inside a line.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td tfoot th thead tr ul".split())
# A start tag of these closes an open element of the same group, up to a limit.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_LIMITS = frozenset("html body table td th caption button object applet marquee template".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Element(NamedTuple):
    tag: str
    parent: int
    attributes: dict[str, str]


class Page(NamedTuple):
    elements: list[Element]                     # parents before their children; the first is the root
    runs: list[tuple[int, int, str]]            # block number, element, text with references decoded


def _attributes(text: str) -> dict[str, str]:
    return {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(text)}


def read(html: str | None) -> Page:
    html = html or ""
    elements, runs = [Element("", -1, {})], []
    open_ = [0]                                 # indexes of the open elements
    tags = [""]
    block, at, n = 0, 0, len(html)
    tag_pattern = _TAG

    def say(text: str) -> None:
        if text:
            runs.append((block, open_[-1], unescape(text) if "&" in text else text))

    while at < n:
        found = html.find("<", at)
        if found < 0:
            say(html[at:])
            break
        say(html[at:found])
        if html.startswith("<!--", found):
            end = html.find("-->", found + 4)
            if html.startswith(("<!-->", "<!--->"), found):
                end = html.find(">", found) - 2
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), found):
            end = html.find(">", found)
            at = n if end < 0 else end + 1
            continue
        tag = tag_pattern.match(html, found)
        if not tag and html[found + 1 : found + 2].isalpha() and tag_pattern is _TAG:
            tag_pattern = _PLAIN_TAG            # an open quote: from here on a tag ends at the next >
            tag = tag_pattern.match(html, found)
        if not tag:
            if html.startswith("</", found):    # not the end of anything
                end = html.find(">", found)
                at = n if end < 0 else end + 1
            elif html[found + 1 : found + 2].isalpha():
                at = n                          # a tag that never ends
            else:
                say("<")
                at = found + 1
            continue
        at = tag.end()
        closing, name = tag[1], tag[2].lower()
        if name in BLOCKS:
            block += 1
        if closing:
            if name in tags:
                k = len(tags) - 1 - tags[::-1].index(name)
                if not (name in ("p", "li", "dt", "dd") and _LIMITS.intersection(tags[k + 1 :])):
                    del tags[k:], open_[k:]
            continue
        if name in BLOCKS and "p" in tags:
            k = len(tags) - 1 - tags[::-1].index("p")
            if not _LIMITS.intersection(tags[k + 1 :]):
                del tags[k:], open_[k:]
        if name in _CLOSES:
            ends, limits = _CLOSES[name]
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in limits:
                    break
                if tags[k] in ends:
                    del tags[k:], open_[k:]
                    if name != "tr" or not any(t == "tr" for t in tags[k - 1 : k]):
                        break
        elements.append(Element(name, open_[-1], _attributes(tag[3]) if tag[3].strip(" /\n\t\r") else {}))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            stop = end.start() if end else n
            if name in ("textarea", "title"):
                runs.append((block, len(elements) - 1, unescape(html[at:stop])))
            at = end.end() if end else n
        elif name not in VOID and not tag[3].rstrip().endswith("/") or name in BLOCKS - VOID:
            open_.append(len(elements) - 1)
            tags.append(name)
        elif name == "br":
            say(" ")
    return Page(elements, runs)
