"""Main text of web pages by template deduction from equivalence classes.

Pages of one host come from one template with a few layouts (which elements stand directly in the
body). A token is an element with its path, or a line of text with its path. Its occurrence vector says
how often each page of a layout holds it; tokens with equal vectors form an equivalence class. Classes
that nine in ten different pages of a layout hold and whose tokens nest (the element around a line is of
such a class too) are the template: their elements are its frame, their lines its wording, on every page
of the host, and what varies its slots. The
main text is in all slots that hold more than links, by one rule for every page and host; an article
element only keeps lists of links in it, and the lines of a page that is nothing but wording.

What an occurrence cannot tell is told by lists: elements whose tag says that they are no text, adverts
and readers' comments by name (their texts vary like slots), and other listed names outside the article of
a page that has one. Elsewhere a listed name only counts where the pages agree: most lines in that
element recur on several pages of the host, or all are links. The same takes out elements without any
name beside the article of a page, such as adverts in turn.

Vectors are compared by order-free hashes, so counting combines before the shuffle and a host of any
size is dealt with in parallel. Hosts with too few different pages are taken together.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelytics.llm.html_tree import BLOCKS, Element, Page, read
from duelytics.llm.store import stored

LEAST_PAGES = 3            # different pages of a host that make a template
SHARE = 0.9                # ... of a layout that hold a class of its template
POOLED = "small hosts"     # the group of hosts with fewer pages

# Elements that hold no main text.
OUTSIDE = frozenset(
    "head title nav aside footer form script style noscript template iframe object embed svg canvas audio video map select"
    " option button input textarea label fieldset legend dialog menu search".split())
# Words in class, id or role that name such an element.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar"
    " sidenav menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar cookie"
    " cookies consent gdpr notice notices notification popup modal overlay dialog comment comments commentlist disqus"
    " respond reply replies share sharing social related recommended newsletter subscribe subscription signup login"
    " search pagination pager copyright complementary contentinfo skip alert toolbar widget".split())
# Words that name an advert or readers' comments or buttons, if the others of the name are listed as well.
CERTAIN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsored comment comments commentlist"
    " disqus share sharing cookie cookies consent".split())
PARTS = frozenset(
    "area bar block bottom box button buttons container entry form icon icons inner item left link links list outer page"
    " post reader readers right section site slot thread top unit user users wrap wrapper".split())
# All that is left out if no lists are to be used: what a browser does not show as text.
UNSEEN = frozenset("head title script style noscript template".split())
MAIN = frozenset(["article", "main"])
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url: str) -> str:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Line(NamedTuple):
    path: str              # of the element that holds the block
    inside: bool           # an article or main element
    outside: bool          # an element without main text
    text: str
    linked: bool = False   # all of it stands in links
    doubted: str = ""      # path of the element around it that goes if the pages agree


class Outline(NamedTuple):
    paths: list[str]       # of the elements, with repetitions
    lines: list[Line]
    layout: int            # a hash of which elements stand directly in the body, but for text


def _is_main(element: Element) -> bool:
    """An article, but for readers' comments, teasers and the like that are written as articles."""
    named = f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}".lower().split()
    return element.attributes.get("role") == "main" or element.tag in MAIN and NAMES.isdisjoint(named)


def _names(element: Element) -> list[list[str]]:
    """The words of each class, id and role."""
    named = " ".join(element.attributes.get(a, "") for a in ("class", "id", "role"))
    return [_WORDS.findall(_CAMEL.sub(" ", name).lower()) for name in named.split()]


def _all_listed(words: list[str]) -> bool:
    return bool(words) and all(w in NAMES or w in CERTAIN or w in PARTS for w in words)


def outline(page: Page, listed: bool = True) -> Outline:
    """Paths of elements, and blocks of text with white space made single. Without `listed` no tag or name
    says that an element holds no main text, but for those that are never seen."""
    elements = page.elements
    holds_main = [False] * len(elements)
    for k in range(len(elements) - 1, 0, -1):
        if _is_main(elements[k]) or holds_main[k]:
            holds_main[elements[k].parent] = True
    paths, main, out = [""] * len(elements), [False] * len(elements), [False] * len(elements)
    link, doubted = [False] * len(elements), [""] * len(elements)
    block_of = [0] * len(elements)
    for k, (tag, parent, attributes) in enumerate(elements):
        if not k:
            continue
        names = _names(elements[k])
        words = [w for name in names for w in name]
        paths[k] = f"{paths[parent]}/{tag}" + "".join(f".{w}" for w in words)
        article = _is_main(elements[k])
        doubted[k] = doubted[parent]
        if not listed:
            bad = tag in UNSEEN
        else:
            bad = tag in OUTSIDE or (tag == "header" and not main[parent])
            if not article and tag not in ("html", "body") and not holds_main[k]:
                bad = bad or "hidden" in attributes or any(
                    _all_listed(name) and not CERTAIN.isdisjoint(name) for name in names)
                if not NAMES.isdisjoint(words) and not bad:
                    if not main[parent]:
                        bad = holds_main[0]
                    if not bad and (not main[parent] or any(
                            _all_listed(name) and not NAMES.isdisjoint(name) for name in names)):
                        doubted[k] = doubted[parent] or paths[k]
        if holds_main[0] and not (main[parent] or article or holds_main[k]) and tag not in ("html", "body"):
            doubted[k] = doubted[k] or paths[k]
        main[k] = main[parent] or article
        out[k] = out[parent] or bad
        link[k] = link[parent] or tag == "a"
        block_of[k] = k if tag in BLOCKS else block_of[parent]
    lines, held, current, holder, linked = [], [], None, 0, True
    for block, element, text in [*page.runs, (-1, 0, "")]:
        if block != current:
            joined = " ".join("".join(held).split())
            if joined:
                lines.append(Line(paths[block_of[holder]], main[holder], False, joined, linked, doubted[holder]))
            held, current, linked = [], block, True
        if out[element]:
            joined = " ".join(text.split())
            if joined:
                lines.append(Line(paths[element], main[element], True, joined))
        elif text:
            if text.strip():
                holder, linked = element, linked and link[element]
            held.append(text)
    top = sorted({paths[k] for k, e in enumerate(elements) if e.tag in BLOCKS - TEXT_BLOCKS
                  and paths[e.parent].rpartition("/")[2].split(".")[0] in ("", "html", "body")})
    layout = hashlib.blake2b("\n".join(top).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return Outline(paths[1:], lines, int.from_bytes(layout, "big", signed=True))


def line_token(line: Line) -> str:
    """A line of text and where it stands, without its length."""
    return f"{line.path}\n{hashlib.blake2b(line.text.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def holder_of(line: Line) -> str:
    """The element whose text a line is: a paragraph is text of the element around it."""
    holder, _, last = line.path.rpartition("/")
    return holder if last.split(".")[0] in TEXT_BLOCKS else line.path


_HOLDER = rf"/(?:{'|'.join(sorted(TEXT_BLOCKS))})(?:\.[^/]*)?$"


def _below_body(path: str) -> bool:
    return path.rpartition("/")[2].split(".")[0] not in ("", "html", "body")


def page_tokens(shape: Outline) -> dict[tuple[str, str], list[int]]:
    """How often a page holds each (kind, token), and its words: of a line, or directly in an element, but
    for lines of nothing but links that stand in no article. Besides elements and lines: `page`, of a page
    that has tokens; `links`, an element that has lines of nothing but links in it; `doubted`, a line in an
    element that goes if the pages agree, with 0 words if it is links."""
    found: dict[tuple[str, str], list[int]] = {}
    for path in shape.paths:
        found.setdefault(("element", path), [0, 0])[0] += 1
    for line in shape.lines:
        if line.outside:
            continue
        words, token = line.text.count(" ") + 1, line_token(line)
        found.setdefault(("line", token), [0, 0])[0] += 1
        if line.inside or not line.linked:
            found["line", token][1] += words
            found.setdefault(("element", holder_of(line)), [0, 0])[1] += words
        else:
            path = holder_of(line)
            while path:
                found["links", path] = [1, 0]
                path = path.rpartition("/")[0]
        if line.doubted:
            found["doubted", line_token(line._replace(path=line.doubted))] = [1, 0 if line.linked else words]
    if found:
        found["page", ""] = [1, 0]
    return found


def tokens(pages: DataFrame, listed: bool = True) -> DataFrame:
    """group, page, layout, kind, token, n, words: the tokens of each page."""

    def work(batches):
        for batch in batches:
            rows = []
            for group, page, html in zip(batch.column("group").to_pylist(), batch.column("page").to_pylist(),
                                         batch.column("html")):
                shape = outline(read(html.as_py()), listed)
                rows += [(group, page, shape.layout, kind, token, n, words)
                         for (kind, token), (n, words) in page_tokens(shape).items()]
            columns = zip(*rows) if rows else [[]] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["group", "page", "layout", "kind", "token", "n", "words"])

    return pages.select("group", "page", "html").mapInArrow(
        work, "group string, page long, layout long, kind string, token string, n long, words long")


def deduced(pages: DataFrame, least: int = LEAST_PAGES, listed: bool = True) -> DataFrame:
    """group, different, wording, slot, chrome: the fixed lines of each group's template; the paths, one in a
    line, of elements that hold words outside the wording, if links alone stand in them on some page; the
    paths of doubted elements most of whose lines recur on `least` different pages, links not counted.
    `pages`: group, page (a hash of the html), html. Pages without tokens and copies of a page do not count.
    A class belongs to the template of a layout when at least SHARE of the layout's different pages hold it
    and its tokens nest; layouts of fewer than `least` pages have no classes of their own. What is listed
    for a group are elements and lines of its templates, however many pages it has."""
    counted = tokens(pages, listed).distinct()
    # An occurrence vector as two order-free sums of 32 bits of a hash of (page, occurrences).
    entry = F.xxhash64("page", "n")
    vectors = counted.groupBy("group", "layout", "kind", "token").agg(
        F.count("*").alias("support"), F.sum(entry.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(entry, 32)).alias("high"), F.sum("words").alias("words"))
    vectors = stored(vectors.where((F.col("support") >= least) | ~F.col("kind").isin("element", "line")), "vectors")
    sizes = vectors.where("kind = 'page'").select("group", "layout", F.col("support").alias("pages"))
    classes = vectors.where("kind IN ('element', 'line')").groupBy("group", "layout", "support", "low", "high").agg(
        F.collect_list(F.struct("kind", "token", "words")).alias("tokens"))
    # Accepted as a whole: its tokens stand on the same pages equally often.
    member = classes.join(sizes, ["group", "layout"]).where(
        (F.col("support") >= least) & (F.col("support") >= SHARE * F.col("pages"))).select(
        "group", "layout", F.explode("tokens").alias("member")).select("group", "layout", "member.*")
    # A token nests when the element around it is of such a class as well.
    frame = member.where("kind = 'element'").select(
        F.col("group").alias("g"), F.col("layout").alias("l"), F.col("token").alias("path"))
    lines = member.where("kind = 'line'").withColumn("parent", F.split("token", "\n")[0]).join(
        frame, (F.col("group") == F.col("g")) & (F.col("layout") == F.col("l")) & (F.col("parent") == F.col("path")),
        "left_semi")
    wording = lines.groupBy("group").agg(F.collect_set("token").alias("wording"))
    worded = lines.select(
        "group", F.regexp_replace("parent", _HOLDER, "").alias("token"), (-F.col("words")).alias("words"))
    links = vectors.where("kind = 'links'").select("group", "token").distinct()
    slots = vectors.where("kind = 'element' AND words > 0").select("group", "token", "words").unionByName(worded).groupBy(
        "group", "token").agg(F.sum("words").alias("words")).where("words > 0").join(
        links, ["group", "token"], "left_semi").groupBy("group").agg(
        F.array_join(F.array_sort(F.collect_list("token")), "\n").alias("slot"))
    # Lines in a doubted element: those that recur in the group, whatever the layout, against all.
    recurring = vectors.where("kind = 'doubted'").groupBy("group", "token").agg(
        F.sum("support").alias("support"), F.max("words").alias("words")).select(
        "group", F.split("token", "\n")[0].alias("path"),
        F.when(F.col("words") > 0, F.col("support")).otherwise(0).alias("held"),
        F.when((F.col("words") > 0) & (F.col("support") >= least), F.col("support")).otherwise(0).alias("again"))
    chrome = recurring.groupBy("group", "path").agg(F.sum("held").alias("held"), F.sum("again").alias("again")).where(
        "2 * again > held OR held = 0").groupBy("group").agg(
        F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("chrome"))
    return sizes.groupBy("group").agg(F.sum("pages").alias("different")).join(
        wording, "group", "left").join(slots, "group", "left").join(chrome, "group", "left")


def main_text(html: str | None, wording: frozenset[str] = frozenset(), slot: str | None = None,
              chrome: str | None = None, listed: bool = True) -> str:
    """The remaining text of a page: what varies of the whole body, in an article or not.

    Lines of nothing but links go where they stand neither in an article nor in an element that holds other
    words, on this page or by the host's slots; lines in doubted elements go as the host's `chrome` says. If nothing else is left, such lines stay. Where all lines of a page
    are wording, those of its article stay: pages that are near copies look like a template."""
    lines = [line for line in outline(read(html), listed).lines if not line.outside]
    varying = [line for line in lines if line_token(line) not in wording]
    gone = frozenset(chrome.split("\n")) if chrome else frozenset()
    stay = [line for line in varying if line.doubted not in gone]
    exact = {holder_of(line) for line in stay if not line.linked}.union(slot.split("\n") if slot else ())
    around = tuple(path + "/" for path in exact if _below_body(path))
    chosen = [line for line in stay if not line.linked or line.inside or holder_of(line) in exact
              or line.path.startswith(around)]
    varying = chosen or varying
    return "\n".join(line.text for line in varying or lines if varying or line.inside)


def extract(pages: DataFrame, least: int = LEAST_PAGES, listed: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`.

    Null and empty html, and pages without main text, give an empty text. Equal pages of a host
    change nothing about its template and are all extracted; a url that is null or has no host belongs to a host of
    its own. Hosts with fewer than `least` different pages are taken together. Without
    `listed` the classes alone decide. Other columns are not looked at; an empty table gives no rows.
    """
    rows = pages.select(
        F.col("page_id"), F.col("url"), F.coalesce(host_of("url"), F.lit("")).alias("host"), F.col("html"))
    hosts = rows.groupBy("host").agg(F.count_distinct(F.xxhash64("html")).alias("different"))
    # Stored: Spark knows how small the tables of hosts are, and moves no page to join them.
    groups = stored(hosts.select(F.col("host").alias("h"), F.when(
        F.col("different") >= least, F.concat(F.lit("host "), "host")).otherwise(F.lit(POOLED)).alias("group")),
        "groups")
    grouped = rows.join(groups, F.col("host") == F.col("h")).select(
        "page_id", "url", "group", "html", F.xxhash64("html").alias("page"))
    templates = stored(
        deduced(grouped.select("group", "page", "html"), least, listed).withColumnRenamed("group", "g"), "templates")

    def work(batches):
        for batch in batches:
            known = (batch.column(c).to_pylist() for c in ("wording", "slot", "chrome"))
            texts = [main_text(html.as_py(), frozenset(wording or ()), slot, chrome, listed)
                     for html, wording, slot, chrome in zip(batch.column("html"), *known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return grouped.join(templates, F.col("group") == F.col("g"), "left").select(
        "page_id", "url", "html", "wording", "slot", "chrome").mapInArrow(
        work, f"page_id {kind}, url string, text string, n_chars long")
