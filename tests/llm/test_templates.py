import random

import pytest
from pyspark.sql import functions as F

from duelytics.llm import templates
from duelytics.llm.html_tree import read
from duelytics.llm.templates import main_text

CASES = {
    "<article><h1>T</h1><p>one <b>two</b>three</p></article>": "T\none twothree",
    "<nav>menu</nav><article><p>a<p>b</article><footer>f</footer>": "a\nb",
    "<article><p>a&amp;b &lt;c&gt; &eacute; &#233; &#xe9;</p></article>": "a&b <c> é é é",
    "<article><p>a\n  b\t c</p></article>": "a b c",
    "<article><p>x<br>y</p></article>": "x y",
    '<script>var t="</p><article>no</article>";</script><article><p>yes</p></article>': "yes",
    "<style>p{}</style><article>bare text<p>p</p>tail</article>": "bare text\np\ntail",
    "<article><p>a</p><!-- <p>no</p> --><p>b</p></article>": "a\nb",
    "<article><p>a</p><aside>no</aside><form><label>no</label><input></form><p>b</p></article>": "a\nb",
    '<article><p>a</p><div class="ad">no</div><div id="share-buttons">no</div><p>b</p></article>': "a\nb",
    '<article><p>a</p></article><section class="comments"><article class="comment"><p>no</p></article></section>': "a",
    '<article><p>a</p><section id="comments"><p>no</p></section></article>': "a",
    '<main><article><p>a</p><article class="comment">no</article></article></main>': "a",
    "<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>a</p></article>": "T\na",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>": "a\nb\nc\nd\ne",
    "<article><p><b>open<br><p>next</article>": "open\nnext",
    "<article><p>never closed": "never closed",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
    "<article><p title='a>b'>x</p></article>": "x",
    "<article><p title='open>x</p><p>y</p></article>": "x\ny",
    "<ARTICLE><P>upper</P></ARTICLE>": "upper",
    '<body class="has-sidebar"><div class="header-wrap"><article><p>a</p></article></div></body>': "a",
    "<article><p hidden>no</p><p>a</p><noscript>no</noscript></article>": "a",
    "<div><p>no article here</p></div><footer>f</footer>": "no article here",
    "<article></article>": "",
    "": "",
    "plain text": "plain text",
    "<article><pre>a\n b</pre><blockquote>q</blockquote></article>": "a b\nq",
    "<title>t</title><div class='cookie-notice'>no</div><main><h2>h</h2>x</main>": "h\nx",
    "<article><p>a</p><textarea>no</textarea><select><option>no</select><button>no</button>b</article>": "a\nb",
}


@pytest.mark.parametrize("html", CASES)
def test_pages_of_their_own(html):
    assert main_text(html) == CASES[html]


def test_reader_survives_anything():
    for html in ("<", "<a", "</", "<!--", "<!", "<a b='", "<p><p><p>", "</p></div>", "<script>", "<a" * 3000, "<b>" * 5000):
        read(html)
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def pages(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "1 AS host", "2 AS page", "'x' AS text", "3 AS slot", "4 AS pages") if clashing else df


def soup(k):
    return (f"<html><body><div class=top>My Site</div><div class=list><a>story {k}</a></div><div class=stuff><h1>Title {k}</h1>"
            + "".join(f"<p>paragraph {j} of page {k} with several words</p>" for j in range(3 + k % 3))
            + f"</div><div class=side><p>Most read</p></div><div class=low>All rights reserved</div></body></html>")


def test_template_of_a_host_without_article_elements(spark):
    rows = [(k, f"http://site.example/{k}", soup(k)) for k in range(8)]
    rows += [(20, "http://other.example/", "<article><p>x</p></article>"), (21, "https://User@SITE.example:80/z", soup(30)),
             (22, None, "<p>no url</p>"), (23, "http://site.example/n", None), (24, "http://site.example/e", ""),
             (3, "http://site.example/3", soup(3)), (25, "http://site.example/copy", soup(3))]
    got = {}
    for r in templates.extract(pages(spark, rows, clashing=True)).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, set()).add(r.text)
    for i, url, html in rows[:9] + rows[9:10]:
        if "site.example" in (url or "").lower() and html:
            k = 30 if i == 21 else i
            assert got[i] == {"\n".join([f"Title {k}"] + [f"paragraph {j} of page {k} with several words" for j in range(3 + k % 3)])}
    assert got[20] == {"x"} and got[22] == {"no url"} and got[23] == {""} and got[24] == {""} and got[25] == got[3]
    assert templates.extract(pages(spark, rows)).count() == len(rows)
    assert templates.extract(pages(spark, [])).count() == 0


def test_fixed_lines_and_slot_are_deduced(spark):
    rows = spark.createDataFrame([("g", k, soup(k)) for k in range(6)], "group string, page long, html string")
    found = templates.deduced(rows).head()
    assert found.different == 6 and found.slot is None and found.chrome is None
    paths = {"My Site": "top", "All rights reserved": "low", "Most read": "side/p"}
    assert set(found.wording) == {
        templates.line_token(templates.Line(f"/html/body/div.{path}", False, False, text)) for text, path in paths.items()}


def test_a_line_on_every_page_of_a_large_host_is_no_text(spark):
    rows = [(k, "http://a.example/", f"<article><p>Text {k} of its own</p><p>Share this article</p></article>") for k in range(12)]
    got = templates.extract(pages(spark, rows)).select(F.collect_set("text")).head()[0]
    assert set(got) == {f"Text {k} of its own" for k in range(12)}


def test_empty_and_odd_pages_do_not_hide_the_template_of_a_large_host(spark):
    def page(k):
        return f"<body><div class=top>My Site</div><div class=stuff><p>Text {k} of its own</p></div><div class=low>Imprint</div></body>"

    rows = [(k, "http://a.example/", page(k)) for k in range(300)]
    rows += [(300, "http://a.example/", ""), (301, "http://a.example/", None),
             (302, "http://a.example/", "<body><table><tr><td>odd</table></body>"),
             (303, "http://a.example/", page(303).replace("<div class=low>Imprint</div>", ""))]
    # A second layout, and many copies of one page, which make its text no wording.
    rows += [(400 + k, "http://a.example/", f"<body><section><div>Fixed</div><p>Other {k}</p></section></body>") for k in range(40)]
    rows += [(7, "http://a.example/", page(7))] * 5000
    got = {r.page_id: r.text for r in templates.extract(pages(spark, rows)).collect()}
    assert all(got[k] == f"Text {k} of its own" for k in range(300))
    assert got[300] == got[301] == "" and got[302] == "odd" and got[303] == "Text 303 of its own"
    assert all(got[400 + k] == f"Other {k}" for k in range(40))


def test_all_slots_of_all_layouts_are_main_text(spark):
    def first(k):
        return (f"<body><div class=top>My Site</div><div class=list><a>story {k}</a></div><div class=caption><h1>Title {k}</h1></div>"
                f"<div class=content><p>lead {k}</p><section><p>many more words of section {k}</p><p>and more {k}</p></section></div>"
                f"<div class=content><p>second part {k}</p><ul><li><a>source {k}</a></ul></div></body>")

    def second(k):
        return f"<body><table><tr><td>My Table<td><a>entry {k}</a><td>cell {k}<p>words of cell {k}</p></table></body>"

    rows = [(k, "http://a.example/", first(k)) for k in range(20)] + [(100 + k, "http://a.example/", second(k)) for k in range(9)]
    # Small hosts: the words of one host do not cut another one's page.
    rows += [(200 + k, f"http://s{k}.example/", f"<div class=content><p>far more words than others {k}</p></div>") for k in range(5)]
    rows += [(300, "http://s9.example/", "<div class=caption>Short</div><div class=content><p>text</p></div><div><a>link</a></div>")]
    got = {r.page_id: r.text for r in templates.extract(pages(spark, rows)).collect()}
    for k in range(20):
        assert got[k] == (f"Title {k}\nlead {k}\nmany more words of section {k}\nand more {k}\nsecond part {k}\nsource {k}")
    for k in range(9):
        assert got[100 + k] == f"entry {k}\ncell {k}\nwords of cell {k}"
    assert got[300] == "Short\ntext"     # the same on small hosts


def test_articles_do_not_stand_for_the_template(spark):
    def page(k):
        return (f"<body><div class=top>My Site</div><div class=caption><h1>Title {k}</h1></div><article><p>Text {k} of its own</p>"
                f"<ul><li><a>source {k}</a></ul><p>Share this article</p></article><div class=list><a>story {k}</a></div></body>")

    # A fixed line in an article goes on hosts of every size.
    rows = [(100 * n + k, f"http://host{n}.example/", page(k)) for n in (3, 7, 8, 20) for k in range(n)]
    rows += [(k, "http://copies.example/", f"<article><p>one text</p></article><footer>{k}</footer>") for k in range(4)]
    got = {r.page_id: r.text for r in templates.extract(pages(spark, rows)).collect()}
    for n in (3, 7, 8, 20):
        for k in range(n):
            assert got[100 * n + k] == f"Title {k}\nText {k} of its own\nsource {k}"
    assert all(got[k] == "one text" for k in range(4))


KEPT = ["share-prices", "header-story", "related-work", "banner", "notice-of-meeting", "comment-analysis"]


@pytest.mark.parametrize("name", KEPT)
def test_names_alone_take_no_text_out_of_an_article(name):
    html = f'<article><div class="{name}"><p>Paragraph of the article.</p></div><p>End.</p></article>'
    assert main_text(html) == "Paragraph of the article.\nEnd."
    assert main_text(html.replace("article>", "section>")) == "Paragraph of the article.\nEnd."


def test_a_listed_name_counts_where_the_pages_agree(spark):
    def page(k, notice):
        return (f'<body><div class=content><h1>Title {k}</h1><div class="banner"><p>{notice}</p></div><p>Text {k} of its own</p>'
                f'<div class="related"><a>other {k}</a></div></div></body>')

    # Three notices in turn, too rare for the wording; on the other host what stands there is of the page.
    rows = [(k, "http://turns.example/", page(k, f"notice {k % 3}")) for k in range(30)]
    rows += [(100 + k, "http://own.example/", page(k, f"summary of page {k}")) for k in range(30)]
    got = {r.page_id: r.text for r in templates.extract(pages(spark, rows)).collect()}
    for k in range(30):
        assert got[k] == f"Title {k}\nText {k} of its own"
        assert got[100 + k] == f"Title {k}\nsummary of page {k}\nText {k} of its own"


def test_lines_of_links_by_one_rule_at_every_host_size(spark):
    def page(k):
        return (f"<body><div class=words><p>words {k}</p></div><div class=zz><ul><li><a>link {k}</a></ul></div>"
                f"<div class=mixed>{f'note {k}' if k % 2 else ''} <p><a>source {k}</a></p></div></body>")

    rows = [(100 * n + k, f"http://host{n}.example/", page(2 * k + 1)) for n in (1, 2, 3, 12) for k in range(n)]
    rows += [(9000 + k, "http://host20.example/", page(k)) for k in range(20)]
    got = {r.page_id: r.text for r in templates.extract(pages(spark, rows), least=3).collect()}
    for n in (1, 2, 3, 12):
        for k in range(n):
            assert "link" not in got[100 * n + k] and got[100 * n + k].endswith(f"note {2 * k + 1}\nsource {2 * k + 1}")
    # A slot of the host stays one on its pages with links alone.
    assert got[9000] == "words 0\nsource 0"


def brute_force(pages_of, least):
    """wording and chrome of one group from plain occurrence vectors over its different pages."""
    shapes = {html: templates.outline(read(html)) for html in pages_of if html}
    found = {html: templates.page_tokens(shape) for html, shape in shapes.items()}
    found = {html: t for html, t in found.items() if t}
    wording = set()
    for layout in {shapes[h].layout for h in found}:
        held = [h for h in found if shapes[h].layout == layout]
        support = {}
        for kind, token in {t for h in held for t in found[h]}:
            if kind in ("element", "line"):
                support[kind, token] = sum((kind, token) in found[h] for h in held)
        fixed = {t for t, n in support.items() if n >= least and n >= templates.SHARE * len(held)}
        wording |= {token for kind, token in fixed if kind == "line" and ("element", token.split("\n")[0]) in fixed}
    doubted = {}
    for tokens in found.values():
        for (kind, token), (n, words) in tokens.items():
            if kind == "doubted":
                doubted.setdefault(token, []).append(words)
    paths = {}
    for token, words in doubted.items():
        count = paths.setdefault(token.split("\n")[0], [0, 0])
        if any(words):
            count[0] += len(words)
            count[1] += len(words) if len(words) >= least else 0
    return wording, {path for path, (n, again) in paths.items() if 2 * again > n or not n}


def test_deduction_against_brute_force(spark):
    rng = random.Random(7)

    def page():
        parts = []
        for name in ("top", "banner", "content", "sidebar", "low"):
            if rng.random() < 0.93:
                texts = [rng.choice(["fixed", "fixed", f"turn {rng.randrange(3)}", f"own {rng.random()}"]) for _ in range(2)]
                texts[0] = "fixed" if name in ("top", "low") else texts[0]
                parts.append(f"<div class={name}>" + "".join(f"<p>{t}</p>" for t in texts) + "<a>more</a></div>")
        article = "<article><p>text</p></article>" if rng.random() < 0.5 else ""
        return f"<body>{''.join(parts)}{article}</body>" if parts else ""

    groups = {f"g{n}": [page() for _ in range(n)] * 2 + ["", None] for n in (1, 3, 5, 40)}
    rows = [(g, hash(html), html) for g, htmls in groups.items() for html in htmls]
    df = spark.createDataFrame(rows, "group string, page long, html string").repartition(5)
    got = {r.group: r for r in templates.deduced(df).collect()}
    for g, htmls in groups.items():
        wording, chrome = brute_force(htmls, templates.LEAST_PAGES)
        assert set(got[g].wording or ()) == wording
        assert set((got[g].chrome or "").split("\n")) - {""} == chrome
    assert any(got[g].wording for g in got) and any(got[g].chrome for g in got)


def test_elements_beside_an_article_go_where_their_lines_recur(spark):
    def page(k):
        return (f"<body><div class=zz>Turn {k % 3} of it</div><div class=caption><h1>Title {k}</h1></div>"
                f"<article><p>Text {k}</p><div class=zz>Turn {k % 3} of it</div></article></body>")

    rows = [(k, "http://turns.example/", page(k)) for k in range(30)]
    for listed in (True, False):
        got = {r.page_id: r.text for r in templates.extract(pages(spark, rows), listed=listed).collect()}
        assert all(got[k] == f"Title {k}\nText {k}\nTurn {k % 3} of it" for k in range(30))
