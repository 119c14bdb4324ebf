import time

import pytest

from mailsift.llm.html_density import density, extract_text, main_text
from mailsift.llm.queries import QUERIES

LONG = "This sentence is part of the article and is long enough to be taken for prose, as it should be."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    text = main_text(page(
        '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies. ' + LONG + "</div>"
        f'<main><article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><p>Short.</p>'
        f'<form><p>Your mail</p><input></form><script>var t="</p>";</script><style>x</style>'
        f'<div class="ad">Buy {LONG}</div><p>One<b>two</b> <a href="x">three</a>\n\t four&nbsp;&lt;five&#x3e;</p>'
        f'<ul><li>First<li>Second <i>item</i></ul><aside>Side {LONG}</aside></article>'
        f'<section id="comments"><article class="comment"><p>{LONG} says a reader</p></article></section></main>'
        f'<div class="sidebar">{LONG}</div><footer>&copy; {LONG}</footer>'
    ))
    assert text == f"Title & more\n{LONG}\nShort.\nOnetwo three four <five>\nFirst\nSecond item"


@pytest.mark.parametrize(
    "what",
    ['class="topnav"', 'id="main-menu"', 'class="x sideBar-left"', 'aria-label="Main navigation"', 'role="navigation"',
     'id="commentlist"', 'class="user-comments"', 'style="display: none"', "hidden"],
)
def test_surroundings_by_their_attributes(what):
    part = f"<div {what}><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page(f"{part}<article class='commentary'><p>{LONG}</p>{part}<p>b</p></article>{part}")) == f"{LONG}\nb"


def test_the_header_of_an_article_is_not_that_of_the_page():
    head = f'<div class="header page-header"><h1>Title</h1><p>{LONG}</p></div>'
    assert main_text(page(f"{head}<article>{head}<p>{LONG}</p></article>")) == f"Title\n{LONG}\n{LONG}"
    assert main_text(page(f'<div id="siteheader"><article><p>{LONG}</p></article></div>')) == LONG


def test_without_article_element():
    body = f'<div><a href="/">Home</a> <a href="/b">About us</a></div><div id="c"><h2>T</h2><p>{LONG}</p><p>{LONG}</p><p>Ok.</p></div>'
    body += '<div><ul><li><a href="/1">Other story one</a></li><li><a href="/2">Other story two</a></li></ul></div>'
    assert main_text(page(body)) == f"T\n{LONG}\n{LONG}\nOk."


def test_article_in_several_sections():
    part = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    body = f'<div class="nav"><a href="/">Home</a></div><div id="c">{part}{part}<div><p>{LONG}</p></div></div>'
    assert main_text(page(body)) == "\n".join([LONG] * 5)


def test_unclosed_markup_as_in_the_pages_table():
    body = f"<article><h1>T</h1><p><b>First line.<br><p>{LONG}</p><p>More</p></article><footer>no</footer>"
    assert main_text(page(body)) == f"T\nFirst line.\n{LONG}\nMore"
    assert main_text(f"<article><p>{LONG}<p>cut of") == f"{LONG}\ncut of"


def test_a_wrapper_with_a_telling_name_does_not_hide_the_article():
    assert main_text(f'<form class="search-menu"><article><p>{LONG}</p></article></form>') == LONG
    assert main_text(f'<body class="has-sidebar"><main><p>{LONG}</p></main></body>') == LONG


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), (" \n ", ""), ("<p></p>", ""), ("plain text", "plain text"), ("a < b & c", "a < b & c"),
        ("<p>a<p>b", "a\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<!-- x", ""), ("x<!-- <p>y</p> -->z", "xz"),
        ("<script>x", ""), ("<P CLASS='x>y'>q</P>", "q"), ("<p title=\"a'>b\">c</p>", "c"), ("<p title=\">d", "d"),
        ("</div></p>e</b>", "e"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("&#0; &amp;lt; &bogus; &eacute", "� &lt; &bogus; é"),
        ("<nav>only a menu</nav>", ""), ("a<br>b", "a b"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "piece, tail",
    [("<a ", "='>"), ("<script ", '=">'), ("<div>", ""), ("</div>", ""), ("<li>", ""), ("<p><b>", ""), ("<!--", ""), ("&amp", ""), ("<p a='", ""), ("<ul><b><li>", "")],
)
def test_hostile_pages_take_linear_time(piece, tail):
    def seconds(n):
        start = time.process_time()
        main_text(piece * n + tail)
        return time.process_time() - start

    seconds(100)
    small, large = seconds(5_000), seconds(40_000)
    assert large < 30 * small + 1


@pytest.mark.parametrize("wrapper", ["div class='content with-sidebar'", "form", "div class='header'", "div class='user-comments'"])
def test_a_name_does_not_hide_the_whole_page(wrapper):
    body = f"<{wrapper}><h2>T</h2><p>{LONG}</p><p>{LONG}</p></{wrapper.split()[0]}>"
    assert main_text(page(body)) == f"T\n{LONG}\n{LONG}"


def test_parts_of_an_article_with_telling_names():
    text = main_text(page(
        f'<article><h1 id="search">Search</h1><p>{LONG}</p><section id="related-work"><h2 id="related-work">Related work</h2>'
        f'<p>{LONG}</p></section><div class="notice"><p>{LONG}</p></div><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn>'
        '<annotation>x=1</annotation></math></p><div class="share">Share this</div>'
        f'<div class="related"><a href="/">{LONG}</a></div></article>'
    ))
    assert text == f"Search\n{LONG}\nRelated work\n{LONG}\n{LONG}\nso x=1"


@pytest.mark.parametrize(
    "start, end",
    [('<div class="hentry comments-open">', "</div>"), ('<article class="post comments-open">', "</article>"),
     ('<div class="post no-comments">', "</div>"), ('<div id="x" class="entry comments-closed has-sidebar">', "</div>"),
     ('<article class="post"><div class="with-sidebar">', "</div></article>")],
)
def test_states_in_names_do_not_hide_the_article(start, end):
    body = f"{start}<h2>T</h2><p>{LONG}</p><p>{LONG}</p>{end}<p>Copyright Example Ltd</p>"
    assert main_text(page(body)).startswith(f"T\n{LONG}\n{LONG}")
    comments = f'<div id="comments"><p>{LONG} says a reader</p><p>{LONG}</p><p>{LONG}</p></div>'
    assert "reader" not in main_text(page(body + comments))


@pytest.mark.parametrize("name", ['id="newsletter-history"', 'class="modal-verbs"', 'class="sponsored-bridge-project"'])
def test_sections_about_what_their_names_tell(name):
    ads = f'<div class="sponsored-box"><p>{LONG}</p></div><div class="newsletter-signup"><p>{LONG}</p></div>'
    text = main_text(page(f"<article><p>{LONG}</p><section {name}><h2>H</h2><p>{LONG}</p></section>{ads}</article>"))
    assert text == f"{LONG}\nH\n{LONG}"


def test_buttons_in_sentences():
    text = main_text(page(f"<article><p>{LONG}</p><p>Press <button>Save</button> to go on.</p><p><button>Buy</button> now</p></article>"))
    assert text == f"{LONG}\nPress Save to go on.\nnow"


def test_pages_that_show_their_text_without_scripts():
    body = f"<div id='app'></div><noscript><nav>Menu</nav><p>{LONG}</p></noscript>"
    assert main_text(page(body)) == LONG
    assert main_text(page(f"<p>{LONG}</p><noscript><p>Turn on scripts. {LONG}</p></noscript>")) == LONG


def test_pages_without_articles_against_a_plain_walk(prose):
    """Which subtree densities choose, against a walk that measures every element anew."""
    import math
    import re
    from mailsift.llm import html_density as d

    def measure(node, body_share):
        texts, tags, links, linked = [], 0, 0, 0
        stack = [(x, node.tag == "a") for x in node.parts]
        linked += node.tag == "a"
        while stack:
            x, in_link = stack.pop()
            if isinstance(x, str):
                n = len(re.sub(r"\s", "", x))
                texts.append(n)
                links += n if in_link else 0
            elif not x.aside:
                tags += 1
                linked += x.tag == "a"
                stack += [(y, in_link or x.tag == "a") for y in x.parts]
        chars = sum(texts)
        if not chars:
            return 0.0, 0, 0
        top = math.log(chars / max(chars - links, 1) * links + body_share * chars + math.e)
        shape = chars / max(links, 1) * max(tags, 1) / max(linked, 1)
        return chars / max(tags, 1) * math.log(1 + shape) / math.log(1 + top), chars, links

    for k in range(12):
        paragraphs = "".join(f"<p>{prose(10 * k + i, 20 + 7 * i)}</p>" for i in range(1 + k % 4))
        menu = "".join(f'<li><a href="/{i}">{prose(500 + i, 2)}</a></li>' for i in range(3 + k))
        body = f"<div><ul>{menu}</ul></div><div id='c'><h2>{prose(k, 3)}</h2>{paragraphs}</div><div><a href='/'>{prose(k, 4)}</a> {prose(k + 1, 3)}</div>"
        tree = d.Tree(page(body))
        d._weigh(tree, False), d._settle(tree), d._cover(tree), d._measure(tree)
        body_chars, body_links = measure(tree.root, 0.0)[1:]
        share = body_links / body_chars
        plain = [n for n in tree.nodes if not n.aside]
        sums = [sum(measure(x, share)[0] for x in n.parts if isinstance(x, d.Node) and not x.aside) for n in plain]
        assert all(abs(n.total - s) < 1e-6 * max(s, 1) for n, s in zip(plain, sums))
        best = plain[sums.index(max(sums))]
        chosen, threshold = d._chosen(tree)
        path = [best]
        while path[-1].parent is not None:
            path.append(path[-1].parent)
        assert chosen in path and abs(threshold - min(measure(n, share)[0] for n in path)) < 1e-6


def test_sources_of_an_article():
    sources = '<ol><li><a href="/1">Source one</a></li><li><a href="/2">Source two</a></li></ol>'
    assert main_text(page(f"<article><p>{LONG}</p>{sources}</article>")) == f"{LONG}\nSource one\nSource two"


def test_several_articles():
    long, short = (f"<article>{f'<p>{LONG}</p>' * n}</article>" for n in (4, 1))
    body = f'<div class="nav"><a href="/">Home</a></div><div id="c">{long}{short}</div>'
    assert main_text(page(body)) == "\n".join([LONG] * 5)
    nested = f"<article><p>{LONG}</p>{long}</article>"
    assert main_text(page(nested)) == "\n".join([LONG] * 5)


def test_density():
    assert density(0, 0, 0, 0, 0.0) == 0.0
    assert density(400, 2, 0, 0, 0.1) > density(400, 8, 0, 0, 0.1) > density(400, 8, 300, 6, 0.1) > 0


def test_operator(spark):
    schema = "page_id long, url string, html string, text string, n long"
    rows = [(1, "u", f"<p>{LONG}</p>", "t", 1), (1, "u", f"<p>{LONG}</p>", "t", 1), (None, None, None, None, 2)]
    got = sorted(map(tuple, extract_text(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == [(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0)]
    assert extract_text(spark.createDataFrame([], schema)).collect() == []


def test_pages_against_their_markup(spark, sf):
    """The articles of the given pages hold nothing but headings, paragraphs and bold text."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op8_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)\b[^>]*>", article)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " , b)).split()) for b in blocks]
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text)
