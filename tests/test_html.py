import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from mailsift.functions.html import FREQUENT, MARKUP, decode_entities, html_to_text, without_markup


class Walker(HTMLParser):
    """Text nodes outside script and style, as the standard parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.texts.append(data)


def walk(html):
    walker = Walker()
    walker.feed(html)
    walker.close()
    return re.sub(r"\s+", " ", " ".join(walker.texts)).strip()


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_pages_like_the_standard_parser(spark, scale):
    pages = spark.read.parquet(f"/root/testdata/sf{scale}/pages.parquet")
    rows = pages.select("html", html_to_text(F.col("html")).alias("text")).collect()
    assert rows and all(walk(r.html) == r.text for r in rows)


CASES = [
    "a<!-- x --> b", "a < b > c", "x<a title='>'>y</a>", 'x<a title=">" b>y', "a<!DOCTYPE html>b",
    "a<?php echo 1>2?>b", "<script>var a='</p>';", "a<!-->b-->c", "</3>x", "a<style>p{}</STYLE >b",
    "<sCript x='>'>k</script>z", "<p don't>a 'b' c", "<script-x>k</script-x>", "a <b =x>k",
    "mid<br>word", "<p>a<p/>b", "<!-- <script> -->a<b>c", "<style><!-- p --></style>t",
    "<a href=x?y=1>l</a>", '<img src="data:' + "x" * 200000 + '">e', "<b>" * 20000 + "deep",
    "&#0065; &rarr; &zwj; AT&T &", "&amp;lt; &amp;amp;", "&#8217;x &#x1F600; &#65279;a",
    "&quot;&apos;&nbsp;&copy;", "a&b=c", "", "plain", "a & b &; &# &#x;",
]


def test_markup_like_the_standard_parser(column_of):
    assert column_of(html_to_text, CASES) == [walk(h) for h in CASES]


def test_numeric_references_out_of_range(column_of):
    values = ["&#128;", "&#x80;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#" + "9" * 40 + ";", "&#x" + "f" * 40 + ";", "&#0000065;", "&#x10FFFF;"]
    assert column_of(decode_entities, values) == ["€", "€", "�", "�", "�", "�", "�", "A", "\U0010ffff"]


def test_unknown_reference_stays_without_semicolon(column_of):
    assert column_of(decode_entities, ["&nosuch; x", "&nosuch x"]) == ["&nosuch x", "&nosuch x"]


def test_both_ways_of_decoding_agree(column_of):
    frequent = " ".join(f"&{n};" for n in FREQUENT) + "&amp;lt;"
    fast, general = column_of(decode_entities, [frequent, frequent + "&rarr;"])
    assert general == fast + "→"


def test_missing_html_is_empty(column_of):
    assert column_of(html_to_text, [None]) == [""]


def test_sheltering_changes_nothing(column_of):
    rng = random.Random(12)
    parts = ["<", ">", "<!--", "-->", "--", "<a ", "</b", "<script>", "</script>", "<style x='>'", '="', '"', "'", "x", " ",
             "<!", "<?", "\ufdd0", "="]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert column_of(without_markup, values) == column_of(lambda c: F.regexp_replace(c, MARKUP, " "), values)


@pytest.mark.parametrize("piece, tail", [("<a ", "='>"), ("<script ", '=">'), ("<a ='", ">"), ("<rt>", ">"), ("<template ", ">")])
def test_tags_that_end_late_take_linear_time(column_of, piece, tail):
    def seconds(n):
        start = time.time()
        column_of(html_to_text, [piece * n + tail])
        return time.time() - start

    seconds(100)
    assert seconds(100_000) < 6 * max(seconds(25_000), 0.5)


def test_templates_and_reading_aids_are_no_text(column_of):
    values = ["a<template>T</template>b", "<template><p>x", "<ruby>k<rt>r</rt></ruby>", "<rt>r<b>s</b>", "<rtc>x</rtc>"]
    assert column_of(html_to_text, values) == ["a b", "", "k", "", "x"]


HIDDEN = [
    ("a<template>x<template>y</template>z</template>b", "a b"),
    ("a<TEMPLATE id='x>y'>x</Template >b", "a b"),
    ("a</template>b<template/>c", "a b c"),
    ("<ruby>k<rt>r<b>s</b>t</rt></ruby>u", "k u"),
    ("<ruby>k<rt>r<!-- c -->s</rt>l<rp>(</rp></ruby>", "k l"),
    ("<ruby>k<rt>r<rt>s</ruby>t", "k t"),
    ("<ruby>k<rt>r<rp>s</rp>l<rt>t</ruby>u", "k l u"),
    ("<ruby>k<rt><ruby>l<rt>m</rt></ruby>n</rt></ruby>o", "k o"),
    ("<p><ruby>k<rt>r</p>s", "k s"),
    ("<rt><div>a</div>b</rt>c", "c"),
    ("a</rt>b</ruby>c<rt >d</rt>", "a b c"),
    ("<template><rt></template>a", "a"),
    ("<rt>a<template></rt></template>b</rt>c", "c"),
    ("<script>'<template>'</script>a<!-- <rt> -->b<rt>c</rt>", "a b"),
    ("a<template title='", "a<template title='"),
    ("\ufdd2a<template>x</template>b", "\ufdd2a b"),
]


def test_nested_templates_and_reading_aids(column_of):
    assert column_of(html_to_text, [h for h, _ in HIDDEN]) == [t for _, t in HIDDEN]


def test_random_trees_with_hidden_elements(column_of):
    """Trees whose every element is closed: what is hidden is known when they are made."""
    rng = random.Random(5)

    def tree(depth, hidden, out):
        html = ""
        for _ in range(rng.randint(0, 4)):
            word = f"w{rng.randint(0, 999)}"
            html += f" {word} "
            if not hidden:
                out.append(word)
            if depth:
                tag = rng.choice(["template", "ruby", "rt", "rp", "b", "p", "div", "table", "i"])
                # An aid right inside an aid would end it.
                inner = tree(depth - 1, hidden or tag in ("template", "rt", "rp"), out)
                html += f"<ruby><{tag}>{inner}</{tag}></ruby>" if tag in ("rt", "rp") else f"<{tag} x='>'>{inner}</{tag}>"
                html += rng.choice(["", "<br>", "<!-- <rt> -->", "<hr/>"])
        return html

    made = []
    for _ in range(300):
        out = []
        made.append((tree(5, False, out), out))
    # More tags than go into one chunk of the fold.
    assert max(h.count("<") for h, _ in made) > 600
    assert column_of(html_to_text, [h for h, _ in made]) == [" ".join(out) for _, out in made]


@pytest.mark.parametrize("piece", ["<template>x", "<template>x</template>y", "<ruby>a<rt>b<i>c</i></rt></ruby>", "<ruby><rt><p>", "<ruby>"])
def test_hidden_elements_take_linear_time(column_of, piece):
    def seconds(n):
        start = time.time()
        column_of(html_to_text, ["<rt>" + piece * n])
        return time.time() - start

    seconds(100)
    assert seconds(60_000) < 6 * max(seconds(15_000), 0.5)


def test_an_unclosed_quote_is_a_plain_character(column_of):
    assert column_of(html_to_text, ["<p title='a>b</p>", '<p a=">c', "<p a='x>y'>d"]) == ["b", "c", "d"]


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "<!-- >", "</", "<script ", "<", "&#", "&amp"])
def test_unclosed_markup_takes_linear_time(column_of, piece):
    start = time.time()
    column_of(html_to_text, ["text " + piece * 100000])
    assert time.time() - start < 20
