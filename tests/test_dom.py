"""HTML parsing, cleaning, main content and blocks."""

from __future__ import annotations

import time

import pytest
from gleaner.sources.dom import main_content, page_blocks, parse, strip_frame


def texts(html: str) -> list[tuple[str, str]]:
    return [(b.type, b.text) for b in page_blocks(html)[1]]


def paths(html: str) -> list[tuple[str, list[str]]]:
    return [(b.text, b.heading_path) for b in page_blocks(html)[1]]


def test_implied_ends_and_misnesting():
    assert texts("<main><p>one<p>two <b>bold<p>three</b></main>") == [("p", "one"), ("p", "two bold"), ("p", "three")]
    assert texts("<main><ul><li>a<li>b<ul><li>c</ul><li>d</ul></main>") == [("li", "a"), ("li", "bc"), ("li", "d")]
    assert texts("<main><p>a<br>b &amp; c&nbsp;d</p></main>") == [("p", "ab & c d")]
    assert texts("<main><p>x < y and z</p><p>1 &lt; 2</p></main>") == [("p", "x < y and z"), ("p", "1 < 2")]


def test_raw_text_and_comments():
    assert texts("<main><script>var t='</p><p>no';</script><p>yes<!-- <p>no</p> --></p></main>") == [("p", "yes")]
    assert page_blocks("<title>a<b></title><main><p>x</main>")[1][0].text == "x"


def test_dropped_elements_even_inside_main():
    assert texts("<main><form><p>in a form</p></form><label>l</label><p>kept</p></main>") == [("p", "kept")]
    assert texts("<form><main><p>all gone</p></main></form>") == []


def test_frames_outside_main_go_inside_stay():
    html = "<nav><p>n</p></nav><div class=sidebar><p>s</p></div><article><header><p>head</p></header><div class='share-box'><p>kept by name</p></div><p>body</p></article><footer><p>f</p></footer>"
    assert texts(html) == [("p", "head"), ("p", "body")]  # share-box is a control inside main
    assert texts("<body class='loading'><div><p>a class deletes the page</p></div></body>") == []
    assert texts("<body class='loading'><div><main><p>kept</p></main></div></body>") == [("p", "kept")]
    assert texts("<div class='protocol'><p>toc in the name</p></div><div><p>a longer text than the other</p></div>") == [("p", "a longer text than the other")]


def test_controls_inside_main():
    html = """<main><p>Text stays here.</p><div>Copy code</div><a href='#x'></a><span aria-label='copy it'>c</span><div class='Tabs'><p>t</p></div>
    <p><a>one</a> <a>two</a> <a>three</a></p><p>plain <a>link</a> in a sentence that goes on</p><div title='Copy'>x</div></main>"""
    assert texts(html) == [("p", "Text stays here."), ("p", "plain link in a sentence that goes on")]


def test_main_content_choice():
    assert page_blocks("<main><p>a</main><main><p>b</main><article><p>c</article>")[0] == "main"
    assert texts("<main><p>a</p></main><main><p>b</p></main>") == [("p", "a"), ("p", "b")]
    assert page_blocks("<article><p>a</article>")[0] == "article"
    assert page_blocks("<div id=x><p>short</div><div class='content big'><p>much longer text</div>")[0] in (".content", "div.content.big")
    assert page_blocks("<div><p>text <a>with a very long link in it</a></div><section><p>plain</section>")[0] == "section"
    assert page_blocks("") == (None, []) and page_blocks(None) == (None, [])


def test_ties_go_by_selector():
    root = parse("<section><p>same</section><div><p>same</div>")
    strip_frame(root)
    assert main_content(root)[0] == "div"


def test_heading_paths():
    html = "<main><h1>A</h1><p>1</p><h2>B</h2><p>2</p><h2>C</h2><p>3</p><h4>D</h4><p>4</p><h4>E</h4><p>5</p><h1>F</h1><p>6</p></main>"
    got = dict(paths(html))
    assert got["1"] == ["A"] and got["2"] == ["A", "B"] and got["3"] == ["A", "C"] and got["C"] == ["A"]
    assert got["5"] == ["A", "C", "D", "E"]  # a skipped level leaves the sibling
    assert got["6"] == ["F"]


def test_code():
    assert texts("<main><pre>\n  a\n  b  \n</pre></main>") == [("pre", "a\n  b")]
    assert texts("<main><pre><div class='line'>x = 1</div><div class='line'> y = 2</div></pre></main>") == [("pre", "x = 1\ny = 2")]
    assert texts("<main><pre>a<br>b<br/>c</pre></main>") == [("pre", "a\nb\nc")]
    assert texts("<main><ul><li>use <pre>code\nhere</pre></li></ul></main>") == [("li", "use code here")]
    assert texts("<main><div>bare text goes</div><blockquote>so does this</blockquote><p>this stays</p></main>") == [("p", "this stays")]


@pytest.mark.parametrize("html", ["<", "<p", "</", "<!--", "<a href='x>", "<p></div></p></li>", "<table><tr><td><p>x<tr><td>y</table>", "<svg/><p>x", "a" * 10_000 + "<b>" * 2_000])
def test_odd_input_never_fails(html):
    page_blocks(html)


@pytest.mark.parametrize("html", ["<main><pre>" + "<b>" * 30_000 + "x</pre></main>", "<div>" * 30_000 + "<p>x", "<p>" + "<table><td>" + "<div>" * 20_000 + "<p>x", "<main>" + "<span>" * 20_000 + "<a>y</a>" * 5 + "</span>" * 20_000 + "<p>x", "<p><b>" * 20_000 + "x", "<li>" * 30_000 + "x", "<nav>n</nav>" * 20_000 + "<p>x"])
def test_deep_and_wide_pages_take_linear_time(html):
    began = time.process_time()
    assert any(b.text == "x" for b in page_blocks(html)[1])
    assert time.process_time() - began < 10
