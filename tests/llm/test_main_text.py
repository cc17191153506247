"""Page texts: pages with known texts, an independent parser on the test tables, and pages that mark nothing."""

import os
from html.parser import HTMLParser

import pytest

from lagline.llm.main_text import PageModel, counts, fit_pages, main_text, parse

D = "/root/testdata/sf0.01"
PARAGRAPHS = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "One two three four five six seven eight nine ten & more.", "Last words of the text stand here, in a longer paragraph."]
TEXT = "\n".join(["A title", *PARAGRAPHS])
BODY = "<h1>A title</h1>" + "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in PARAGRAPHS)


def page(body, before="<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now, it is very cheap.</div>", after="<footer>&copy; all rights</footer>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{before}{body}{after}</body></html>"


class Plain(HTMLParser):
    """Blocks inside article, for pages as the tables have them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    return fit_pages(spark.read.parquet(f"{D}/pages.parquet"))


def test_equals_an_independent_parser(spark, model):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = main_text(pages, model).collect()
    assert len(got) == len(html)
    for r in got:
        p = Plain()
        p.feed(html[r.page_id] or "")
        p.close()
        want = "\n".join(s for s in (" ".join(b.split()) for b in p.blocks) if s)
        assert r.text == want and r.n_chars == len(want)


def test_weights_have_the_right_signs(model):
    assert model.words["p"] > 1 and model.words["h1"] > 1
    assert max(model.words[f] for f in ("nav", "footer", "li", "div.ad")) < -1
    assert max(model.tags.values()) <= 0 and model.tags["nav"] < -1 < model.tags["p"]


@pytest.mark.parametrize("learned", [True, False])
@pytest.mark.parametrize(
    "body",
    [
        f"<article>{BODY}</article>",
        f"<main><div>{BODY}</div></main>",
        f"<article><header><h1>A title</h1></header>{BODY.removeprefix('<h1>A title</h1>')}</article>",
        f"<article>{BODY}<form><input name=x><label>Your mail</label><button>Send</button></form><section class='comments'><p>{'I like this text. ' * 30}</p></section></article>",
        "<article>" + BODY.replace("</p><p>", f"</p><div class='ad-slot'><p>{'Buy more of it! ' * 20}</p></div><p>", 1) + "</article>",
        "<article>" + BODY.replace("<p>", "<p><b>").replace("</p>", "<br></p>") + "</article>",
        "<article>" + BODY.replace("</p>", "") + "</article>",
        f"<article>{BODY}<!-- <p>not this</p> --><aside>Not this</aside><div role='alert'>Nor this</div><div hidden>nor this</div></article>",
        f'<div class="page no-sidebar" title="so hidden now"><article>{BODY}</article></div><div class="sidebar"><p>{"Other news. " * 40}</p></div><div id="cookie-notice"><p>{"We use cookies. " * 10}</p></div>',
    ],
)
def test_known_texts(model, learned, body):
    m = model if learned else PageModel()
    for html in (page(body), page(body, after=""), page(body).replace("</body></html>", ""), page(body).replace(" ", "\n \t")):
        assert m.text(html) == TEXT


def test_pages_that_mark_nothing(model):
    """No article, no class names: the scan alone finds the region, from weights learned on other pages."""
    links = "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(12))
    assert model.text(page(f"<div>{BODY}</div>", before=f"<div><ul>{links}</ul></div>", after=f"<div><ul>{links}</ul></div>")) == TEXT
    cells = "<table>" + "<tr><td>a b</td></tr>" * 6 + "</table>"
    assert model.text(f"<body>{cells}<div>{BODY}</div>{cells}</body>") == TEXT


def test_odd_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "<nav>x</nav>"), (None, f"<article>{BODY}"), (5, "<article>a &lt;b&gt; &amp;amp; &copy &#x41;&am</article>"), (6, "<article><p>x <div class='y" + " z" * 10), (7, "<article><p>a</p><p></p> b <hr>c"), (8, "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    rows += [(1, "<article>x</article>"), (1, "<article>x</article>"), (9, "<article><p title='it\">x y</p></article>"), (10, "a < b and <3 c")]
    df = spark.createDataFrame([(i, "u", h, "t", 1) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = main_text(df, model).collect()
    by = {(r.page_id, r.text) for r in got}
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert {(1, ""), (2, ""), (3, ""), (None, TEXT), (5, "a <b> &amp; © A&am"), (6, "x"), (7, "a\nb\nc"), (8, "\n".join(["word"] * 20_000)), (1, "x"), (9, "x y"), (10, "a < b and <3 c")} == by
    empty = df.where("page_id = 77")
    assert main_text(empty, fit_pages(empty)).count() == 0


def test_only_labelled_pages_teach():
    assert counts(page(BODY)) is None and counts(page(f"<article>{BODY}</article>" * 2)) is None
    inside, outside = counts(page(f"<article>{BODY}</article>"))
    assert inside[("w", "p")] == sum(len(p.split()) for p in PARAGRAPHS) and outside[("w", "nav")] == 1


def test_parsing_is_linear():
    """Thousands of unended quotes and tags."""
    assert len(parse("<a b=\"" * 20_000 + "x").tokens) < 3 and len(parse("<p>" * 20_000).tokens) == 20_000
